"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams (A-Z lower-cased) are hashed to ``BUCKETS`` buckets.  Their counts
over the whole corpus and over the trusted documents (label ``quality`` = 1; at most
``MAX_TRUSTED``, whose ids are broadcast, so that no text is shuffled) give two smoothed
multinomials; a document's score is the mean over its n-grams of the log ratio trusted / raw.
A document is kept when no base rule fails and its score is at least ``MIN_RATIO``: a fixed
threshold, so that equal texts always get equal verdicts.

Counting sums inside each task before the shuffle and ends in one row a bucket, so what comes
to the driver and goes back to the tasks has a fixed size.  Scoring is local to a row.

Edge cases: null and empty texts have no words and fail the base rules; null ids are scored
as well but are never trusted; labels with null ids or qualities are no labels, and of several
labels of one id the greatest counts; repeated rows count and are scored each; without any
trusted document every score is 0; an empty table gives an empty one; other columns are dropped
by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import LOWER, SPACE, mix, per_row_sum, text_chunks, windows3, word_hashes, words

BUCKETS = 1 << 16
#: Added to each bucket of both multinomials once the raw counts are scaled to the trusted
#: ones, so that a bucket with little evidence says little.
SMOOTHING = 10.0
#: Mean log ratio per n-gram from which a text counts as like the trusted ones.
MIN_RATIO = -0.12
#: Trusted documents that the target multinomial is fitted on, chosen by a hash of their ids
#: (the raw one counts the whole corpus).
MAX_TRUSTED = 100_000
#: Fixed limits of the base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = " \t\n\x0b\x0c\r"


def _ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram of a chunk."""
    low = LOWER[data]
    start, end, row = words(low, off)
    h = word_hashes(low, start, end)
    pair = row[1:] == row[:-1]
    two = mix(h[:-1] * np.uint64(0xA0761D6478BD642F) + h[1:])[pair]
    return (np.concatenate([h, two]) >> np.uint64(48)).astype(np.int64), np.concatenate([row, row[1:][pair]])


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_TRUSTED) -> DataFrame:
    rows = (labels.select(F.col(id_col).alias("_trusted_id"), F.col("quality").cast("int").alias("q"))
            .where("_trusted_id is not null").groupBy("_trusted_id").agg(F.max("q").alias("q"))
            .where("q = 1").select("_trusted_id"))
    key = F.md5(F.col("_trusted_id").cast("string").cast("binary"))
    return rows.orderBy(key, "_trusted_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_TRUSTED) -> np.ndarray:
    """The log ratio of every bucket, from all documents and the trusted among them."""
    ids = F.broadcast(trusted_ids(labels, id_col, max_rows))
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    src = src.join(ids, src["i"] == ids["_trusted_id"], "left").select(
        "t", F.col("_trusted_id").isNotNull().alias("trusted"))

    def count(batches) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            trusted = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, off in text_chunks(b.column(0)):
                bucket, row = _ngrams(data, off)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[trusted[lo:hi][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["b", "raw", "target"])

    rows = (src.mapInArrow(count, "b long, raw long, target long")
            .groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    at = rows["b"].to_numpy()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[at], target[at] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log(target + SMOOTHING) - np.log(raw * (target.sum() / raw.sum()) + SMOOTHING)


def _repeated_words(start, end, row, data, n_rows) -> np.ndarray:
    """Words of each row that stand in a window of three which the row has more than once."""
    out = np.zeros(n_rows, np.int64)
    if len(start) < 3:
        return out
    h = windows3(word_hashes(data, start, end))
    inside = row[2:] == row[:-2]
    key = mix(h + row[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[inside]
    at = np.flatnonzero(inside)
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    at = at[n[back] > 1]
    marked = np.zeros(len(start), bool)
    for k in range(3):
        marked[at + k] = True
    return np.bincount(row[marked], minlength=n_rows)


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(col: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (rows x NAMES) and the mean log ratio of every text of a batch."""
    n = len(col)
    counts, ratio = np.zeros((n, len(NAMES)), np.int64), np.zeros(n)
    for lo, hi, data, off in text_chunks(col):
        m = hi - lo
        start, end, row = words(data, off)
        counts[lo:hi, 0] = np.bincount(row, minlength=m)
        counts[lo:hi, 1] = per_row_sum(~SPACE[data] & ((data & 0xC0) != 0x80), off)
        counts[lo:hi, 2] = per_row_sum(_SYMBOL[data], off)
        raw = data.tobytes()
        counts[lo:hi, 3] = [_dup_lines(raw[a:b].decode()) if b > a else 0 for a, b in zip(off[:-1], off[1:])]
        counts[lo:hi, 4] = _repeated_words(start, end, row, data, m)
        bucket, at = _ngrams(data, off)
        ratio[lo:hi] = np.bincount(at, weights=model[bucket], minlength=m) / np.maximum(1, np.bincount(at, minlength=m))
    return counts, ratio


def _verdict(counts: np.ndarray, ratio: np.ndarray, min_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    n = counts[:, 0]
    failed = (n < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * n)
    return failed, ~failed & (ratio >= min_ratio)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          min_ratio: float = MIN_RATIO) -> DataFrame:
    """(id, base counts, base_failed, kept, ratio) of every row."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([src.schema[0], *(T.StructField(x, T.LongType()) for x in NAMES),
                        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
                        T.StructField("ratio", T.DoubleType())])

    def run(batches):
        for b in batches:
            counts, ratio = _measure(b.column(1), shared.value)
            failed, kept = _verdict(counts, ratio, min_ratio)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[:, i]) for i in range(len(NAMES))), pa.array(failed), pa.array(kept),
                 pa.array(ratio)], out.fieldNames())

    return src.mapInArrow(run, out)


def keep(docs: DataFrame, model: np.ndarray, text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            _, kept = _verdict(*_measure(pc.cast(b.column(at), pa.large_string()), shared.value), min_ratio)
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)

"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after a word that ends in one of ``.!?;:,|``, at a line feed, and,
as sentences may be very long or have no such signs, after a word whose hash is divisible by
``CUT`` (so the cut depends on the words alone, not on where a passage stands).  As all of these may
be missing, a sentence is cut into pieces: of every ``WINDOW`` words without an end, the one with the
least hash (the last of them, if equal) ends a piece.  So any ``WINDOW`` words hold a boundary, and it
depends on no word that is ``WINDOW`` or more away.  From every piece a span runs over the
following ones until it has ``MIN_SENTENCES`` pieces and ``MIN_WORDS`` words; a repeated passage of
6 * ``WINDOW`` - 2 = 46 words always holds one that is the same in all its copies.  Spans are compared
by the hash of their words (A-Z lower-cased).  The first occurrence of a span is the one with the
smallest id, then row, then place; the pieces of every other one are removed.

Texts are read once: what is shuffled are span hashes.  They are counted with a partial sum
before the shuffle, then all spans meet the repeated ones in a join whose hot partitions Spark may
split; a span that a third of all documents share is never gathered anywhere.  What comes back to
a document is at most its own spans.

Edge cases: null and empty texts and texts too short for a span have no spans and lose nothing;
null ids come before all others; rows with the same id and text are told apart by their row, so
the later one loses its sentences; repeated sentences inside one text lose all but their first
span; an empty table gives an empty one; other columns are dropped by ``repeated_spans``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import LOWER, _powers, mix, text_chunks, word_hashes, words
from pairlab.session import scratch_path

MIN_SENTENCES, MIN_WORDS = 3, 16
#: One word in so many ends a sentence whatever it ends in.
CUT = 8
#: Any so many words hold the end of a piece.
WINDOW = 8
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?;:,|"]] = True


def sentences(data: np.ndarray, off: np.ndarray, cut: int = CUT):
    """(word hashes, first word and end word of every piece, its row, its first byte, whether it
    ends a sentence)."""
    low = LOWER[data]
    start, end, row = words(low, off)
    if not len(start):
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, z, z, np.empty(0, bool)
    h = word_hashes(low, start, end)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(len(start), bool)
    last[:-1] = (row[1:] != row[:-1]) | (lines[start[1:]] > lines[end[:-1]])
    last |= _ENDS[data[end - 1]] | (h % np.uint64(cut) == 0)
    stop = np.flatnonzero(last | least_of_windows(h, last)) + 1
    first = np.concatenate([[0], stop[:-1]])
    return h, first, stop, row[first], start[first], last[stop - 1]


def least_of_windows(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which words have the least hash of some ``WINDOW`` words without a sentence's end."""
    out, n = np.zeros(len(h), bool), len(h) - WINDOW + 1
    if n > 0:
        ends = np.concatenate([[0], np.cumsum(last)])
        at = np.flatnonzero(ends[WINDOW:] == ends[:n])
        view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[at, ::-1]
        out[at + WINDOW - 1 - view.argmin(axis=1)] = True
    return out


def spans(h: np.ndarray, first: np.ndarray, stop: np.ndarray, row: np.ndarray, least: int, least_words: int):
    """For every piece from which a span runs: its index, the span's last piece, its hash."""
    n = len(first)
    last = np.maximum(np.searchsorted(stop, first + least_words), np.arange(n) + least - 1)
    at = np.flatnonzero(last < n)
    at = at[row[last[at]] == row[at]]
    last = last[at]
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    a, b = first[at], stop[last]
    return at, last, mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def _measured(docs: DataFrame, id_col: str, text_col: str, least: int, least_words: int) -> DataFrame:
    """A row for each document: serial, id, the code points that its pieces start at, which of them
    end a sentence, the length, and its spans (place, number of pieces, hash)."""
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def run(batches):
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1)):
                m = hi - lo
                h, first, stop, row, byte, ends = sentences(data, off)
                at, last, key = spans(h, first, stop, row, least, least_words)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin = np.searchsorted(row, np.arange(m + 1))
                place = (at - begin[row[at]]).astype(np.int32) if len(at) else np.empty(0, np.int32)
                cut = np.searchsorted(row[at], np.arange(m + 1)) if len(at) else np.zeros(m + 1, np.int64)
                lists = lambda o, v: pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(serial + np.arange(m)), batch.column(0).slice(lo, m),
                     lists(begin, (points[byte] - points[off[row]]).astype(np.int32)), lists(begin, ends),
                     pa.array((points[off[1:]] - points[off[:-1]]).astype(np.int32)),
                     lists(cut, place), lists(cut, (last - at + 1).astype(np.int32)), lists(cut, key.view(np.int64))],
                    ["serial", "id", "starts", "ends", "chars", "places", "lengths", "hashes"])
                serial += m

    return src.mapInArrow(run, "serial long, id long, starts array<int>, ends array<boolean>, chars int, "
                               "places array<int>, lengths array<int>, hashes array<long>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_SENTENCES,
                   least_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed array<struct<start, end>> in code points, first_ids
    array<long>: where the removed spans stand first), a row for every document; n_removed counts the
    sentences that are removed whole."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "spans")
    _measured(docs, id_col, text_col, least, least_words).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")

    hashes = rows.select(F.explode("hashes").alias("hash"))
    hashes.groupBy("hash").agg(F.count("hash").alias("n")).where("n > 1").select("hash").write.parquet(f"{path}/repeated")
    repeated = spark.read.parquet(f"{path}/repeated")
    spread = (rows.select("serial", "id", F.explode(F.arrays_zip("places", "lengths", "hashes")).alias("x"))
              .select("serial", "id", F.col("x.places").alias("place"), F.col("x.lengths").alias("length"),
                      F.col("x.hashes").alias("hash")))
    spread.join(repeated, "hash").write.parquet(f"{path}/occurrences")
    occurrences = spark.read.parquet(f"{path}/occurrences")
    (occurrences.groupBy("hash").agg(F.min(F.struct("id", "serial", "place")).alias("first"))
     .write.parquet(f"{path}/firsts"))
    firsts = spark.read.parquet(f"{path}/firsts")
    later = (occurrences.join(firsts, "hash").where("serial <> first.serial OR place <> first.place")
             .groupBy("serial").agg(F.collect_set(F.struct("place", "length")).alias("gone"),
                                    F.collect_set("first.id").alias("first_ids")))
    joined = rows.select("serial", "id", "starts", "ends", "chars").join(later, "serial", "left").select(
        "id", "starts", "ends", "chars", "gone", F.array_sort(F.coalesce("first_ids", F.array().cast("array<long>"))).alias("first_ids"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            n_all, n_gone, cells = [], [], []
            for starts, ends, chars, gone in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                edges, marked = [*starts, chars], np.zeros(len(starts) + 1, np.int64)
                for x in gone or ():
                    marked[x["place"]] += 1
                    marked[x["place"] + x["length"]] -= 1
                covered = np.cumsum(marked)[:-1] > 0 if len(starts) else np.empty(0, bool)
                steps = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                left = np.diff(np.cumsum(~covered)[np.flatnonzero(ends)], prepend=0)
                n_all.append(len(left))
                n_gone.append(int((left == 0).sum()))
                cells.append([{"start": edges[a], "end": edges[z]} for a, z in zip(steps[::2], steps[1::2])])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_all, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(cells, kind), b.column(5)],
                ["doc_id", "n_sentences", "n_removed", "removed", "first_ids"])

    return joined.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, "
                                  "removed array<struct<start: int, end: int>>, first_ids array<long>")


def cut_out(text: str | None, removed: list[tuple[int, int]]) -> str | None:
    """The text without the removed ranges."""
    if text is None:
        return None
    at, parts = 0, []
    for start, end in removed:
        parts.append(text[at:start])
        at = end
    return "".join([*parts, text[at:]])

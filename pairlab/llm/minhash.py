"""MinHash near-duplicate detection: universal minima, bands, sketches, exact checks.

A document's set holds its distinct shingles of ``shingle`` words (A-Z lower-cased; a shorter
text is one shingle).  Each shingle is a 64-bit hash; ``BANDS * ROWS`` multiply-add hashes of it
are minimised, and ``ROWS`` minima make the key of a band.  Equal sets are one class with its
smallest id; only classes are compared.

1. Stars: each bucket of a band elects the class that stands in the most crowded buckets (the
   text that a family of copies was made from agrees with the majority everywhere); all others
   are checked against it.  Rows stay linear in the input.
2. Components of these links; inside a bucket only classes of different components still matter.
3. The rest, exactly: in every bucket with several components, classes outside the elected one's
   component meet all classes of other components.  The join's own condition compares sizes, one
   bit of each of ``FINE`` further minima, and whether an earlier band has the pair already, so
   only likely pairs leave it, once each.
4. Every pair of 1 and 3 is confirmed on the full sets (integers, no rounding).
5. Components by alternating large-star and small-star.

A pair at the limit is missed with a probability of (1 - 0.85^6)^32 < 3e-7 by the bands and
about 2e-5 by each sketch.  Comparisons in step 3 grow with the square of a family whose members
are all alike but stay below the limit; nothing is capped there.

Edge cases: null and empty texts and texts without words have empty sets and link with nothing;
a document with a null id links with nothing (component null, kept); an id on several rows is
one document, linked by any of them, with the largest of its sets' sizes; an empty table gives
an empty one; other columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import LOWER, mix, text_chunks, word_hashes, words
from pairlab.llm.components import connected_components
from pairlab.session import scratch_path

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
#: Four bits of each minimum, sixteen minima in a long.
LONGS = HASHES // 16
SEED = 20240229
SHARES = np.random.default_rng(SEED)
MULTIPLY = SHARES.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = SHARES.integers(0, 2**63, HASHES, dtype=np.uint64)
#: Further minima, one bit of each kept, of classes that share a crowded bucket.
FINE = 2048
FINE_LONGS = FINE // 64
FINE_MULTIPLY = SHARES.integers(0, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FINE_ADD = SHARES.integers(0, 2**63, FINE, dtype=np.uint64)
#: Standard deviations of a sketch's estimate that a pair may fall short of the limit.
MARGIN = 4.2


def _doc_sets(data: np.ndarray, off: np.ndarray, k: int):
    """The sorted distinct shingle hashes of every row of a chunk."""
    low = LOWER[data]
    start, end, row = words(low, off)
    h = word_hashes(low, start, end)
    cut = np.searchsorted(row, np.arange(len(off)))
    for a, b in zip(cut[:-1], cut[1:]):
        w = h[a:b]
        if len(w) > k:
            m = len(w) - k + 1
            x = w[:m].copy()
            for i in range(1, k):
                x = mix(x * np.uint64(0xA0761D6478BD642F) + w[i:m + i])
            yield np.unique(x)
        elif len(w):
            x = w[:1].copy()
            for i in range(1, len(w)):
                x = mix(x * np.uint64(0xA0761D6478BD642F) + w[i:i + 1])
            yield mix(x + np.uint64(len(w))) if len(w) < k else x
        else:
            yield w


def minima(x: np.ndarray, multiply: np.ndarray = MULTIPLY, add: np.ndarray = ADD) -> np.ndarray:
    """The least value of every hash over a non-empty set (upper 32 bits)."""
    step = max(1, (1 << 16) // len(multiply))
    best, buf = None, np.empty((min(len(x), step), len(multiply)), np.uint64)
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        out = buf[:len(part)]
        np.multiply(part[:, None], multiply, out=out)
        np.add(out, add, out=out)
        low = out.min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best >> np.uint64(32)


def _band_keys(m: np.ndarray) -> np.ndarray:
    g = m.reshape(BANDS, ROWS)
    x = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        x = mix(x * np.uint64(0xA0761D6478BD642F) + g[:, i])
    return x.view(np.int64)


_NIBBLE = np.arange(16, dtype=np.uint64) * np.uint64(4)


def _sketch(m: np.ndarray) -> np.ndarray:
    bits = (mix(m) & np.uint64(15)).reshape(LONGS, 16) << _NIBBLE
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


_BIT = np.arange(64, dtype=np.uint64)


def _fine_sketch(x: np.ndarray) -> np.ndarray:
    bits = (mix(minima(x, FINE_MULTIPLY, FINE_ADD)) & np.uint64(1)).reshape(FINE_LONGS, 64) << _BIT
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


SKETCH = [f"s{i}" for i in range(LONGS)]
FINE_SKETCH = [f"w{i}" for i in range(FINE_LONGS)]


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n, digest, bands array<long>, sketch longs) of every row; empty sets have nulls."""
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
                        *(T.StructField(c, T.LongType()) for c in SKETCH)])

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1)):
                m = hi - lo
                n, digest = np.zeros(m, np.int64), [None] * m
                bands, sketch = np.zeros((m, BANDS), np.int64), np.zeros((m, LONGS), np.int64)
                for i, x in enumerate(_doc_sets(data, off, shingle)):
                    n[i] = len(x)
                    if len(x):
                        digest[i] = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                        low = minima(x)
                        bands[i], sketch[i] = _band_keys(low), _sketch(low)
                offsets = pa.array(np.arange(m + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, m), pa.array(n), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())),
                     *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(LONGS))], out.fieldNames())

    return src.mapInArrow(run, out)


def full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles array<long>, fine sketch longs) of rows (id, text, digest) whose set has
    that digest."""
    names = ["id", "shingles", *FINE_SKETCH]

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1)):
                want = batch.column(2).slice(lo, hi - lo).to_pylist()
                sets = list(_doc_sets(data, off, shingle))
                good = [len(x) > 0 and hashlib.blake2b(x.tobytes(), digest_size=16).digest() == d
                        for x, d in zip(sets, want)]
                kept = [x for x, g in zip(sets, good) if g]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                flat = np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64)
                fine = np.array([_fine_sketch(x) for x in kept], np.int64).reshape(-1, FINE_LONGS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).filter(pa.array(good)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     *(pa.array(np.ascontiguousarray(fine[:, j])) for j in range(FINE_LONGS))], names)

    return texts.mapInArrow(run, "id long, shingles array<long>, " + ", ".join(f"{c} long" for c in FINE_SKETCH))


def _agreeing(left: str, right: str) -> str:
    """SQL: how many of the minima of two sketches agree in their four bits."""
    parts = []
    for c in SKETCH:
        x = f"({left}{c} ^ {right}{c})"
        y = f"({x} | shiftrightunsigned({x}, 2))"
        parts.append(f"bit_count(({y} | shiftrightunsigned({y}, 1)) & {0x1111111111111111}L)")
    return f"({HASHES} - ({' + '.join(parts)}))"


def _least_agreeing(percent: int) -> int:
    p = percent / 100 + (1 - percent / 100) / 16
    return int(HASHES * p - MARGIN * (HASHES * p * (1 - p)) ** 0.5)


def _likely(left: str, right: str, percent: int) -> Column:
    """Whether sizes and sketches leave it possible that a pair is alike enough."""
    sizes = f"100 * least({left}n, {right}n) >= {percent} * greatest({left}n, {right}n)"
    return F.expr(f"{sizes} AND {_agreeing(left, right)} >= {_least_agreeing(percent)}")


def _likely_fine(left: str, right: str, percent: int) -> Column:
    """The same by the fine sketches."""
    p = 0.5 + percent / 200
    least = int(FINE * p - MARGIN * (FINE * p * (1 - p)) ** 0.5)
    differing = " + ".join(f"bit_count({left}{c} ^ {right}{c})" for c in FINE_SKETCH)
    return F.expr(f"100 * least({left}n, {right}n) >= {percent} * greatest({left}n, {right}n) "
                  f"AND {FINE} - ({differing}) >= {least}")


def _named(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return rows.select([F.col(c).alias(prefix + c) for c in columns])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for every document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "minhash")
    signatures(docs, id_col, text_col, shingle).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")

    own = (rows.where("id is not null").groupBy("id").agg(F.max(F.struct("n", "digest")).alias("x"))
           .select("id", "x.n", "x.digest"))
    # written, so that joins deal it out anew and Spark may split the partition of a hot class
    own.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")).write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    rows.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"]).dropDuplicates(
        ["id", "digest"]).write.parquet(f"{path}/reps")
    reps = spark.read.parquet(f"{path}/reps")

    links = _links(docs, reps, path, id_col, text_col, shingle, percent)
    found = connected_components(links)
    whole = (own.join(classes, "digest", "left")
             .select("id", "n", F.coalesce("rep", "id").alias("rep")))
    done = (whole.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
            .select("id", "n", F.coalesce("component", "rep").alias("component_id")))
    done = done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                       (F.col("id") == F.col("component_id")).alias("kept"))
    return done.union(rows.where("id is null").select("id", "n", F.lit(None).cast("long"), F.lit(True)))


def _links(docs: DataFrame, reps: DataFrame, path: str, id_col: str, text_col: str, shingle: int,
           percent: int) -> DataFrame:
    """Links (a, b) between classes that join all classes which a chain of links can join."""
    spark = docs.sparkSession
    entries = reps.select("id", F.posexplode("bands").alias("band", "key"))
    crowded = entries.groupBy("key").agg(F.count("id").alias("members")).where("members > 1").checkpoint()
    entries = entries.join(crowded, "key")
    weight = entries.groupBy("id").agg(F.sum("members").alias("weight"))
    entries.join(weight, "id").select("key", "band", "id", "weight").write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")

    needed = entries.select("id").distinct().join(reps.select("id", "digest"), "id")
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
             .join(needed, "id").select("id", "text", "digest"))
    full_sets(texts, shingle).write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")

    hubs = entries.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("x"))
    hubs = hubs.select("key", (-F.col("x.minus")).alias("hub")).checkpoint()
    stars = (entries.join(hubs, "key").where("id <> hub")
             .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    sketched = ["id", "n", *SKETCH]
    stars = (stars.join(_named(reps, "l_", sketched), F.col("a") == F.col("l_id"))
             .join(_named(reps, "r_", sketched), F.col("b") == F.col("r_id"))
             .where(_likely("l_", "r_", percent)).select("a", "b"))
    near = _confirm(stars, sets, percent).checkpoint()
    groups = connected_components(near)

    entries = (entries.join(groups, "id", "left")
               .select("key", "band", "id", F.coalesce("component", "id").alias("component"),
                       F.struct("weight", (-F.col("id")).alias("minus")).alias("rank")))
    open_ = (entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.max(F.struct("rank", "component")).alias("x"))
             .where("low <> high").select("key", F.col("x.component").alias("main")))
    columns = ["key", "band", "component", "main", "bands", "id", "n", *FINE_SKETCH]
    rest = (entries.join(open_.checkpoint(), "key").join(reps.select("id", "n", "bands"), "id")
            .join(sets.select("id", *FINE_SKETCH), "id").select(columns))
    rest.write.parquet(f"{path}/rest")
    rest = spark.read.parquet(f"{path}/rest")
    left = _named(rest.where("component <> main"), "l_", columns)
    right = _named(rest, "r_", columns)
    once = F.expr("NOT arrays_overlap(slice(l_bands, 1, l_band), slice(r_bands, 1, l_band))")
    other = F.expr("l_component <> r_component AND (r_component = r_main OR l_id < r_id)")
    pairs = left.join(right, (F.col("l_key") == F.col("r_key")) & other & _likely_fine("l_", "r_", percent) & once)
    pairs = pairs.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))
    return near.union(_confirm(pairs, sets, percent))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
               percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the smallest id, once; rows with a
    null id stay."""
    found = near_duplicates(docs, id_col, text_col, shingle, percent).where("kept and doc_id is not null")
    kept = docs.join(found.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").dropDuplicates([id_col])
    return kept.select(docs.columns).union(docs.where(F.col(id_col).isNull()))

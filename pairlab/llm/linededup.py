"""Line dedup: a sharded minimal perfect hash over the distinct line keys.

A line's key is the line without white space at both ends, A-Z lower-cased; it is known by its
64-bit hash.  Texts are read once and packed into chunks; a chunk holds its texts (zstandard), its
sorted distinct key hashes and in how many of its documents each stands.  The range of hashes is cut
into shards of about ``SHARD_KEYS`` entries.  For each shard one task adds up the entries of all
chunks and builds the index: a minimal perfect hash (levels of bits; a key takes the first level
where it stands alone, its place is the rank of that bit) and, at that place, a 32-bit fingerprint
and the number of documents.  The documents then probe these arrays: every chunk sends each shard
one packed slice of its keys and gets back those found often enough.  No row is made for a line,
no lines are joined and nothing is broadcast.

A key that a third of all documents share is one entry a chunk.  Every row below is bounded by a
chunk (``CHUNK_BYTES`` of text, or one longer text) or by a shard; shards are cut by hash, so they
are alike in size.  Two different lines with equal 64-bit hashes count as one (n distinct lines:
n * n / 2**65 such pairs to be expected).

Edge cases: a null or empty text is one empty line; every row is a document of its own, whatever
its id (null and repeated ids too); keys of fewer than ``least_chars`` code points are never
dropped; a text whose lines all go is the empty text; an empty table gives an empty one; columns
other than id and text are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import mix
from pairlab.session import scratch_path

#: Text bytes of a chunk, and entries (keys of chunks) of a shard.
CHUNK_BYTES, SHARD_KEYS = 4 << 20, 1 << 18
#: Documents of a chunk at most (texts may be empty).
CHUNK_ROWS = 1 << 16
#: Bits of a level for every key that is still without a place.
GAMMA = 2
_WHITE = b" \t\n\x0b\x0c\r"
_LEVEL = 0xD6E8FEB86659FD93


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line (bytes.lower changes A-Z alone)."""
    return [line.strip(_WHITE) for line in text.lower().split(b"\n")]


def key_hashes(keys: list[bytes], least_chars: int = 1) -> np.ndarray:
    """The 64-bit hash of every key; 0 for keys that are too short (and no other key)."""
    if least_chars > 1:
        keys = [k if len(k) >= least_chars and len(k.decode()) >= least_chars else b"" for k in keys]
    return np.array([xxhash.xxh3_64_intdigest(k) or 1 if k else 0 for k in keys], np.uint64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits and their ranks."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.uint64), words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            m = -(-GAMMA * len(keys) // 64) * 64
            at = PerfectHash._place(keys, len(sizes), m)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return PerfectHash(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, np.uint64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * _LEVEL % (1 << 64))) % np.uint64(m)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, 0 to n - 1; for a key that was not built in: any place or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            bit = self._place(keys[left], level, int(m)) + int(self.starts[level])
            word, low = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            out[left[hit]] = (self.ranks[bit >> 6] + before)[hit]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(_LEVEL)) >> np.uint64(32)).astype(np.uint32)


class CountIndex:
    """Fingerprint and count arrays behind a perfect hash."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hash, self.prints, self.counts = hash_, prints, counts

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> CountIndex:
        h = PerfectHash.build(keys)
        at = h.index(keys)
        prints, ordered = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
        prints[at], ordered[at] = fingerprints(keys), counts
        return CountIndex(h, prints, ordered)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """In how many documents each key stands; 0 for one that the fingerprint tells apart."""
        at = self.hash.index(keys)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64)
        return np.where((at >= 0) & (self.prints[at] == fingerprints(keys)), self.counts[at], 0)


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    c = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


CHUNK = "chunk long, ids array<long>, lengths array<long>, texts binary, keys binary, counts binary"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """Chunks: ids, texts, and the distinct key hashes with the number of documents that hold each."""
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))

    def run(batches):
        number, squeeze = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        ids, texts, size = [], [], 0

        def chunk():
            per_doc = [np.unique(key_hashes(line_keys(t), least_chars)) for t in texts]
            k, c = add_up([h[h != 0] for h in per_doc], [np.ones(int((h != 0).sum()), np.int64) for h in per_doc])
            return pa.RecordBatch.from_pylist(
                [{"chunk": number, "ids": ids, "lengths": [len(t) for t in texts], "keys": k.tobytes(),
                  "texts": squeeze.compress(b"".join(texts)), "counts": c.astype(np.uint32).tobytes()}],
                pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                           ("texts", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or b""
                if texts and (size + len(text) > CHUNK_BYTES or len(texts) == CHUNK_ROWS):
                    yield chunk()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(batch.column(0)[i].as_py())
                texts.append(text)
                size += len(text)
        if texts:
            yield chunk()

    return src.mapInArrow(run, CHUNK)


def slices_of(chunks: DataFrame, shards: int) -> DataFrame:
    """The keys of every chunk, cut into one packed slice for each shard that has any."""

    def run(batches):
        for b in batches:
            rows = []
            for chunk, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)
                shard = (k >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)  # k is sorted, so shard is
                edges = np.flatnonzero(np.diff(shard, prepend=shards, append=shards))
                rows += [{"shard": int(shard[lo]), "chunk": chunk, "keys": k[lo:hi].tobytes(), "counts": c[lo:hi].tobytes()}
                         for lo, hi in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int64()), ("chunk", pa.int64()),
                                                              ("keys", pa.binary()), ("counts", pa.binary())]))

    return chunks.select("chunk", "keys", "counts").mapInArrow(run, "shard long, chunk long, keys binary, counts binary")


INDEX = "shard long, sizes binary, words binary, prints binary, counts binary"


def build_index(slices: DataFrame) -> DataFrame:
    """One row a shard: the arrays of its index."""

    def run(batches):
        now, keys, counts, held, settled = None, [], [], 0, 0

        def row():
            x = CountIndex.build(*add_up(keys, counts))
            return pa.RecordBatch.from_pylist(
                [{"shard": now, "sizes": x.hash.sizes.tobytes(), "words": x.hash.words.tobytes(),
                  "prints": x.prints.tobytes(), "counts": x.counts.astype(np.uint32).tobytes()}],
                pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("sizes", "words", "prints", "counts"))]))

        for b in batches:
            for shard, k, c in zip(*(x.to_pylist() for x in b.columns)):
                if shard != now:
                    if now is not None:
                        yield row()
                    now, keys, counts, held, settled = shard, [], [], 0, 0
                keys.append(np.frombuffer(k, np.uint64))
                counts.append(np.frombuffer(c, np.uint32))
                held += len(keys[-1])
                if held > 2 * settled + SHARD_KEYS:  # what waits is never much more than the distinct keys
                    keys, counts = ([x] for x in add_up(keys, counts))
                    held = settled = len(keys[0])
        if now is not None:
            yield row()

    return slices.repartition("shard").sortWithinPartitions("shard").select("shard", "keys", "counts").mapInArrow(run, INDEX)


def probe(slices: DataFrame, index: DataFrame, least_docs: int) -> DataFrame:
    """(chunk, keys): the keys of each slice that stand in at least ``least_docs`` documents."""
    none = F.lit(None).cast("binary")
    both = (slices.select("shard", F.col("chunk"), "keys", *(none.alias(c) for c in ("sizes", "words", "prints", "counts")))
            .unionByName(index.select("shard", F.lit(-1).cast("long").alias("chunk"), none.alias("keys"),
                                      "sizes", "words", "prints", "counts")))

    def run(batches):
        now, at = None, None
        for b in batches:
            rows = []
            for shard, chunk, keys, sizes, words, prints, counts in zip(*(c.to_pylist() for c in b.columns)):
                if chunk == -1:
                    at, now = shard, CountIndex(PerfectHash(np.frombuffer(sizes, np.uint64), np.frombuffer(words, np.uint64)),
                                                np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32))
                elif at == shard:
                    k = np.frombuffer(keys, np.uint64)
                    k = k[now.count(k) >= least_docs]
                    if len(k):
                        rows.append({"chunk": chunk, "keys": k.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("keys", pa.binary())]))

    return (both.repartition("shard").sortWithinPartitions("shard", "chunk")
            .mapInArrow(run, "chunk long, keys binary"))


def drop_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document without the lines whose key stands in at
    least ``least_docs`` documents; n_lines counts the lines before."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lines")
    pack(docs, id_col, text_col, least_chars).write.parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    entries = chunks.agg(F.sum(F.length("keys"))).first()[0] or 0
    slices = slices_of(chunks, max(1, math.ceil(entries / 8 / SHARD_KEYS)))
    build_index(slices).write.parquet(f"{path}/index")
    common = probe(slices, spark.read.parquet(f"{path}/index"), least_docs)
    # at most one slice a shard, together no more than the chunk's own keys
    found = common.groupBy("chunk").agg(F.collect_list("keys").alias("found"))
    whole = chunks.select("chunk", "ids", "lengths", "texts").join(found, "chunk", "left").select("ids", "lengths", "texts", "found")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        for b in batches:
            for ids, lengths, packed, found in zip(*(c.to_pylist() for c in b.columns)):
                data = zstandard.ZstdDecompressor().decompress(packed)
                common = np.sort(np.frombuffer(b"".join(found or []), np.uint64))
                at, rows = 0, []
                for doc, n in zip(ids, lengths):
                    text = data[at:at + n]
                    at += n
                    lines = text.split(b"\n")
                    gone = 0
                    if len(common):
                        h = key_hashes(line_keys(text), least_chars)
                        place = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        stays = common[place] != h
                        gone = int((~stays).sum())
                        if gone:
                            text = b"\n".join([x for x, s in zip(lines, stays) if s])
                    rows.append({"doc_id": doc, "text": text.decode(), "n_lines": len(lines), "n_dropped": gone})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return whole.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def oracle() -> str:
    """DuckDB SQL for the query: document rows are told apart by their number."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
keyed AS (SELECT rn, i, line, translate(trim(line, {white}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rn) >= 10),
marked AS (SELECT rn, i, line, k IN (SELECT k FROM common) AS gone FROM keyed),
done AS (SELECT rn, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY rn)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN done USING (rn)"""

"""Shared pieces of the training-data operators: Arrow text chunks and word hashes.

Words are maximal runs of characters other than space and U+0009..U+000D.  Those
separators are single bytes in UTF-8, so words are cut on the bytes of a whole chunk of
documents at once, and every array below is bounded by the chunk (one document at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts, as a pattern that Spark, DuckDB and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


#: DuckDB: a one-row table ``crc`` with the 256 steps of crc32, by its rule.
CRC_SQL = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) t(i)))"""


def crc32_sql(text: str) -> str:
    """DuckDB: the crc32 of a string's UTF-8 bytes, where ``crc`` is among the tables."""
    byte = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({byte}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text is an empty one."""
    n = len(col)
    if not n:
        return
    col = pc.fill_null(col.cast(pa.large_string()), "")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1, offset=col.offset * 8)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row that it stands in."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    word = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    edge = off[:-1][off[:-1] < n]
    before[edge] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for longer texts than a chunk aren't kept."""
    def made(size: int, b: int) -> np.ndarray:
        p = np.full(size, b, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    bases = (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64)))
    if n > CHUNK_BYTES + 1:
        return tuple(made(n, b) for _, b in bases)
    for name, b in bases:
        if name not in _POWERS:
            _POWERS[name] = made(CHUNK_BYTES + 1, b)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial modulo 2^64, then finalised."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def windows3(h: np.ndarray) -> np.ndarray:
    """A hash of every three consecutive word hashes (order matters)."""
    return mix(h[:-2] * np.uint64(0xA0761D6478BD642F) + h[1:-1] * np.uint64(0xE7037ED1A0B428DB)
               + h[2:] * np.uint64(0x8EBC6AF09C88C6E3))


def per_row_sum(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the bytes of each row are flagged."""
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def texts_of(col: pa.Array) -> list[str]:
    return ["" if t is None else t for t in col.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 512, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made of them stays small: of so many rows at most, and with the
    number of a text column of about ``CHUNK_BYTES`` of it (a longer text is a part of its own)."""
    if text is None:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        return
    for first, end, _, _ in text_chunks(batch.column(text)):
        for lo in range(first, end, rows):
            yield batch.slice(lo, min(rows, end - lo))

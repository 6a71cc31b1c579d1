"""Byte-level BPE encoding and decoding by a local rank file (tiktoken).

``encode`` gives each text's ids as the library does without special tokens; texts longer
than ``split_chars`` are first cut at positions where a match of the splitting pattern must
end, so the ids stay the same and no piece of text grows without bound.  ``decode`` joins
the raw bytes of the ids.  Both are row-local: no shuffle, any partition can be redone.

Edge cases: a null text is an empty one (no ids, empty bytes); a null id or a repeated row
is kept as it is; other columns are dropped by
``encode``, unless it is told to keep them, and kept by ``decode``.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import slices, texts_of

#: Default rank file: a byte-level vocabulary for many languages.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts longer than this are cut at the next safe boundary before they are encoded.
SPLIT_CHARS = 1 << 16
#: Here every match of the pattern ends: no match goes on from a non-space character into a
#: space or line feed, and none holds an ASCII letter next to a digit.
SAFE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = SPLIT_CHARS):
    """The text in parts of about ``limit`` characters that end at safe boundaries."""
    lo = 0
    while len(text) - lo > limit:
        m = SAFE.search(text, lo + limit)
        if m is None or m.start() >= len(text):
            break
        yield text[lo:m.start()]
        lo = m.start()
    yield text[lo:]


def ids_of(text: str, enc: tiktoken.Encoding, limit: int = SPLIT_CHARS) -> np.ndarray:
    if len(text) <= limit:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, limit)]).astype("<u4")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", packed: bool = True, split_chars: int = SPLIT_CHARS,
           keep: tuple[str, ...] = (), check: str | None = None) -> DataFrame:
    """(id, n_tokens long, ids, columns to keep) per row; ids are packed little-endian unsigned
    32-bit integers (binary, the form shards are written in) or an array<int>.  With ``check`` a boolean
    column of that name says whether the ids decode to the text's bytes, found out in the same task, so
    neither text nor decoded bytes travel on."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    src = docs.select(id_col, text_col, *(F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)))
    out = T.StructType([src.schema[id_col], T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType())),
                        *(T.StructField(c, docs.schema[c].dataType) for c in keep),
                        *([T.StructField(check, T.BooleanType())] if check else [])])

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for b in slices(batch, text=1):
                texts = texts_of(b.column(1))
                ids = [ids_of(t, enc, split_chars) for t in texts]
                same = [pa.array([enc.decode_bytes(a.tolist()) == t.encode() for a, t in zip(ids, texts)], pa.bool_())] if check else []
                cells = pa.array([a.tobytes() for a in ids], pa.binary()) if packed else pa.array(
                    [a.astype(np.int32) for a in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(a) for a in ids], pa.int64()), cells, *b.columns[2:], *same],
                    out.fieldNames())

    return src.mapInArrow(run, out)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "ids",
           out_col: str = "decoded") -> DataFrame:
    """The rows with ``out_col``: the raw bytes of packed ids (null ids: empty bytes); a
    column of that name is replaced."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    src = tokens.drop(out_col) if out_col in tokens.columns else tokens
    at = src.columns.index(ids_col)
    out = T.StructType([*src.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for b in slices(batch):
                cells = [enc.decode_bytes(np.frombuffer(x, dtype="<u4").tolist())
                         for x in pc.fill_null(b.column(at), b"").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.binary())], [*b.schema.names, out_col])

    return src.mapInArrow(run, out)

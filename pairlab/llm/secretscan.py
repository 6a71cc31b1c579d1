"""Secret scan: three base patterns, and incompressible strings in a sensitive context.

The base spans are the leftmost non-overlapping matches of each pattern that are long enough.
The method adds spans of kind ``novel``: every run of key characters that follows a sensitive word
closely, and a shorter value with password symbols that is assigned to one, is compressed with zstandard after its surrounding text, with a raw dictionary of
common identifiers and code loaded; the marginal compressed bytes per character tell how much
of the run neither the dictionary nor the context foretells.  Runs above ``min_novelty`` that
reach further than the base spans are reported.  Everything is local to a row.

Edge cases: a null text is an empty one and has no spans; a text of any length is scanned
whole; repeated rows and null ids are kept; other columns are dropped by ``scan`` and kept by
``redact``.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import slices, texts_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words after which a string may be a credential; they may be parts of a camel-case name.
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
    r"(?i:password|passwd|passphrase|pwd|secret|token|api[-_ ]?key|access[-_ ]?key|private[-_ ]?key|"
    r"credentials?|bearer|authorization|auth|signature|client[-_ ]?id|session[-_ ]?id|aws)"
    r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))", re.ASCII)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "signature", "client", "session",
         "aws")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What assigns a value to the name that a sensitive word stands in, and such a value.
ASSIGNED = re.compile(r"""[A-Za-z0-9_]{0,24}["'\])]{0,2}\x20*(?::=|=>|[:=(])\x20*["'`]?([A-Za-z0-9+/_=.!@#$%^&*~?-]{8,})""")
#: Kinds of characters; a value that is no candidate by its length and characters has three of them.
CLASSES = tuple(re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[!@#$%^&*~?+]"))
#: A candidate starts within so many characters after the sensitive word.
REACH = 40
#: Characters before the sensitive word that prime the compressor with the dictionary.
CONTEXT = 200
#: Marginal compressed bytes a character from which a string counts as incompressible;
#: random base-64 text costs 0.75 to 1, words and identifiers well below 0.6.
MIN_NOVELTY = 0.68
#: What ordinary code and configuration is made of, as a raw compression dictionary.
DICTIONARY = " ".join("""
    the and for with from this that import export return function class public private static void const let var
    def self none null true false string integer boolean float double object array list dict map set type name value
    index count length size width height color default option options config configuration setting settings path file
    filename directory folder user username password secret token key apikey api_key access_key private_key client_id
    client_secret session_id authorization bearer basic signature credential credentials header headers request
    response server client host hostname port url uri http https www com org net localhost example test tests testing
    sample placeholder changeme your_password_here your_token_here xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 0000000000000000 AAAAAAAAAAAAAAAA database connection connect timeout
    retry maximum minimum environment variable process service application module package version release build
    """.split()).encode()


@functools.lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False)


def novelty(context: str, candidate: str) -> float:
    """Marginal compressed bytes per character of the candidate after its context."""
    c, a = _compressor(), context.encode()
    return (len(c.compress(a + candidate.encode())) - len(c.compress(a))) / max(1, len(candidate))


def spans_of(text: str, min_novelty: float = MIN_NOVELTY) -> list[tuple[int, int, int]]:
    """(start, end, kind index) in code points, by start, then kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if any(k in low for k in HINTS):
        base, seen = sorted((s, e) for s, e, _ in found), -1
        starts, reached = [s for s, _ in base], [0, *accumulate((e for _, e in base), max)]

        def report(word: re.Match, start: int, end: int) -> bool:
            # no base span that begins before the end reaches it
            new = (reached[bisect_left(starts, end)] < end
                   and novelty(text[max(0, word.start() - CONTEXT):start], text[start:end]) >= min_novelty)
            if new:
                found.append((start, end, 3))
            return new

        for word in SENSITIVE.finditer(text):
            m = ASSIGNED.match(text, word.end())
            if m and m.start(1) >= seen and sum(bool(c.search(m[1])) for c in CLASSES) >= 3 and report(word, *m.span(1)):
                seen = m.end()
            while m := CANDIDATE.search(text, max(word.end(), seen), word.end() + REACH + 16):
                m = CANDIDATE.match(text, m.start())
                if m.start() > word.end() + REACH:
                    break
                seen = m.end()
                report(word, *m.span())
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("kind", T.StringType())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """(id, spans array<struct<start, end, kind>>) of every row, spans by start, then kind."""
    src = docs.select(id_col, text_col)
    out = T.StructType([src.schema[id_col], T.StructField("spans", SPANS)])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for b in slices(batch, text=1):
                cells = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans_of(t, min_novelty)]
                         for t in texts_of(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, kind)], [id_col, "spans"])

    return src.mapInArrow(run, out)


def digest(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]",
           min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """The rows with every span of their text replaced by ``mark``; a column ``n_chars`` is
    brought up to date, all other columns and rows stay as they are (null text: null)."""
    names = docs.columns
    at, size = names.index(text_col), names.index("n_chars") if "n_chars" in names else None
    size_type = None if size is None else docs.schema["n_chars"].dataType

    def clean(text: str) -> str:
        parts, last = [], 0
        for s, e, _ in spans_of(text, min_novelty):
            if e <= last:
                continue
            if s >= last:
                parts += [text[last:s], mark]
            last = e
        return "".join([*parts, text[last:]])

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                old = b.column(at).to_pylist()
                new = [None if t is None else clean(t) for t in old]
                cols = list(b.columns)
                cols[at] = pa.array(new, b.schema.field(at).type)
                if size is not None and size_type in (T.LongType(), T.IntegerType()):
                    n = [x if a == c else len(c) for a, c, x in zip(old, new, cols[size].to_pylist())]
                    cols[size] = pa.array(n, b.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)

"""Tokens of whole texts as 64-bit ids, found in the texts' UTF-8 bytes with numpy.

The scorers need equal ids for equal tokens, not the tokens.  ``token_lists`` gives, for a column of texts, the
ids of what ``text.mteval_text`` and ``text.tokenize_caption`` find: a class for each byte tells blanks, marks that
stand alone, points, digits and hyphens; a token's id is the difference of two running sums.  Only distinct tokens
with other than ASCII letters are looked at as strings, for their lower case and (caption) their letters and
marks as Python knows them.  Texts go through in pieces of about ``PIECE`` bytes, cut at blanks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together.
PIECE = 1 << 20

_END = b"\xff"  # stands behind each text; no byte of UTF-8
_OTHER, _BLANK, _ALONE, _POINT, _DIGIT, _HYPHEN = range(6)
_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BEYOND = re.compile(r"\w+|\W")

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = int(_random.integers(1, 1 << 62)) * 2 + 1
_EMPTY = np.uint64(0x5851F42D4C957F2D)  # the one token of an empty text


def _classes(alone: bytes, blank: bytes, **more: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(alone + _END)], out[list(blank)] = _ALONE, _BLANK
    for kind, chars in (("point", _POINT), ("digit", _DIGIT), ("hyphen", _HYPHEN)):
        out[list(more.get(kind, b""))] = chars
    return out


_ASCII_SPACE = b" \t\n\x0b\f\r"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MTEVAL = _classes(bytes(c for c in _MARKS if c not in b"'-.,"), _ASCII_SPACE, point=b".,", digit=b"0123456789", hyphen=b"-")
_CAPTION = _classes(bytes(c for c in range(128) if not chr(c).isalnum() and c not in _ASCII_SPACE + b"_'`.?!,:-;"), _ASCII_SPACE + b"'`.?!,:-;")
_WHOLE = _classes(b"", b"")

#: how -> (classes, lower case of ASCII, strings of a token that isn't ASCII, empty text is one token)
KINDS = {"mteval": (_MTEVAL, True, lambda s: [s.lower()], True), "perl": (_MTEVAL, True, None, False), "perl_cased": (_MTEVAL, False, None, False),
         "caption": (_CAPTION, False, _BEYOND.findall, False), "blank": (_CAPTION, False, _BEYOND.findall, True)}

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``_STEP`` and of its inverse; kept for pieces of common size."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, PIECE + 4096)
    made = []
    for step in (_STEP, pow(_STEP, -1, 1 << 64)):
        each = np.full(size, step, np.uint64)
        each[0] = 1
        made.append(np.cumprod(each, dtype=np.uint64))
    if size <= 4 * PIECE:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _spans(text: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a piece, which has a blank at both ends, begin and end (the last byte)."""
    kind = classes[text]
    alone = kind == _ALONE
    at = np.flatnonzero(kind == _POINT)
    if len(at):
        # a run of points: blanks stand around each but for the last before a digit, at an even place behind
        # another character than a digit or at an odd place behind a digit
        new = np.diff(at, prepend=-2) != 1
        first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        last = np.append(new[1:], True)
        odd = (at - first) % 2 == 0
        alone[at] = ~(last & (kind[at + 1] == _DIGIT) & (odd == (kind[first - 1] == _DIGIT)))
    at = np.flatnonzero(kind == _HYPHEN)
    alone[at] = kind[at - 1] == _DIGIT
    blank = kind == _BLANK
    cut = blank | alone
    begin = ~blank
    begin[1:] &= alone[1:] | cut[:-1]
    end = ~blank
    end[:-1] &= alone[:-1] | cut[1:]
    return np.flatnonzero(begin), np.flatnonzero(end)


def _ids(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(len(text))
    terms = _BYTE[text] * up
    sums = np.cumsum(terms, dtype=np.uint64)
    return _mixed((sums[end] - sums[begin] + terms[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _ids_of(strings: list[bytes]) -> np.ndarray:
    text = np.frombuffer(_END.join(strings) + _END, np.uint8)
    end = np.flatnonzero(text == _END[0])
    return _ids(text, np.concatenate([[0], end[:-1] + 1]), end - 1)


def _piece(data: bytes, classes: np.ndarray, beyond) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a piece's tokens, and which of them are ends of texts."""
    text = np.frombuffer(b" " + data + b" ", np.uint8)
    begin, end = _spans(text, classes)
    ids = _ids(text, begin, end)
    stop = text[begin] == _END[0]
    if beyond is None:
        return ids, stop
    high = np.flatnonzero((text >= 128) & (text != _END[0]))
    if not len(high):
        return ids, stop
    here = np.searchsorted(begin, high, side="right") - 1
    here = here[np.diff(here, prepend=-1) != 0]
    _, one, of = np.unique(ids[here], return_index=True, return_inverse=True)
    parts = [beyond(text[begin[k]:end[k] + 1].tobytes().decode("utf-8", "replace")) for k in here[one].tolist()]
    sizes = np.array([len(p) for p in parts])
    made = _ids_of([s.encode() for p in parts for s in p])
    first = np.cumsum(sizes) - sizes
    number = np.ones(len(ids), np.int64)
    number[here] = sizes[of]
    place = np.cumsum(number) - number
    out, stops = np.repeat(ids, number), np.repeat(stop, number)
    many = sizes[of]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(place[here], many) + nth] = made[np.repeat(first[of], many) + nth]
    return out, stops


def _joined(texts: pa.Array) -> bytes:
    cells = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    if any(_END in x for x in cells):  # not UTF-8
        cells = [x.replace(_END, "�".encode()) for x in cells]
    between = b" " + _END + b" "
    return between.join(cells) + between if cells else b""


def token_lists(texts: pa.Array, how: str) -> pa.ListArray:
    """The ids of every text's tokens, in order; null for a null text.  For "caption" and "blank" the texts
    come in lower case."""
    classes, lower, beyond, empty_token = KINDS[how]
    data = _joined(texts)
    if classes is _MTEVAL:
        for old, new in ((b"<skipped>", b""), (b"-\n", b""), (b"&quot;", b'"'), (b"&amp;", b"&"), (b"&lt;", b"<"), (b"&gt;", b">")):
            data = data.replace(old, new)
        data = _SPACES.sub(b" ", data)
    if lower:
        data = data.translate(_LOWER)
    ids, stops, lo = [np.empty(0, np.uint64)], [np.empty(0, bool)], 0
    while lo < len(data):
        hi = len(data)
        if hi - lo > PIECE:
            hi = data.rfind(b" ", lo + 1, lo + PIECE)
            hi = hi if hi > 0 else data.find(b" ", lo + PIECE)
            hi = hi if hi > 0 else len(data)
        a, b = _piece(data[lo:hi], classes, beyond)
        ids.append(a)
        stops.append(b)
        lo = hi
    ids, stop = np.concatenate(ids), np.concatenate(stops)
    at = np.flatnonzero(stop)
    sizes = np.diff(at, prepend=-1) - 1
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    ids = ids[~stop]
    if empty_token:
        bare = np.flatnonzero((sizes == 0) & known)
        if len(bare):
            ids = np.insert(ids, (np.cumsum(sizes) - sizes)[bare], _EMPTY)
            sizes[bare] = 1
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int64)), mask=pa.array(~known))

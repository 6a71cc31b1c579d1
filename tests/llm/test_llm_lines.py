"""Line dedup against a plain count of lines, and its index."""

import random
import re
from collections import Counter

import numpy as np

from pairlab.llm import linededup

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, chunk long, keys string, ids int, found string, shard int"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, least_docs, least_chars=1):
    key = lambda line: line.strip(WHITE).translate(LOW)
    texts = [t or "" for _, t in rows]
    seen = Counter(k for t in texts for k in {key(x) for x in t.split("\n")})
    out = []
    for (i, _), t in zip(rows, texts):
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or seen[key(x)] < least_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(5)
    line = lambda: " ".join(r.choice(["alpha", "Beta", "É", "é", "x", "漢字", "-"]) for _ in range(r.choice([1, 2, 6])))
    rows = [(i, "\n".join(r.choice(["", " "]) + line() + r.choice(["", "\r", " \t"]) for _ in range(r.randint(1, 12)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\n\n \n"), (None, "alpha\nunique to the null id"), (None, "x"), (3, rows[3][1]),
             (3, "x\nother text of a repeated id"), (503, " x \nX\n\x1cx"), (504, "tie\n" * 9 + "tie")]
    rows += [(600 + i, "tie of ten\nShared Footer\r" if i < 10 else "tie of nine\n  shared footer") for i in range(19)]
    rows += [(700, "\n".join(f"line {i} of a long text" for i in range(120_000)) + "\nShared footer"), (701, "y" * 5_000_000)]
    return rows


def run(spark, rows, parts=4, **kw):
    full = [(i, t, "en", 1, "k", 2, "f", 3) for i, t in rows]
    docs = spark.createDataFrame(full, SCHEMA).repartition(parts)
    return sorted((tuple(x) for x in linededup.drop_common_lines(docs, **kw).collect()), key=repr)


def test_same_as_brute_force(spark):
    rows = corpus()
    for least in (2, 10):
        assert run(spark, rows, least_docs=least) == brute(rows, least)
    assert run(spark, rows[:160], parts=1, least_docs=10, least_chars=5) == brute(rows[:160], 10, 5)


def test_many_shards_and_chunks(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(linededup, "SHARD_KEYS", 500)
    monkeypatch.setattr(linededup, "CHUNK_ROWS", 7)
    assert run(spark, rows, least_docs=10) == brute(rows, 10)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_index_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(r.integers(1, 1 << 64, n, dtype=np.uint64))
        x = linededup.CountIndex.build(keys, np.arange(len(keys)) + 1)
        assert sorted(x.hash.index(keys)) == list(range(len(keys)))
        assert (x.count(keys) == np.arange(len(keys)) + 1).all()
        others = np.setdiff1d(r.integers(1, 1 << 64, 5000, dtype=np.uint64), keys)
        assert not x.count(others).any()
        assert len(x.hash.words) * 64 <= 6 * len(keys) + 1024


def test_key_hashes_mark_short_keys():
    assert list(linededup.key_hashes([b"", b"a", "é".encode()], 1) != 0) == [False, True, True]
    assert list(linededup.key_hashes([b"a", "é".encode(), b"ab"], 2) != 0) == [False, False, True]
    assert linededup.line_keys("  AÉ \r\n\x0bb".encode()) == ["aÉ".encode(), b"b"]
    assert re.fullmatch(r"\d+", str(linededup.key_hashes([b"q"])[0]))

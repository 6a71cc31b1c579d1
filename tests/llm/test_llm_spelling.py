"""Spelling variants against a comparison of all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from pairlab.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, m int, form string, root string, part string"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: sorted((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 5 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n), key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    syllables = ["ab", "ba", "an", "na", "é", "ße", "a", "b", "nn"]
    base = ["".join(r.choice(syllables) for _ in range(r.randint(3, 8))) for _ in range(250)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = r.choice(base[:20]) if r.random() < 0.6 else r.choice(base)
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1:], w[:at] + r.choice("abné") + w[at:], w[:at] + r.choice("abné") + w[at + 1:]])
            words.append(r.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, r.choice([" ", "-", "1", "\n"]).join(words)))
    chain = [("kettle", 5), ("kettles", 25), ("kettless", 125), ("kattless", 625)]
    rows += [(900 + j, " ".join([w] * c)) for j, (w, c) in enumerate(chain)]
    rows += [(1000, None), (1001, ""), (None, "abanab " * 30), (7, rows[7][1]), (1002, "x" * 40 + " 漢字漢字漢字 ÀÀÀÀÀÀ×÷ " * 9)]
    rows += [(1003, " ".join(r.choice(base) for _ in range(400_000)))]
    return rows


def run(spark, rows):
    full = [(i, t, "w", 1, 2, "f", "r", "p") for i, t in rows]
    done = spelling.variants(spark.createDataFrame(full, SCHEMA).repartition(4))
    assert done.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(x) for x in done.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_same_as_all_pairs(spark, rows):
    expected = brute(rows)
    assert any(x[2] != (x[1] or x[0]) for x in expected) and sum(x[4] for x in expected) > 50
    assert run(spark, rows) == expected


def test_families_of_many_blocks(spark, rows, monkeypatch):
    for name, value in (("TILE", 5), ("BLOCK", 7), ("STRIP", 3), ("HELD", 50), ("PIECE", 1000)):
        monkeypatch.setattr(spelling, name, value)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_near_is_exactly_one_edit():
    r = random.Random(2)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(300)} | {"漢字漢字", "漢字字漢"})
    hits = {(words[lo + i], words[j]) for lo, hit, _, _ in spelling.near(words, words) for i, j in zip(*hit.nonzero())}
    assert hits == {(a, b) for a in words for b in words if one_edit(a, b)}

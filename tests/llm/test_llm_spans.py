"""Sentence spans against a plain restatement, with odd rows."""

import random

import numpy as np

from pairlab.llm import spandedup
from pairlab.llm.common import word_hashes
from test_llm_docs import LOW, WORD, corpus, frame


def ends(word):
    data = np.frombuffer(word.translate(LOW).encode(), np.uint8)
    h = word_hashes(data, np.array([0]), np.array([len(data)]))
    return word[-1] in ".!?;:,|" or int(h[0]) % spandedup.CUT == 0


def plain_sentences(text):
    """[(start, words)] of a text."""
    out, now = [], []
    found = list(WORD.finditer(text or ""))
    for i, m in enumerate(found):
        now.append(m)
        after = text[m.end():found[i + 1].start()] if i + 1 < len(found) else "\n"
        if ends(m[0]) or "\n" in after:
            out.append((now[0].start(), [x[0].translate(LOW) for x in now]))
            now = []
    return out


def plain_removed(rows):
    seen, out = {}, []
    for i, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        s = plain_sentences(text)
        gone = set()
        for a in range(len(s)):
            words = []
            for b in range(a, len(s)):
                words += s[b][1]
                if b - a + 1 >= spandedup.MIN_SENTENCES and len(words) >= spandedup.MIN_WORDS:
                    if seen.setdefault(tuple(words), (i, text, a)) != (i, text, a):
                        gone |= set(range(a, b + 1))
                    break
        edges = [x[0] for x in s] + [len(text or "")]
        kept = "".join([(text or "")[:edges[0]], *((text or "")[edges[k]:edges[k + 1]] for k in range(len(s)) if k not in gone)])
        out.append((i, len(s), len(gone), kept))
    return out


def passages(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopü") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", ",", ".", "\n"])
    shared = [" ".join(word() for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(60):
        body = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(2)]
        rows.append((i, shared[i % 5].join(body) if i % 3 == 0 else " ".join(body), "s"))
    return rows, shared


def test_spans_are_the_plain_ones(spark):
    rows, shared = passages()
    rows += [x for x in corpus(seed=2, n=30) if x[0] is None or x[0] > 100]
    rows += [(300, "Again and again. " * 40, "s"), (301, "é.\n" * 50 + "x", "s")]
    texts = {i: t for i, t, _ in rows}
    got = spandedup.repeated_spans(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    cut = {r.doc_id: spandedup.cut_out(texts[r.doc_id], [(x.start, x.end) for x in r.removed]) or "" for r in got}
    expected = plain_removed(rows)
    assert {r.doc_id: (r.n_sentences, r.n_removed, cut[r.doc_id]) for r in got} == {i: tuple(x) for i, *x in expected}
    found = {r.doc_id: r for r in got}
    for i in range(15, 60, 3):  # each shared passage stands first in one of the documents 0, 3, 6, 9, 12
        assert found[i].n_removed > 0 and i % 15 in found[i].first_ids
    assert all(not found[i].removed for i in range(60) if i % 3)


def test_repeated_rows(spark):
    rows, _ = passages()
    got = spandedup.repeated_spans(frame(spark, [rows[1], rows[1]])).collect()
    long = [r for r in got if r.n_sentences > 5]
    assert len(got) == 2 and sorted(r.n_removed > 0 for r in long) in ([], [False, True])


def test_empty(spark):
    assert spandedup.repeated_spans(frame(spark, [])).count() == 0

"""Scores from gram vectors against plain counting, with instances cut into groups of references."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import scores as S
from pairlab.operators import vectors as V

TEXTS = "inst_id long, ref_no int, text string, n int, id string, prefix string"


def corpus(systems=1, seed=1):
    r = random.Random(seed)
    words = ["the"] * 6 + ["a", "b", "cat", "sat", "é", "漢字", "on"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = []
    for i in range(30):
        rows += [(i, -k, text(r.choice([0, 1, 3, 9, 40]))) for k in range(1, systems + 1)]
        rows += [(i, k, text(r.choice([0, 1, 4, 12, 30]))) for k in range(r.choice([1, 2, 5, 9]))]
    rows += [(100, -1, "no reference"), (101, 0, "no system the cat"), (102, -1, ""), (102, 0, ""), (None, -1, "the cat sat"),
             (None, 0, "the cat sat on"), (103, -1, text(20_000)), (103, 0, text(20_000))]
    rows += [(104, -k, text(12)) for k in range(1, systems + 1)] + [(104, k, text(10)) for k in range(60)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*x, 1, "i", "p") for x in rows], TEXTS).repartition(parts)


def grams(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def plain(rows, max_n, empty_token, systems=1):
    """Statistics of every (instance, system) by counting tuples."""
    toks = lambda t: t.split(" ") if empty_token or t else []
    refs, outputs = {}, {}
    for i, k, t in rows:
        if k < 0:
            outputs[i, -k] = toks(t)
        else:
            refs.setdefault(i, []).append(toks(t))
    total = Counter(g for rs in refs.values() for r in rs for n in range(1, max_n + 1) for g in grams(r, n).elements())
    words = sum(len(r) for rs in refs.values() for r in rs)
    info = {g: math.log2((total[g[:-1]] if len(g) > 1 else words) / c) for g, c in total.items()}
    out = {}
    for (i, k), s in outputs.items():
        rs = refs.get(i)
        if not rs:
            continue
        own = Counter(g for r in rs for n in range(1, max_n + 1) for g in grams(r, n).elements())
        inner = {g: math.log2((own[g[:-1]] if len(g) > 1 else sum(map(len, rs))) / c) for g, c in own.items()}
        hits, bits, bits_ref, bits_own = [], [], [], []
        for n in range(1, max_n + 1):
            most = Counter()
            for r in rs:
                most |= grams(r, n)
            h = grams(s, n) & most
            hits.append(sum(h.values()))
            bits.append(sum(c * info[g] for g, c in h.items()))
            bits_own.append(sum(c * inner[g] for g, c in h.items()))
            bits_ref.append(sum(info[g] for r in rs for g in grams(r, n)))
        size = [len(r) for r in rs]
        near = lambda x: min(x, key=lambda v: (abs(v - len(s)), v), default=0)
        out[i, k] = dict(hits=hits, bits=bits, bits_ref=bits_ref, bits_own=bits_own, sys_len=len(s), n_refs=len(size), nrefs=sum(v > 0 for v in size),
                         closest=near(size), closest_nz=near([v for v in size if v]), shortest=min(size), ref_len_sum=sum(size),
                         ref_count=[sum(max(v - n + 1, 0) for v in size) for n in range(1, max_n + 1)])
    return out


@pytest.fixture(params=[(64, 1 << 18, 1 << 16), (4, 50, 5)], ids=["usual", "small groups, blocks and hot table"])
def sizes(request, monkeypatch):
    for name, value in zip(("REF_BLOCK", "BLOCK_TOKENS", "HOT_GRAMS"), request.param):
        monkeypatch.setattr(V, name, value)
    monkeypatch.setattr(V.hottest, "__defaults__", (request.param[2],))


@pytest.mark.parametrize("how,empty", [("mteval", True), ("caption", False)])
def test_instance_statistics(spark, sizes, how, empty):
    rows = corpus(systems=2)
    want = plain(rows, 4, empty)
    got = S.Stats(None, None, 4, how, texts=frame(spark, rows), systems=2).instances(info=True).collect()
    assert {(r.inst_id, r.sys_no) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r.inst_id, r.sys_no]
        for c in ("hits", "ref_count", "sys_len", "n_refs", "nrefs", "closest", "closest_nz", "shortest", "ref_len_sum"):
            assert r[c] == w[c], (r.inst_id, r.sys_no, c)
        assert np.allclose(r["info"], w["bits_own"])


def test_information_of_corpus_and_segments(spark, sizes):
    rows = corpus(systems=2)
    want = plain(rows, 3, False)
    st = S.Stats(None, None, 3, "perl", texts=frame(spark, rows), systems=2)
    seg = {(r.inst_id, r.sys_no, r.n): r for r in S.perl_segment_stats(st).collect()}
    assert len(seg) == 3 * len(want)
    for (i, k), w in want.items():
        for n in range(1, 4):
            r = seg[i, k, n]
            assert (r["match"], r.ref_count, r.tst_count) == (w["hits"][n - 1], w["ref_count"][n - 1], max(w["sys_len"] - n + 1, 0))
            assert math.isclose(r.tst_info, w["bits"][n - 1], abs_tol=1e-6) and math.isclose(r.ref_info, w["bits_ref"][n - 1], abs_tol=1e-6)
    info = {(r.n, r.sys_no): r for r in V.corpus_info(st.rows, 3, 2).collect()}
    for n in range(1, 4):
        for k in (1, 2):
            assert math.isclose(info[n, k].tst_info, sum(w["bits"][n - 1] for (i, s), w in want.items() if s == k), abs_tol=1e-6)


def test_levels_of_two_systems(spark, sizes):
    rows = corpus(systems=2)
    st = lambda: S.Stats(None, None, 4, "perl", texts=frame(spark, rows), systems=2)
    lv = S.score_levels(None, None, F.col("inst_id") % 3, 4, stats=st()).collect()
    whole = {r.sys_no: r for r in lv if r.level == "system"}
    corpus_ = {r.sys_no: r for r in S.perl_scores(None, None, 4, stats=st()).collect()}
    assert set(whole) == {1, 2} == set(corpus_)
    for k in (1, 2):
        assert math.isclose(whole[k].bleu_cum_4, corpus_[k].bleu_cum_4) and math.isclose(whole[k].nist_cum_4, corpus_[k].nist_cum_4, rel_tol=1e-9)
    pairs = plain(rows, 1, False)
    assert sum(r.level == "segment" for r in lv) == len(pairs)
    assert {(r.sys_no, r.doc) for r in lv if r.level == "document"} == {(k, None if i is None else i % 3) for i, k in pairs}


def test_cider_against_plain_counting(spark, sizes):
    rows = corpus()
    refs, outputs = {}, {}
    for i, k, t in rows:
        if k < 0:
            outputs[i] = t.split()
        else:
            refs.setdefault(i, []).append(t.split())
    df = Counter(g for rs in refs.values() for g in {g for r in rs for n in range(1, 5) for g in grams(r, n)})
    vec = lambda t, n: {g: c * (math.log(len(outputs)) - math.log(max(df[g], 1))) for g, c in grams(t, n).items()}
    got = {r.inst_id: r.cider for r in S.cider(None, None, stats=S.Stats(None, None, 4, "caption", texts=frame(spark, rows))).collect()}
    assert set(got) == set(refs) & set(outputs)
    for i in got:
        s, total = outputs[i], 0.0
        for r in refs[i]:
            pen = math.exp(-(max(len(s) - 1, 0) - max(len(r) - 1, 0)) ** 2 / 72)
            for n in range(1, 5):
                h, v = vec(s, n), vec(r, n)
                dot = sum(min(h[g], v[g]) * v[g] for g in h if g in v)
                norm = math.sqrt(sum(x * x for x in h.values())) * math.sqrt(sum(x * x for x in v.values()))
                total += (dot / norm if norm else dot) * pen
        assert math.isclose(got[i], total / 4 / len(refs[i]) * 10, rel_tol=1e-9, abs_tol=1e-9), i


def test_empty_tables(spark):
    st = S.Stats(None, None, 4, texts=frame(spark, [], 1))
    assert st.instances().count() == 0 and S.bleu_segment(None, None, stats=st).count() == 0
    assert S.cider(None, None, stats=S.Stats(None, None, 4, "caption", texts=frame(spark, [], 1))).count() == 0


def test_nothing_in_common(spark):
    """Blocks whose system outputs share no gram with any reference."""
    st = lambda how: S.Stats(None, None, 4, how, texts=frame(spark, [(1, -1, "a b c d e"), (1, 0, "v w x y z"), (2, -1, ""), (2, 0, "q")], 1))
    assert sorted(r.cider for r in S.cider(None, None, stats=st("caption")).collect()) == [0.0, 0.0]
    assert [r.tst_info for r in S.perl_segment_stats(st("perl")).collect()] == [0.0] * 8
    assert S.bleu_corpus(None, None, stats=st("mteval")).first().bleu < 1e-3 and S.nist_corpus(None, None, 4, stats=st("mteval")).first().nist in (0.0, None)


def test_exchanges_of_the_scores(spark):
    """Texts by instance, grams, prefixes: three hash exchanges, and no gram string in any (groups of further
    references are dealt by instance too; by n go the sums of each order, a few rows a task)."""
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    rows = frame(spark, corpus())
    hashed = lambda d: {x.split("hashpartitioning(")[1].split("#")[0] for x in plan(d).splitlines() if "hashpartitioning(" in x}
    assert hashed(S.bleu_corpus(None, None, stats=S.Stats(None, None, 4, texts=rows))) <= {"inst_id"}
    assert hashed(S.nist_corpus(None, None, stats=S.Stats(None, None, 5, texts=rows))) <= {"inst_id", "id", "key", "n"}


def test_texts_go_to_python_without_nested_columns(spark):
    """A null struct of arrays cost more in each row than the text beside it (``evaluate_runs`` took most of its time so)."""
    rows = V.by_instance(frame(spark, [(1, -1, "a"), (1, 0, "a b"), (1, 70, "a c")], 1), "mteval", 2)
    assert rows.schema["merged"].dataType.simpleString() == "binary"
    cells = {r.ref_no: V._read_row(bytes(r.merged)) for r in rows.collect() if r.merged is not None}
    assert list(cells) == [1] and cells[1]["lens"].tolist() == [2] and cells[1]["n"].tolist() == [1, 1, 2]
    assert [x.tolist() for x in V._read_row(V._merged_row(*[np.empty(0, np.int64)] * 2)).values()] == [[]] * 8

"""METEOR's alignment and ROUGE-L in blocks of whole instances: against the definition, and without windows or joins by token."""

import random
from collections import defaultdict

import numpy as np

from pairlab.functions import text as T
from pairlab.operators import scores as S
from pairlab.operators import vectors as V
from pyspark.sql import functions as F


def _plain(refs, sys):
    """(inst, ref_no, matches, chunks) from the definition; rows of equal keys are one text."""
    hyp, ref = defaultdict(list), defaultdict(list)
    for i, t in sys:
        hyp[i] += list(enumerate(t.split()))
    for i, no, t in refs:
        ref[i, no] += list(enumerate(t.split()))
    out = {}
    for (i, no), r in ref.items():
        places = defaultdict(list)
        for p, t in sorted(hyp[i]):
            places[t].append(p)
        seen, pairs = defaultdict(int), []
        for p, t in sorted(r):
            if seen[t] < len(places[t]):
                pairs.append((places[t][seen[t]], p))
            seen[t] += 1
        pairs.sort()
        chunks = sum(1 for k, (h, p) in enumerate(pairs) if not k or pairs[k - 1] != (h - 1, p - 1))
        out[i, no] = (len(pairs), chunks)
    return out


def test_alignments_equal_the_definition(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    refs, sys = [], []
    for i in range(60):
        sys.append((i, some(rng.randrange(0, 30))))
        refs += [(i, no, some(rng.randrange(0, 30))) for no in range(rng.choice([1, 2, 3, 70]))]
    refs += [(0, 0, "a b a"), (100, 0, "a b"), (None, 0, "a")]  # a repeated reference, one without an output, no key
    sys += [(200, "a b"), (None, "a")]
    r = spark.createDataFrame(refs, "inst_id long, ref_no int, ref string")
    s = spark.createDataFrame(sys, "inst_id long, sys string")
    want = _plain(*([x for x in rows if x[0] is not None and x[0] < 100] for rows in (refs, sys)))
    stats = S.meteor_stats(r, s)
    got = {(x.inst_id, x.ref_no): (x.matches, x.chunks) for x in stats.collect()}
    assert got == want
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # no row a token leaves a task


def test_equal_keys_give_a_row_for_each_pair(spark):
    r = spark.createDataFrame([(1, 0, "a b"), (1, 0, "a b"), (1, None, "a b")], "inst_id long, ref_no int, ref string")
    s = spark.createDataFrame([(1, "a b"), (1, "a b")], "inst_id long, sys string")
    got = sorted((x.ref_no is None, x.rlen, x.hlen, x.matches, x.chunks) for x in S.meteor_stats(r, s).collect())
    assert got == [(False, 2, 2, 4, 3)] * 4 + [(True, 2, 2, 0, 0)] * 2
    assert [x.rouge_l for x in S.rouge_l(r, s).collect()] == [1.0]


def test_rows_are_sorted_with_and_without_packing():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 5, 300) for _ in range(3)]
    for scale in (1, 1 << 40):
        got = V.in_order(columns[0] * scale, columns[1], columns[2] * scale)
        want = sorted(zip(*(c.tolist() for c in (columns[0] * scale, columns[1], columns[2] * scale))))
        assert list(zip(*(c.tolist() for c in got))) == want
    assert [len(c) for c in V.in_order(*(c[:0] for c in columns))] == [0, 0, 0]


def test_caption_tokens_are_those_of_the_list(spark):
    odd = "It's a--b ... `x` \"y\" -LRB- é_1 ½ Σας İ;\n a,b:c!d?e.f ­ ‘q’ #$%^ ''z'' A\tB\u0085C D"
    toks = F.regexp_extract_all(F.lower(F.regexp_replace("t", "\n", " ")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0)
    drop = F.array(*[F.lit(p) for p in T.CAPTION_PUNCT])
    old = F.array_join(F.filter(toks, lambda t: ~F.array_contains(drop, t)), " ")
    row = spark.createDataFrame([(odd,)], "t string").select(old.alias("old"), T.tokenize_caption(F.col("t")).alias("new")).first()
    assert row.old == row.new

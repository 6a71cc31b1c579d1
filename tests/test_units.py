"""Unit tests on hand-made rows: formulas restated in plain Python, traps, helpers."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from pairlab.operators import mr as M
from pairlab.operators import noise as N
from pairlab.operators import runs as R
from pairlab.operators import scores as S
from pairlab.plans import fixtures as fx


def _pairs(spark, rows):
    refs = spark.createDataFrame([(i, j, r) for i, rs, _ in rows for j, r in enumerate(rs)],
                                 "inst_id long, ref_no int, ref string")
    sys = spark.createDataFrame([(i, s) for i, _, s in rows], "inst_id long, sys string")
    return refs, sys


def _py_bleu(rows, max_n=4):
    """Plain restatement of the published corpus BLEU (floors 1e-15 / 1e-9)."""
    hits, cand, rl = [0] * max_n, [0] * max_n, 0
    for _, refs, sys in rows:
        s = sys.lower().split(" ")
        rs = [r.lower().split(" ") for r in refs]
        for n in range(1, max_n + 1):
            sc = Counter(tuple(s[i:i + n]) for i in range(len(s) - n + 1))
            mx = Counter()
            for r in rs:
                for g, c in Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1)).items():
                    mx[g] = max(mx[g], c)
            hits[n - 1] += sum(min(c, mx[g]) for g, c in sc.items())
            cand[n - 1] += len(s) - n + 1
        rl += min((abs(len(r) - len(s)), len(r)) for r in rs)[1]
    bp = math.exp(1 - rl / cand[0]) if cand[0] <= rl else 1.0
    return bp * math.exp(sum(math.log(max(h, 1e-15) / max(c, 1e-9)) for h, c in zip(hits, cand)) / max_n)


ROWS = [(1, ["the cat sat on the mat", "a cat was on the mat"], "the cat sat on a mat"),
        (2, ["there is a dog here"], "a dog is here"),
        (3, ["one two three four five"], "one two three four five")]


def test_bleu_matches_plain_python(spark):
    refs, sys = _pairs(spark, ROWS)
    got = S.bleu_corpus(refs, sys).collect()[0]["bleu"]
    assert abs(got - _py_bleu(ROWS)) < 1e-9


def test_identical_is_one(spark):
    refs, sys = _pairs(spark, [(1, ["a b c d e f"], "a b c d e f")])
    assert abs(S.bleu_corpus(refs, sys).collect()[0]["bleu"] - 1.0) < 1e-12
    assert abs(S.rouge_l(refs, sys).collect()[0]["rouge_l"] - 1.0) < 1e-12


def test_row_order_does_not_change_score(spark):
    refs, sys = _pairs(spark, ROWS)
    a = S.bleu_corpus(refs, sys).collect()[0]["bleu"]
    b = S.bleu_corpus(refs.orderBy(F.desc("inst_id")), sys.orderBy(F.desc("inst_id"))).collect()[0]["bleu"]
    assert a == b


def _dp_lcs(a, b):
    L = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            L[i][j] = L[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(L[i - 1][j], L[i][j - 1])
    return L[-1][-1]


def test_lcs_bit_parallel_equals_dp():
    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 60))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 60))]
        assert S._lcs_len(a, b) == _dp_lcs(a, b)


def test_rouge_l_against_brute_force(spark):
    rows = [(1, ["the cat sat on the mat", "a cat on a mat"], "the cat is on the mat"),
            (2, ["x y z"], "")]
    refs, sys = _pairs(spark, rows)
    got = {r["inst_id"]: r["rouge_l"] for r in S.rouge_l(refs, sys).collect()}
    for i, rs, s in rows:
        c = s.split(" ")
        p = max(_dp_lcs(r.split(" "), c) / len(c) for r in rs)
        rc = max(_dp_lcs(r.split(" "), c) / len(r.split(" ")) for r in rs)
        want = ((1 + 1.44) * p * rc / (rc + 1.44 * p)) if p and rc else 0.0
        assert abs(got[i] - want) < 1e-12


def test_each_fragment_yields_its_value():
    """Every fixture fragment, checked alone against its own gold value, keeps exactly it."""
    for s, frags in enumerate(fx.FRAGMENTS):
        slot = fx.NORM_SLOTS[s]
        for value, frag in frags.items():
            kept = N.find_spans(frag + ".", [(slot, value)])["kept"]
            assert [(k["slot"], k["value"]) for k in kept] == [(slot, value)], (frag, kept)


def test_tie_drops_both_when_both_gold():
    """The Rice Boat as name and near: both spans tie with a gold value and drop."""
    ref = "The Rice Boat is a venue, it is near The Rice Boat."
    kept = N.find_spans(ref, [("name", "The Rice Boat"), ("near", "The Rice Boat")])["kept"]
    assert kept == []


def test_stale_count_trap():
    """The reference's count uses the value left over from its loop ('low')."""
    ref = "it has a low customer rating, it has a low customer rating"
    out = N.find_spans(ref, [("rating", "low")])
    assert len(out["kept"]) == 2
    assert out["ref_counts"] == [{"slot": "rating", "value": "low", "n": 2}]
    ref2 = "it is a pub and a pub"
    out2 = N.find_spans(ref2, [("eat_type", "pub")])
    assert out2["ref_counts"] == [{"slot": "eat_type", "value": "pub", "n": 1}]


def _counts(*items):
    return F.array(*[F.struct(F.lit(a).alias("slot"), F.lit(b).alias("value"), F.lit(n).alias("n")) for a, b, n in items])


def test_partial_fix_types(spark):
    gold = _counts(("area", "city centre", 1), ("food", "French", 1))
    out = _counts(("area", "riverside", 1), ("eat_type", "pub", 1))
    one = spark.range(1)
    for kind, want in (("all", (1, 1, 1)), ("missing", (0, 2, 0)), ("added", (2, 0, 0))):
        r = N.compared(one, gold, out, kind).first()
        assert (r.added, r.missing, r.valerr, r.repeated) == (*want, 0)
        fixed = {(x["slot"], x["value"]): x["fixed"] for x in r["items"]}
        assert fixed == {("area", "city centre"): int(kind == "added"), ("food", "French"): int(kind == "added"),
                         ("area", "riverside"): int(kind != "missing"), ("eat_type", "pub"): int(kind != "missing")}


def test_repeats_and_ignored_additions(spark):
    gold, out = _counts(("area", "riverside", 1)), _counts(("area", "riverside", 3), ("area", "city centre", 1))
    r = spark.range(1)
    a = N.compared(r, gold, out).first()
    assert (a.repeated, a.added, a.missing, a.valerr) == (2, 1, 0, 0)
    assert {x["value"]: (x["fixed"], x["d"]) for x in a["items"]} == {"riverside": (1, 0), "city centre": (1, 1)}
    kept = N.compared(r, gold, out, "missing").first()
    raised = N.compared(r, gold, out, "missing", reference_counts=True).first()
    assert [x["fixed"] for x in kept["items"]] == [1, 0] and [x["fixed"] for x in raised["items"]] == [1, 2]


def test_spans_inside_and_equal_spans():
    rows = lambda s, g: [(k["slot"], k["value"]) for k in N.find_spans(s, g)["kept"]]
    hits = [("a", "x", 0, 5), ("b", "y", 2, 5), ("c", "z", 0, 5), ("d", "w", 5, 6), ("e", "v", 4, 7)]
    assert N._standing(hits, set()) == [hits[0], hits[4]]
    assert N._standing(hits, {("c", "z")}) == [hits[2], hits[4]]
    assert N._standing(hits, {("a", "x"), ("c", "z")}) == [hits[4]]
    assert rows("", []) == []


def test_mr_round_trip(spark):
    mrs = ["name[Aromi], eatType[pub], customer rating[low], familyFriendly[yes]",
           "name[The Eagle], priceRange[£20-25], area[riverside], near[Café Rouge]"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mrs)], "inst_id long, mr string")
    back = {r["inst_id"]: r["mr"] for r in M.mr_render(M.mr_counts(df)).collect()}
    assert back == dict(enumerate(mrs))


def test_rank_within_equals_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaaaab"), rnd.random(), f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s double, v string")
    got = {r["v"]: r["rank"] for r in R.rank_within(df, "g", [F.col("s").desc(), F.col("v")], parts=7).collect()}
    want = {}
    for g in "ab":
        ordered = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1], r[2]))
        want.update({r[2]: i + 1 for i, r in enumerate(ordered)})
    assert got == want


def test_stopwords_match_spark(spark):
    from pyspark.ml.feature import StopWordsRemover
    from pairlab.functions.stopwords import ENGLISH
    assert ENGLISH == StopWordsRemover.loadDefaultStopWords("english")

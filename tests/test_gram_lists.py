"""Lists of grams are made in the row of a key's texts; no gram passes an aggregation, a sort or an exchange."""

from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from pairlab.operators import ngrams as G
from pairlab.plans import q_scores
from conftest import SF

ROWS = [(1, 0, "a b a b a"), (1, 0, "a b"), (1, 1, "b a b"), (2, 0, ""), (3, 0, "é \x01 a"), (None, 0, "a"), (4, None, "x y"), (5, 0, None)]


def _grams(txt, n, empty_token=True):
    t = txt.split(" ") if txt or empty_token else []
    return Counter(" ".join(t[i:i + n]) for i in range(len(t) - n + 1))


@pytest.mark.parametrize("empty_token", [True, False])
def test_lists_equal_the_definition(spark, empty_token):
    df = spark.createDataFrame(ROWS, "inst_id long, ref_no int, txt string")
    want = {}
    for i, no, t in ROWS:
        for n in range(1, 4) if t is not None else ():
            want.setdefault((i, no, n), Counter()).update(_grams(t, n, empty_token))
    want = {k: c for k, c in want.items() if c}
    got = {(r.inst_id, r.ref_no, r.n): r for r in G.gram_lists(df, ["inst_id", "ref_no"], 3, empty_token=empty_token).collect()}
    assert {k: r.lines for k, r in got.items()} == {k: "\n".join(f"{g}\t{c[g]}" for g in sorted(c)) for k, c in want.items()}
    assert all((r.n_grams, r.total) == (len(want[k]), sum(want[k].values())) for k, r in got.items())
    rows = Counter({(r.inst_id, r.ref_no, r.n, r.gram): r.cnt for r in G.gram_counts(df, ["inst_id", "ref_no"], 3, empty_token=empty_token).collect()})
    assert rows == Counter({(*k, g): c[g] for k, c in want.items() for g in c})
    most = {}
    for (i, _, n), c in want.items():
        most[i, n] = most.get((i, n), Counter()) | c
    got = {(r.inst_id, r.n): r.lines for r in G.ref_max_lists(df, 3, empty_token=empty_token).collect()}
    assert got == {k: "\n".join(f"{g}\t{c[g]}" for g in sorted(c)) for k, c in most.items()}
    assert G.gram_lists(df.where(F.lit(False)), ["inst_id"], 3).count() == 0


@pytest.mark.parametrize("name", ["ngram_counts", "ref_max_counts"])
def test_no_gram_is_aggregated(spark, name):
    plan = getattr(q_scores, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate" in line]
    assert groups and not any("gram" in line for line in groups)


@pytest.mark.parametrize("held", [1, 1 << 20])
@pytest.mark.parametrize("empty_token", [True, False])
def test_document_frequencies_equal_the_definition(spark, monkeypatch, empty_token, held):
    monkeypatch.setattr(G, "HELD_GRAMS", held)
    df = spark.createDataFrame([*ROWS, (6, 0, "a b a"), (6, 1, "b a"), (None, 1, "a b")], "inst_id long, ref_no int, txt string")
    mine = {}
    for i, _, t in [tuple(r) for r in df.collect()]:
        for n in range(1, 4) if t is not None else ():
            mine.setdefault((i, n), set()).update(_grams(t, n, empty_token))
    want = {}
    for (_, n), grams in mine.items():
        for g in grams:
            want.setdefault((n, md5(g.encode()).hexdigest()[:3]), Counter())[g] += 1
    got = {(r.n, r.part): r for r in G.doc_freq_lists(df, 3, empty_token=empty_token).collect()}
    assert {k: r.lines for k, r in got.items()} == {k: "\n".join(f"{g}\t{c[g]}" for g in sorted(c)) for k, c in want.items()}
    assert all((r.n_grams, r.total) == (len(want[k]), sum(want[k].values())) for k, r in got.items())
    assert G.doc_freq_lists(df.where(F.lit(False)), 3).count() == 0


def test_document_frequencies_take_one_exchange_of_grams(spark):
    plan = q_scores.ngram_doc_freq(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate" in line or "RepartitionByExpression" in line]
    assert groups and not any("gram#" in line for line in groups)


@pytest.mark.parametrize("empty_token", [True, False])
def test_information_lists_equal_the_rows(spark, empty_token):
    df = spark.createDataFrame([*ROWS, (6, 0, "a b a"), (6, 1, "b a"), (7, 0, "a  b")], "inst_id long, ref_no int, txt string")
    want = {}
    rows = G.ngram_info(G.gram_counts(df, ["inst_id", "ref_no"], 3, empty_token=empty_token)).collect()
    for r in sorted(rows, key=lambda r: r.gram.encode()):
        want.setdefault((r.n, md5(r.gram.encode()).hexdigest()[:3]), []).append(r)
    got = {(r.n, r.part): r for r in G.info_lists(df, 3, empty_token).collect()}
    assert set(got) == set(want) and len(rows) == sum(r.n_grams for r in got.values())
    for k, of in want.items():
        assert got[k].totals == "\n".join(f"{r.gram}\t{r.tot}" for r in of) and got[k].wholes == "\n".join(f"{r.gram}\t{r.whole}" for r in of)
        assert abs(got[k].info - sum(r.info for r in of)) < 1e-9
    assert G.info_lists(df.where(F.lit(False)), 3).count() == 0


@pytest.mark.parametrize("name", ["ngram_info", "cider"])
def test_no_gram_is_joined(spark, name):
    plan = getattr(q_scores, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and ("gram#" in line or " id#" in line or "key#" in line) for line in plan.splitlines())


def test_long_grams_travel_as_one_run_of_words(spark, monkeypatch):
    """A run of words a place, whatever the orders (``ngram_info`` sent a gram and its prefix for each), also in small lots."""
    df = spark.createDataFrame([*ROWS, (6, 0, "a b a b a c"), (7, 0, "a  b"), (8, 0, "b a b a c d e")], "inst_id long, ref_no int, txt string")
    key = lambda r: (r.n, r.part)
    want = sorted(G.info_lists(df, 5).collect(), key=key)
    monkeypatch.setattr(G, "HELD_GRAMS", 3)
    assert sorted(G.info_lists(df, 5).collect(), key=key) == want
    runs = G._Windows(5)
    assert list(runs.taken("a b a b a c")) != [] and not runs.words
    monkeypatch.setattr(G, "HELD_GRAMS", 100)
    assert list(runs.taken("a b a b a b a")) == []
    sent = [x for rows in runs.dealt().values() for x in rows]
    assert sorted(sent) == sorted([(b"a b a b a", 5, 2), (b"b a b a b", 5, 1), (b"b a b a", 4, 1), (b"a b a", 3, 1), (b"b a", 2, 1)])

"""Tests of round 3: whole jobs, and faster forms against the definitions they replace."""

import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from pairlab.functions import text as T
from pairlab.operators import noise as N
from pairlab.operators import scores as S
from pairlab.operators import vectors as V


def test_images_by_category_has_images_of_every_number(spark, tmp_path):
    rows = [(c, t, role, "x") for c in range(12) for t, role in enumerate(("system", "user", "assistant")[:2 if c == 7 else 3])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.image_id for r in E.queries()["images_by_category"](spark, str(tmp_path)).collect()}
    assert got == set(range(12)) - {7}  # 0, 3, 6, 9 were left out before


def test_13a_tokens_follow_the_definition(spark):
    def plain(s):
        s = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
        for old, new in T.MTEVAL_ENTITIES:
            s = s.replace(old, new)
        s = re.sub(r"([\{-~\[-` -&\(-\+:-@/])", r" \1 ", f" {s} ")
        s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
        s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
        s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
        return re.sub("[\t-\r \x85\xa0  -     　]+", " ", s).strip(" ")

    r = random.Random(3)
    some = [*"a5.,- ", "..", ",,,", "$", "\t", "\r", "\n", "\x1c", "\x85", "\xa0", " ", "　", "é", "😀", "&quot;", "<skipped>"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.normalize_mteval(F.col("s")).alias("t")).collect()
    assert [x.t for x in got] == [plain(x.s) for x in got]
    # no step touches single blanks any more: before, every blank was matched and replaced twice
    assert not re.search(T.MTEVAL_PUNCT, "a b") and not re.search(T.MTEVAL_SPACE, "a b")


def test_alternatives_are_run_only_beside_all_their_strings(monkeypatch):
    run, phrase = [], N._phrase
    monkeypatch.setattr(N, "_phrase", lambda i, which: run.append(N.phrases()[i].slot) or phrase(i, which))
    assert "name" in {slot for slot, _, _, _ in N.matches("Clowns has a low price")}
    # "low" stands there but no word for a rating does: before, the patterns of low ratings were run all the same
    assert run and "rating" not in run


def test_spans_column_equals_the_plain_function(spark):
    refs = ["The Rice Boat is near The Rice Boat, it is rated 5 out of 5.", "", None, "a cheap pub in the riverside area"]
    rows = [(r, ["name\tThe Rice Boat", "area\triverside"] if i % 2 else None) for i, r in enumerate(refs)]
    got = spark.createDataFrame(rows, "ref string, gold array<string>").coalesce(1).select(N._spans_udf("ref", "gold").alias("s")).collect()
    want = [N.find_spans(r, [x.split("\t", 1) for x in g or []]) for r, g in rows]
    assert [x.s.asDict(True) for x in got] == want


def test_corpus_information_takes_one_exchange(spark):
    words = ["the", "cat", "sat", "on", "a", "mat"]
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, k, text(r.choice([0, 1, 9]))) for i in range(40) for k in (-1, 0, 1)]
    st = S.Stats(None, None, 3, "perl", texts=spark.createDataFrame(rows, "inst_id long, ref_no int, text string"))
    plan = V.corpus_info(st.rows, 3)._jdf.queryExecution().executedPlan().toString()
    # by instance (twice: few and many references), by gram, by order; before, one by prefix and two sides more
    assert "hashpartitioning(prefix" not in plan and "hashpartitioning(key" not in plan
    none = spark.createDataFrame([(1, -1, ""), (1, 0, "")], "inst_id long, ref_no int, text string")
    assert V.corpus_info(S.Stats(None, None, 3, "perl", texts=none).rows, 3).collect() == []

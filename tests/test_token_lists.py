"""Token ids from bytes against the tokenisers' columns, and hits from shared grams against plain counting."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlab.functions import tokens as K
from pairlab.operators import ngrams as G
from pairlab.operators import vectors as V

PIECES = [*"ab5.,-' \n\t&;éΣAİ  \u0085_`~/$\x1c\x01!K½²ǅ漢", "<skipped>", "&amp;", "&quot;", "&lt;", "-\n", "...", "..", "3.5", "1,000",
          "--", "5-", "\U0001f600"]


@pytest.mark.parametrize("how", list(K.KINDS))
def test_ids_stand_for_the_tokens_of_the_columns(spark, monkeypatch, how):
    r = random.Random(7)
    rows = [("".join(r.choice(PIECES) for _ in range(r.choice([0, 1, 2, 5, 30, 120]))),) for _ in range(800)] + [("",), (" ",)]
    normal, empty_token = G.TOKENISERS[how]
    got = spark.createDataFrame(rows, "text string").select("text", F.lower("text").alias("low"), normal(F.col("text")).alias("t")).collect()
    texts = pa.array([x.low if how in ("caption", "blank") else x.text for x in got] + [None])
    lists = K.token_lists(texts, how)
    monkeypatch.setattr(K, "PIECE", 50)
    assert K.token_lists(texts, how).equals(lists)
    word_of, id_of = {}, {}
    *lists, last = lists.to_pylist()
    assert last is None
    for x, ids in zip(got, lists):
        words = x.t.split(" ") if x.t or empty_token else []
        assert len(words) == len(ids), x.text
        for w, i in zip(words, ids):
            assert word_of.setdefault(i, w) == w and id_of.setdefault(w, i) == i, x.text


def test_hits_are_those_of_all_grams():
    r = random.Random(3)
    for _ in range(60):
        texts = [np.array([r.randrange(4) for _ in range(r.choice([0, 1, 3, 12, 40]))], np.uint64) for _ in range(r.choice([2, 3, 6]))]
        grams = lambda t, n: Counter(tuple(t[i:i + n].tolist()) for i in range(len(t) - n + 1))
        want = []
        for n in range(1, 8):
            most = Counter()
            for t in texts[1:]:
                most |= grams(t, n)
            want.append((grams(texts[0], n) & most).total())
        assert V.instance_hits(texts, 7) == want


def test_no_regular_expression_is_run_over_a_text(spark):
    """Each text of a scorer is tokenised from its bytes, in the task that counts its grams."""
    texts = spark.createDataFrame([(1, -1, "a b"), (1, 0, "a c")], "inst_id long, ref_no int, text string")
    for how in K.KINDS:
        plan = V.by_instance(texts, how, 4)._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and "xxhash64" not in plan

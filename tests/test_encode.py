"""Fixed-length encoding with a small hot table against a plain look-up."""

import random

import pytest
from pyspark.sql import functions as F

from pairlab.operators import encode as En

TEXTS = [(i, " ".join(random.Random(i).choice(["a", "b", "c", "dog", "é", "x" * 90, f"w{i % 7}"]) for _ in range(i % 14))) for i in range(80)]


@pytest.mark.parametrize("hot", [1 << 16, 3, 1])
def test_two_tiers_are_one_vocabulary(spark, monkeypatch, hot):
    monkeypatch.setattr(En, "HOT_TOKENS", hot)
    rows = TEXTS + [(500, None), (501, ""), (502, "never seen a")]
    df = spark.createDataFrame(rows, "inst_id long, text string").repartition(3)
    vocab = En.build_vocab(df.where("inst_id < 500"))
    ids = {r.token: r.id for r in vocab.collect()}
    got = {r.inst_id: r for r in En.encode_fixed(df, vocab, "text", max_len=8).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        real = ([ids.get(w, 2) for w in t.split(" ")] if t is not None else [])[:7] + [1]
        assert got[i].ids == real + [0] * (8 - len(real)) and got[i].mask == [1] * len(real) + [0] * (8 - len(real)), (i, t)
    assert En.encode_fixed(df.limit(0), vocab, "text").count() == 0


def test_prefix(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "inst_id long, mr string")
    vocab = En.build_vocab(df.select(F.concat(F.lit(En.PREFIX), F.coalesce("mr", F.lit("None"))).alias("text")))
    assert all(2 not in r.ids[:-1] and r.ids.count(1) == 1 for r in En.encode_fixed(df, vocab, "mr", prefix=True).collect())

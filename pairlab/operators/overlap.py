"""Split decontamination (D1-D4) as anti joins on the delexicalised MR key.

Key sets are de-duplicated before they meet the row side, so the build side holds
each key once; a hot key on the row side (one MR shared by many rows) is split by
AQE's skew-join handling.  No side is broadcast by hint: the key sets grow with the
data, so the planner decides from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.mr import delex_key


def with_keys(df: DataFrame, mr: str = "mr", orig: str = "orig_mr") -> DataFrame:
    out = df.withColumn("key", delex_key(F.coalesce(F.col(mr), F.lit(""))))
    if orig in df.columns:
        out = out.withColumn("orig_key", delex_key(F.coalesce(F.col(orig), F.lit(""))))
    return out


def key_set(*parts: DataFrame) -> DataFrame:
    """Distinct union of single-column key frames (column ``key``)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct()


def devel_avoid(test: DataFrame) -> DataFrame:
    t = with_keys(test)
    return key_set(t.select("key"), t.select(F.col("orig_key").alias("key")))


def train_avoid(devel: DataFrame, test: DataFrame) -> DataFrame:
    d = with_keys(devel)
    return key_set(d.select("key"), devel_avoid(test))


def devel_no_overlap(devel: DataFrame, test: DataFrame) -> DataFrame:
    """Development rows whose key is in neither the test keys nor the test original keys."""
    return with_keys(devel).join(devel_avoid(test), "key", "left_anti").drop("key", "orig_key")


def train_no_overlap(train: DataFrame, devel: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows whose key is in none of: all development keys (also of dropped
    rows), test keys, test original keys."""
    return with_keys(train).join(train_avoid(devel, test), "key", "left_anti").drop("key", "orig_key")


def overlap_report(train: DataFrame, devel: DataFrame, test: DataFrame) -> DataFrame:
    """D3: per split: rows to delete, rows, overlapping distinct keys, distinct keys,
    remaining rows, remaining distinct keys, original distinct keys."""
    out = []
    for name, part, avoid in (("devel", devel, devel_avoid(test)),
                              ("train", train, train_avoid(devel, test))):
        k = with_keys(part)
        flagged = k.join(avoid.withColumn("hit", F.lit(True)), "key", "left").withColumn(
            "hit", F.coalesce(F.col("hit"), F.lit(False)))
        stats = flagged.agg(
            F.sum(F.col("hit").cast("long")).alias("to_delete"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(F.when(F.col("hit"), F.col("key"))).alias("overlap_keys"),
            F.count_distinct("key").alias("distinct_keys"),
            F.count_distinct(F.when(~F.col("hit"), F.col("key"))).alias("remaining_keys"),
            F.count_distinct("orig_key").alias("orig_keys"))
        out.append(stats.select(F.lit(name).alias("split"), "*",
                                (F.col("n_rows") - F.col("to_delete")).alias("remaining_rows")))
    return out[0].unionByName(out[1])


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Delexicalised keys present in both splits (distinct)."""
    return with_keys(a).select("key").intersect(with_keys(b).select("key"))

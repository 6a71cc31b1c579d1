"""Length quantiles from mergeable sketches against the exact form."""

import bisect

import pytest
from pyspark.sql import functions as F

from pairlab.operators import profile


@pytest.fixture(scope="module")
def lengths(spark):
    """Skewed lengths with a third of all rows equal, in three splits, with nulls and ties."""
    length = F.when(F.col("id") % 3 == 0, 40).otherwise((F.xxhash64("id") % 1000) * (F.xxhash64("id") % 1000))
    return (spark.range(30_000).select((F.col("id") % 7 % 3).alias("split"), length.cast("long").alias("len"))
            .unionByName(spark.createDataFrame([(0, None), (1, None)], "split long, len long")))


def share_range(values, x):
    return bisect.bisect_left(values, x) / len(values), bisect.bisect_right(values, x) / len(values)


@pytest.mark.parametrize("pct", [1, 25, 50, 90, 99, 100])
def test_merged_sketches_stay_within_their_error(lengths, pct):
    values = sorted(r.len for r in lengths.collect() if r.len is not None)
    merged = profile.merge_sketches(profile.length_sketches(lengths, "len", ["split"]))
    got = profile.sketch_coverage(merged, pct).first()
    assert got.n == len(values)
    below, upto = share_range(values, got.length)
    assert below - profile.sketch_rank_error() <= pct / 100 <= upto + profile.sketch_rank_error()


def test_sketch_per_key(lengths):
    got = {r.split: r for r in profile.sketch_coverage(profile.length_sketches(lengths, "len", ["split"]), 50, ["split"]).collect()}
    for split, r in got.items():
        values = sorted(x.len for x in lengths.where(F.col("split") == split).collect() if x.len is not None)
        below, upto = share_range(values, r.length)
        assert r.n == len(values) and below - profile.sketch_rank_error() <= 0.5 <= upto + profile.sketch_rank_error()


def test_few_values_are_exact_and_none_are_null(spark, lengths):
    few = spark.createDataFrame([(v,) for v in [3, 1, 2, 2, 9, 9, 9, 30]], "len long")
    exact = profile.coverage(few, "len", 75).first().length
    assert profile.sketch_coverage(profile.length_sketches(few, "len"), 75).first().length == exact == 9
    none = profile.sketch_coverage(profile.length_sketches(lengths.where("len is null"), "len")).first()
    assert (none.n, none.length) == (0, None)

"""Corpus profiling (H1-H14): vocabulary, lengths, histograms, label statistics.

Counting is groupBy with partial aggregation; histograms aggregate to one row per
bin first, and only that bounded table (max length / bin width rows) is ordered for
running shares.  Stop words are a fixed 181-word list, broadcast by its known size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.functions.stopwords import ENGLISH


def stop_words(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ENGLISH], "word string")


def words(df: DataFrame, col: str = "text", keys=()) -> DataFrame:
    """E4 tokens exploded: keys + (word)."""
    return df.select(*keys, F.explode(T.tokenize_words(F.col(col))).alias("word"))


def word_counts(df: DataFrame, col: str = "text", drop_stop: bool = False) -> DataFrame:
    """H1 / H2: (word, cnt) sorted by count descending, then word."""
    w = words(df, col)
    if drop_stop:
        w = w.join(F.broadcast(stop_words(df.sparkSession)), "word", "left_anti")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "word")


def vocab_size(df: DataFrame, col: str = "text", approx: bool = False) -> DataFrame:
    """H3: distinct words with and without stop words."""
    w = words(df, col).join(F.broadcast(stop_words(df.sparkSession).withColumn("stop", F.lit(True))), "word", "left")
    cd = F.approx_count_distinct if approx else F.count_distinct
    return w.agg(cd("word").alias("vocab"), cd(F.when(F.col("stop").isNull(), F.col("word"))).alias("vocab_no_stop"))


def top_words(df: DataFrame, k: int = 150, col: str = "text", drop_stop: bool = True) -> DataFrame:
    """H4: the k most frequent words (a top-k: per-partition heaps, then one merge)."""
    return word_counts(df, col, drop_stop).limit(k)


def describe(x: Column, keys_df: DataFrame, keys=()) -> DataFrame:
    """N, min, max, mean, sample variance, skewness and excess kurtosis
    (population moments, as SciPy's default)."""
    return keys_df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"),
        F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"))


def lengths(df: DataFrame, col: str = "text", keys=()) -> DataFrame:
    """Character and word counts per text: keys + (chars, tokens)."""
    return df.select(*keys, F.length(col).alias("chars"), F.size(T.tokenize_words(F.col(col))).alias("tokens"))


def histogram(values: DataFrame, col: str, width: float, keys=(), density: bool = False) -> DataFrame:
    """Share (percent, or density = share / width) per fixed-width bin."""
    b = values.select(*keys, F.floor(F.col(col) / width).cast("long").alias("bin"))
    h = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    # totals from the per-bin aggregate (one row per bin), not from the rows
    h = h.withColumn("total", F.sum("cnt").over(Window.partitionBy(*keys)))
    share = F.col("cnt") / F.col("total")
    out = (share / width) if density else (share * 100.0)
    return h.select(*keys, "bin", (F.col("bin") * width).alias("lo"), "cnt", "total",
                    out.alias("density" if density else "pct"))


def cumulative(hist: DataFrame, keys=()) -> DataFrame:
    """H7: running percent over the bins.  The window runs over the histogram (one row
    per bin), never over the raw rows."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (hist.withColumn("cum_cnt", F.sum("cnt").over(w))
            .withColumn("cum_pct", F.col("cum_cnt") * 100.0 / F.col("total")))


def coverage(values: DataFrame, col: str, share_pct: int = 99) -> DataFrame:
    """H8: smallest value whose cumulative share reaches ``share_pct`` percent
    (compared in integers: cum_cnt * 100 >= share_pct * total)."""
    h = values.select(F.col(col).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"))
    h = h.withColumn("total", F.sum("cnt").over(Window.partitionBy()))
    cum = h.withColumn("cum_cnt", F.sum("cnt").over(
        Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return cum.filter(F.col("cum_cnt") * 100 >= F.col("total") * share_pct).agg(F.min("bin").alias("length"))


def length_sketches(values: DataFrame, col: str, keys=(), k: int = 800) -> DataFrame:
    """One mergeable KLL sketch of the values per key: for lengths with too many distinct values for
    ``coverage``, whose histogram is sorted in one task.  Nulls take no part; k: 8 to 65535."""
    return values.groupBy(*keys).agg(F.kll_sketch_agg_bigint(F.col(col).cast("long"), k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys=()) -> DataFrame:
    """Sketches of parts (files, days, splits) as one per key, without their rows."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_rank_error(k: int = 800) -> float:
    """Share of the rows by which a sketch's rank may be off, at 99 % confidence."""
    return 2.296 / k ** 0.9723


def sketch_coverage(sketches: DataFrame, share_pct: int = 99, keys=()) -> DataFrame:
    """H8 from sketches: a value whose cumulative share is ``share_pct`` percent, give or take
    ``sketch_rank_error`` (an empty sketch: null), and the number of rows sketched."""
    n = F.kll_sketch_get_n_bigint("sketch")
    return sketches.select(*keys, n.alias("n"), F.when(
        n > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(share_pct / 100.0))).alias("length"))


def label_share(scored: DataFrame) -> DataFrame:
    """Share of each label (window over the per-label aggregate only)."""
    c = scored.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    return c.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))


def label_stats(scored: DataFrame) -> DataFrame:
    """Mean, min, max, count, sample std and variance of the score per label."""
    s = F.col("score")
    return scored.groupBy("label").agg(F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"),
                                       F.count(s).alias("count"), F.stddev_samp(s).alias("std"),
                                       F.var_samp(s).alias("var"))

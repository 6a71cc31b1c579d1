"""Run analysis (I1-I13): experiment names, rankings, top-k, parameter parsing,
training summaries and parameter grids.

Ranking inside a group never puts a whole group into one task: ``rank_within``
range-partitions by (group, order) -- a hot group is cut into many ranges -- numbers
rows inside each range and adds the row counts of the earlier ranges of the same
group (a small per-(partition, group) table).  Top-k per group is two-stage with a
salt, so each stage's window holds at most salts x k rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exp_name(file: Column) -> Column:
    """The 4th path part from the end."""
    return F.element_at(F.split(file, "/"), -4)


def rank_within(df: DataFrame, group: str, order: list[Column], parts: int | None = None) -> DataFrame:
    """Exact 1-based rank of every row inside its group by ``order`` (a total order).

    Range partitioning spreads a hot group over many partitions; positions come from
    monotonically_increasing_id inside each sorted partition; the per-(partition,
    group) counts (at most partitions x groups rows) give each range its offset."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
         .checkpoint())
    per = s.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (s.join(per, ["_pid", group])
            .withColumn("rank", (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mid", "_cnt", "_first", "_before"))


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int, salts: int = 64,
                    salt_col: str | None = None) -> DataFrame:
    """Top k rows per group (I3): top k inside (group, salt), then top k of those."""
    salt = F.pmod(F.xxhash64(F.col(salt_col) if salt_col else F.struct(*df.columns)), F.lit(salts))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order)
    first = (df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1))
             .filter(F.col("_r") <= k).drop("_r", "_salt"))
    w2 = Window.partitionBy(group).orderBy(*order)
    return first.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def params_parse(runs: DataFrame, col: str = "params", keys=("version",)) -> DataFrame:
    """A Python-literal dict text -> (keys, key, value) rows."""
    js = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.col(col), "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    m = F.from_json(js, "map<string,string>")
    return runs.select(*keys, F.explode(m).alias("key", "value"))


def key_frequency(df: DataFrame) -> DataFrame:
    """How many records carry each key (null fields count as absent)."""
    keys = F.json_object_keys(F.to_json(F.struct(*df.columns)))
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("records"))


def best_ids(df: DataFrame, order: list[Column], k: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(k).select("id")


def top_by_two_losses(train_runs: DataFrame, k: int = 10) -> DataFrame:
    """I8: ids among the k best by validation loss and the k best by training loss."""
    a = best_ids(train_runs, [F.col("val_loss"), F.col("id")], k)
    b = best_ids(train_runs, [F.col("train_loss"), F.col("id")], k)
    return a.intersect(b)


def top_combined(train_runs: DataFrame, k: int = 10) -> DataFrame:
    """K best by (val_loss, train_loss), kept when also in I8."""
    c = best_ids(train_runs, [F.col("val_loss"), F.col("train_loss"), F.col("id")], k)
    return c.join(top_by_two_losses(train_runs, k), "id", "left_semi")


def select_models(train_runs: DataFrame, ids: DataFrame, cols=("model_size", "optimizer", "learning_rate"),
                  num=("val_loss", "train_loss", "val_accuracy", "train_accuracy")) -> DataFrame:
    """Rows of an id set, chosen columns, numbers rounded to 4 decimals, sorted."""
    return (train_runs.join(ids, "id", "left_semi")
            .select("id", *cols, *[F.round(c, 4).alias(c) for c in num]).orderBy("id"))


GRID_DIMS = ["model_size", "encoder_max_len", "decoder_max_len", "is_special_token", "learning_rate", "optimizer"]


def param_grid(train_runs: DataFrame, dims=tuple(GRID_DIMS), resume_from: int = 1) -> DataFrame:
    """Every combination of the distinct settings found in the records, numbered
    in nesting order (first dimension outermost); ids below ``resume_from`` are
    skipped.  The grid is generated from one row of sorted distinct values (bounded
    by the settings' domains) by successive posexplode; the id is the mixed-radix
    number of the positions."""
    sets = train_runs.agg(*[F.array_sort(F.collect_set(F.col(d).cast("string"))).alias(d) for d in dims])
    g = sets.select(*[F.size(d).alias(f"_n_{d}") for d in dims], *dims)
    for d in dims:
        g = g.select("*", F.posexplode(d).alias(f"_i_{d}", f"_v_{d}")).drop(d)
    idx = F.lit(0).cast("long")
    for d in dims:
        idx = idx * F.col(f"_n_{d}") + F.col(f"_i_{d}")
    return g.select((idx + 1).alias("id"), *[F.col(f"_v_{d}").alias(d) for d in dims]).filter(
        F.col("id") >= resume_from)


def fit_summary(hist: DataFrame) -> DataFrame:
    """Per run: best epoch (0-based position of the lowest validation loss, first on
    ties), best accuracies, lowest losses, lowest rate, total minutes, mean epoch seconds."""
    return hist.groupBy("run_id").agg(
        (F.min_by("epoch", F.struct("val_loss", "epoch")) - 1).alias("best_epoch"),
        F.max("accuracy").alias("max_acc"), F.max("val_accuracy").alias("max_val_acc"),
        F.min("loss").alias("min_loss"), F.min("val_loss").alias("min_val_loss"), F.min("lr").alias("min_lr"),
        F.round(F.sum("secs") / 60.0, 2).alias("total_minutes"), F.avg("secs").alias("avg_epoch_secs"),
        F.count(F.lit(1)).alias("epochs"))


def params_x_models(models: DataFrame, settings: DataFrame, setting_col: str) -> DataFrame:
    """Every generation setting for every chosen model.  The settings side is one
    sorted array of its distinct values (bounded by the settings' domain), taken as a
    scalar subquery and exploded next to each model row (no join)."""
    arr = settings.agg(F.array_sort(F.collect_set(setting_col))).scalar()
    return models.select(*models.columns, F.explode(arr).alias(setting_col))

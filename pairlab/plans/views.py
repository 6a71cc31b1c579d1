"""Fixture views over the driver tables (Spark side).

Each view is plain projections and integer arithmetic over one table, so the same
definition exists as DuckDB SQL in ``plans/sqlviews.py``.  A base
table is dealt by its key once; after that every view is a row-local projection.

``seg_pairs`` uses whole document texts (no prefix of the text is taken): reference 0
is the text, reference 1 drops every fifth piece (shifted by the id), reference 2
(even ids only, to make reference sets ragged) drops the first three pieces, and the
system output drops every seventh piece (a second system's, where asked for, every third).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.plans import fixtures as fx
from pairlab.sources.tables import table

# ---------------------------------------------------------------------------
# seg_pairs: (inst_id, ref_no, ref) and (inst_id, sys)
# ---------------------------------------------------------------------------


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by their instance before the expensive work per row (tokenising, n-grams, patterns), at
    every size, to the session's number of shuffle partitions: keys are narrow and the work on them isn't,
    so partitions must not be put together by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _pieces(df: DataFrame) -> DataFrame:
    df = spread(df.select("doc_id", "text"), "doc_id")
    return df.select(F.col("doc_id").alias("inst_id"),
                     F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(
        "t", F.split(F.col("text"), " ", -1))


def seg_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pieces(table(spark, sf_dir, "documents"))
    iid, t = F.col("inst_id"), F.col("t")
    r0 = F.struct(F.lit(0).alias("ref_no"), F.col("text").alias("ref"))
    r1 = F.struct(F.lit(1).alias("ref_no"),
                  F.array_join(F.filter(t, lambda x, i: (i + iid) % 5 != 2), " ").alias("ref"))
    r2 = F.when(iid % 2 == 0, F.struct(
        F.lit(2).alias("ref_no"),
        F.array_join(F.slice(t, 4, F.greatest(F.size(t) - 3, F.lit(0))), " ").alias("ref")))
    refs = F.filter(F.array(r0, r1, r2), lambda s: s.isNotNull())
    return d.select("inst_id", F.inline(refs))


def seg_sys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pieces(table(spark, sf_dir, "documents"))
    iid, t = F.col("inst_id"), F.col("t")
    return d.select("inst_id", F.array_join(F.filter(t, lambda x, i: (i + iid) % 7 != 0), " ").alias("sys"))


def seg_texts(spark: SparkSession, sf_dir: str, systems: int = 1) -> DataFrame:
    """References and system outputs in one scan: (inst_id, ref_no, text), ref_no -1 = system; a second
    one (-2) drops every third piece."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("inst_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    iid, no = F.col("inst_id"), F.col("ref_no")
    t = F.split(F.col("text"), " ", -1)
    without = lambda keep: F.array_join(F.filter(t, keep), " ")
    # numbers first: who asks for some of them builds only their texts
    numbers = F.filter(F.array(*(F.lit(n) for n in [-1, -2][:systems] + [0, 1]), F.when(iid % 2 == 0, 2)), lambda n: n.isNotNull())
    text = (F.when(no == -1, without(lambda x, i: (i + iid) % 7 != 0)).when(no == -2, without(lambda x, i: (i + iid) % 3 != 1))
            .when(no == 0, F.col("text")).when(no == 1, without(lambda x, i: (i + iid) % 5 != 2))
            .otherwise(F.array_join(F.slice(t, 4, F.greatest(F.size(t) - 3, F.lit(0))), " ")))
    return d.select("inst_id", "text", F.explode(numbers).alias("ref_no")).select("inst_id", "ref_no", text.alias("text"))


def seg_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst_id, ref_no, ref, sys): one row per reference, system output repeated."""
    return seg_refs(spark, sf_dir).join(seg_sys(spark, sf_dir), "inst_id")


# ---------------------------------------------------------------------------
# mr_pairs: (inst_id, split, mr, orig_mr, ref) from orders
# ---------------------------------------------------------------------------


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mr_pairs_columns(k: Column) -> dict:
    """Column expressions of the mr_pairs view for an order key column ``k``."""
    idx = [(F.floor(k / p) % len(vals)).cast("int") for p, vals in zip(fx.SLOT_DIVISORS, fx.VALUES)]
    val = [F.element_at(_arr(vals), i + 1) for vals, i in zip(fx.VALUES, idx)]
    frag = [F.element_at(_arr([fx.FRAGMENTS[s][v] for v in vals]), i + 1)
            for s, (vals, i) in enumerate(zip(fx.VALUES, idx))]
    present = [F.lit(True)] + [(k + s) % 4 != 0 for s in range(1, 8)]
    c = (F.floor(k / 10) % 10).cast("int")
    last = F.when((k + 7) % 4 != 0, F.lit(7)).otherwise(F.lit(6))
    first_absent = (F.lit(4) - k % 4).cast("int")
    pieces = []
    for s in range(8):
        keep = present[s] & ~(c.isin(0, 3) & (last == s))
        add = c.isin(1, 3) & (first_absent == s)
        text = frag[s]
        if s == 5:  # area: name the other value when c = 2
            other = F.element_at(_arr([fx.FRAGMENTS[5][v] for v in fx.AREAS]), 2 - idx[5])
            text = F.when(c == 2, other).otherwise(frag[s])
        pieces.append(F.when(keep | add, text))
    items = [F.when(present[s], F.concat(F.lit(fx.MR_SLOTS[s] + "["), val[s], F.lit("]")))
             for s in range(8)]
    items_wo_last = [F.when(present[s] & (last != s), F.concat(F.lit(fx.MR_SLOTS[s] + "["), val[s], F.lit("]")))
                     for s in range(8)]
    mr = F.concat_ws(", ", *items)
    return {
        "split": F.when(k % 10 == 0, "test").when(k % 10 == 1, "devel").otherwise("train"),
        "mr": mr,
        "orig_mr": F.when(k % 5 == 0, F.concat_ws(", ", *items_wo_last)).otherwise(mr),
        "ref": F.concat(F.concat_ws(", ", *pieces), F.lit(".")),
    }


def mr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cols = mr_pairs_columns(k)
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(
        k.cast("long").alias("inst_id"), *[v.alias(n) for n, v in cols.items()])


# ---------------------------------------------------------------------------
# small analysis views
# ---------------------------------------------------------------------------

ROLE_INDEX = {"system": 0, "user": 1, "assistant": 2}


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image_id, category_id, caption, x, y, w, h, iscrowd) from conversations."""
    c = table(spark, sf_dir, "conversations")
    cid = (F.col("conv_id") * 100 + F.col("turn")).cast("long")
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return c.select(cid.alias("id"), F.col("conv_id").cast("long").alias("image_id"),
                    role.cast("int").alias("category_id"), F.col("text").alias("caption"),
                    (cid % 13).cast("double").alias("x"), (cid % 7).cast("double").alias("y"),
                    (cid % 5 + 1).cast("double").alias("w"), (cid % 3 + 1).cast("double").alias("h"),
                    (cid % 4 == 0).cast("int").alias("iscrowd"))


RUN_FACTORS = {"NIST": 1.5, "METEOR": 0.25, "ROUGE_L": 0.5, "CIDEr": 2.0}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records (X11 shape) from events."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    k = F.get_json_object(F.col("props"), "$.k")
    params = F.concat(F.lit("{'num_beams': "), (eid % 7 + 1).cast("string"),
                      F.lit(", 'do_sample': "), F.when(eid % 2 == 0, "True").otherwise("False"),
                      F.lit(", 'top_k': "), F.coalesce(k, F.lit("0")),
                      F.lit(", 'optimizer': '"), F.element_at(_arr(["adam", "rmsprop", "sgd"]), (eid % 3 + 1).cast("int")),
                      F.lit("'}"))
    return e.select(
        F.concat(F.lit("v"), eid.cast("string")).alias("version"),
        F.col("event_type").alias("exp"),
        F.col("value").alias("BLEU"),
        *[(F.col("value") * f).alias(n) for n, f in RUN_FACTORS.items()],
        params.alias("params"),
        F.concat(F.lit("/r/"), F.col("event_type"), F.lit("/output/"), eid.cast("string"), F.lit("/x.txt")).alias("file"),
    )


def train_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records (X12 shape) from part."""
    p = table(spark, sf_dir, "part")
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return p.select(
        k.cast("long").alias("id"),
        F.element_at(_arr(["t5-small", "t5-base"]), (k % 2 + 1).cast("int")).alias("model_size"),
        F.element_at(_arr(["adam", "rmsprop", "sgd"]), (k % 3 + 1).cast("int")).alias("optimizer"),
        F.element_at(_arr(["0.001", "0.0005", "0.0001", "custom"]), (k % 4 + 1).cast("int")).alias("learning_rate"),
        (size / 100.0).alias("lr_mod"),
        ((price % 100) / 100.0).alias("train_accuracy"),
        (price / 1200.0 + (k % 7) / 1000.0).alias("train_loss"),
        ((price % 37) / 37.0).alias("val_accuracy"),
        (price / 1000.0 + (k % 5) / 100.0).alias("val_loss"),
        (price / 10.0).alias("total_time"),
        (size * 2.5).alias("avg_epoch_time"),
        F.when(k % 11 != 0, F.lit(5)).cast("long").alias("epoch_num"),
        F.element_at(F.array(F.lit(60), F.lit(90), F.lit(120)), (k % 3 + 1).cast("int")).cast("long").alias("encoder_max_len"),
        F.element_at(F.array(F.lit(60), F.lit(90), F.lit(120)), (F.floor(k / 3) % 3 + 1).cast("int")).cast("long").alias("decoder_max_len"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("is_special_token"),
    )


def epoch_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-epoch training history from lineitem (min per (run, epoch) key)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch")).agg(
        F.min(F.col("l_quantity") / 10.0).alias("loss"),
        F.min(F.col("l_extendedprice") / 100000.0).alias("val_loss"),
        F.min(1 - F.col("l_discount")).alias("accuracy"),
        F.min(1 - F.col("l_tax")).alias("val_accuracy"),
        F.min(F.col("l_discount") / 100.0).alias("lr"),
        F.min(F.col("l_quantity") * 2.0).alias("secs"),
    ).select(F.col("run_id").cast("long"), F.col("epoch").cast("int"), "loss", "val_loss",
             "accuracy", "val_accuracy", "lr", "secs")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score, text) from documents joined with labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE").alias("label"),
        (F.lit(1.0) / (F.col("doc_id") % 97 + 1)).alias("score"), "text")

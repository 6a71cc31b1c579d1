"""Registered queries for run analysis (I1-I13) and H9."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import noise as N
from pairlab.operators import runs as R
from pairlab.plans import views as V
from pairlab.plans.registry import query
from pairlab.plans.sqlviews import with_views

RV = with_views("runs")
TV = with_views("train_runs")


def _r4(c):
    return F.round(c, 4).cast("double")


@query("exp_name", RV + "\nSELECT version, split_part(file, '/', len(string_split(file, '/')) - 3) AS exp_name FROM runs")
def exp_name(spark, sf):
    return V.runs(spark, sf).select("version", R.exp_name(F.col("file")).alias("exp_name"))


@query("runs_by_exp", RV + """
SELECT exp, version, round("BLEU", 4) AS bleu,
       CAST(row_number() OVER (PARTITION BY exp ORDER BY "BLEU" DESC, version) AS BIGINT) AS rank FROM runs""")
def runs_by_exp(spark, sf):
    r = V.runs(spark, sf).select("exp", "version", "BLEU")
    out = R.rank_within(r, "exp", [F.col("BLEU").desc(), F.col("version")])
    return out.select("exp", "version", _r4(F.col("BLEU")).alias("bleu"), "rank")


@query("top3_per_exp", RV + """
SELECT exp, version, round("BLEU", 4) AS bleu, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY exp ORDER BY "BLEU" DESC, version) AS rank FROM runs) WHERE rank <= 3""")
def top3_per_exp(spark, sf):
    r = V.runs(spark, sf).select("exp", "version", "BLEU")
    out = R.top_k_per_group(r, "exp", [F.col("BLEU").desc(), F.col("version")], 3, salt_col="version")
    return out.select("exp", "version", _r4(F.col("BLEU")).alias("bleu"), F.col("rank").cast("int"))


@query("top20_runs", RV + """
SELECT version, exp, round("BLEU", 4) AS bleu, round("NIST", 4) AS nist, round("METEOR", 4) AS meteor,
       round("ROUGE_L", 4) AS rouge_l, round("CIDEr", 4) AS cider FROM runs ORDER BY "BLEU" DESC, version LIMIT 20""")
def top20_runs(spark, sf):
    r = V.runs(spark, sf).orderBy(F.col("BLEU").desc(), F.col("version")).limit(20)
    return r.select("version", "exp", *[_r4(F.col(c)).alias(c.lower()) for c in ("BLEU", "NIST", "METEOR", "ROUGE_L", "CIDEr")])


@query("latest_runs", RV + "\nSELECT version, exp, round(\"BLEU\", 4) AS bleu FROM runs ORDER BY version DESC")
def latest_runs(spark, sf):
    return V.runs(spark, sf).orderBy(F.col("version").desc()).select("version", "exp", _r4(F.col("BLEU")).alias("bleu"))


@query("params_parse", RV + """,
j AS (SELECT version, CAST(replace(replace(replace(params, '''', '"'), 'True', 'true'), 'False', 'false') AS JSON) AS j FROM runs)
SELECT version, k AS key, json_extract_string(j, '$.' || k) AS value FROM (SELECT version, j, unnest(json_keys(j)) AS k FROM j)""")
def params_parse(spark, sf):
    return R.params_parse(V.runs(spark, sf)).select("version", "key", "value")


@query("key_frequency", TV + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS key, CAST(count({c}) AS BIGINT) AS records FROM train_runs" for c in
    ["id", "model_size", "optimizer", "learning_rate", "lr_mod", "train_accuracy", "train_loss", "val_accuracy",
     "val_loss", "total_time", "avg_epoch_time", "epoch_num", "encoder_max_len", "decoder_max_len", "is_special_token"]))
def key_frequency(spark, sf):
    return R.key_frequency(V.train_runs(spark, sf)).select("key", F.col("records").cast("long"))


I8_SQL = """a AS (SELECT id FROM train_runs ORDER BY val_loss, id LIMIT 10),
b AS (SELECT id FROM train_runs ORDER BY train_loss, id LIMIT 10),
i8 AS (SELECT id FROM a INTERSECT SELECT id FROM b)"""


@query("top_by_two_losses", TV + ",\n" + I8_SQL + "\nSELECT id FROM i8")
def top_by_two_losses(spark, sf):
    return R.top_by_two_losses(V.train_runs(spark, sf))


@query("top_combined", TV + ",\n" + I8_SQL + """,
c AS (SELECT id FROM train_runs ORDER BY val_loss, train_loss, id LIMIT 10)
SELECT id FROM c WHERE id IN (SELECT id FROM i8)""")
def top_combined(spark, sf):
    return R.top_combined(V.train_runs(spark, sf))


@query("select_models", TV + ",\n" + I8_SQL + """
SELECT id, model_size, optimizer, learning_rate, round(val_loss, 4) AS val_loss, round(train_loss, 4) AS train_loss,
       round(val_accuracy, 4) AS val_accuracy, round(train_accuracy, 4) AS train_accuracy
FROM train_runs WHERE id IN (SELECT id FROM i8) ORDER BY id""")
def select_models(spark, sf):
    t = V.train_runs(spark, sf)
    return R.select_models(t, R.top_by_two_losses(t))


@query("param_grid", TV + ",\n" + ",\n".join(
    f"d{i} AS (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS i, "
    f"count(*) OVER () AS n FROM (SELECT DISTINCT {c} FROM train_runs WHERE {c} IS NOT NULL))"
    for i, c in enumerate(R.GRID_DIMS)) + "\nSELECT " +
    "CAST(" + "((((d0.i * d1.n + d1.i) * d2.n + d2.i) * d3.n + d3.i) * d4.n + d4.i) * d5.n + d5.i + 1" + " AS BIGINT) AS id, " +
    ", ".join(f"d{i}.v AS {c}" for i, c in enumerate(R.GRID_DIMS)) +
    " FROM d0, d1, d2, d3, d4, d5")
def param_grid(spark, sf):
    return R.param_grid(V.train_runs(spark, sf)).select(F.col("id").cast("long"), *R.GRID_DIMS)


@query("fit_summary", with_views("epoch_hist") + """
SELECT run_id, CAST(arg_min(epoch, {'v': val_loss, 'e': epoch}) - 1 AS INTEGER) AS best_epoch,
       round(max(accuracy), 4) AS max_acc, round(max(val_accuracy), 4) AS max_val_acc,
       round(min(loss), 4) AS min_loss, round(min(val_loss), 4) AS min_val_loss, round(min(lr), 4) AS min_lr,
       round(sum(secs) / 60.0, 2) AS total_minutes, round(avg(secs), 4) AS avg_epoch_secs,
       CAST(count(*) AS BIGINT) AS epochs
FROM epoch_hist GROUP BY run_id""")
def fit_summary(spark, sf):
    s = R.fit_summary(V.epoch_hist(spark, sf))
    return s.select("run_id", F.col("best_epoch").cast("int"),
                    *[_r4(F.col(c)).alias(c) for c in ("max_acc", "max_val_acc", "min_loss", "min_val_loss", "min_lr")],
                    F.col("total_minutes").cast("double"), _r4(F.col("avg_epoch_secs")).alias("avg_epoch_secs"),
                    F.col("epochs").cast("long"))


@query("params_x_models", TV + ",\n" + RV[len("WITH "):] + ",\n" + I8_SQL + """,
c AS (SELECT id FROM train_runs ORDER BY val_loss, train_loss, id LIMIT 10),
models AS (SELECT id FROM c WHERE id IN (SELECT id FROM i8)),
beams AS (SELECT DISTINCT CAST(regexp_extract(params, '''num_beams'': ([0-9]+)', 1) AS INTEGER) AS num_beams FROM runs)
SELECT m.id, b.num_beams FROM models m CROSS JOIN beams b""")
def params_x_models(spark, sf):
    models = R.top_combined(V.train_runs(spark, sf))
    beams = V.runs(spark, sf).select(
        F.regexp_extract("params", r"'num_beams': ([0-9]+)", 1).cast("int").alias("num_beams")).distinct()
    return R.params_x_models(models, beams, "num_beams").select("id", "num_beams")


def _fixed_examples_sql():
    from pairlab.plans.q_noise import _keyed
    return _keyed("SELECT inst_id, fixed_mr AS mr, mr AS orig_mr FROM errs WHERE fixed_mr <> mr")


@query("fixed_examples", _fixed_examples_sql)
def fixed_examples(spark, sf):
    """H9: repaired rows (flag fixed = 1) with their original MR."""
    e = N.fixed_rows(N.instance_errors(V.mr_pairs(spark, sf)))
    return e.filter(F.col("fixed") == 1).select("inst_id", "mr", "orig_mr")

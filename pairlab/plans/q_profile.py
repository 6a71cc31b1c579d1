"""Registered queries for profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions.stopwords import ENGLISH
from pairlab.operators import profile as P
from pairlab.plans import views as V
from pairlab.plans.registry import query
from pairlab.plans.sqlviews import with_views
from pairlab.sources.tables import table

STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"
WORDS = "words AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents)"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _r4(c):
    return F.round(c, 4).cast("double")


@query("word_counts", f"WITH {WORDS} SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM words GROUP BY word")
def word_counts(spark, sf):
    return P.word_counts(_docs(spark, sf)).select("word", F.col("cnt").cast("long"))


@query("word_counts_no_stop", f"""WITH {WORDS} SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM words
WHERE NOT list_contains({STOP_SQL}, word) GROUP BY word""")
def word_counts_no_stop(spark, sf):
    return P.word_counts(_docs(spark, sf), drop_stop=True).select("word", F.col("cnt").cast("long"))


@query("vocab_size", f"""WITH {WORDS} SELECT CAST(count(DISTINCT word) AS BIGINT) AS vocab,
CAST(count(DISTINCT CASE WHEN NOT list_contains({STOP_SQL}, word) THEN word END) AS BIGINT) AS vocab_no_stop FROM words""")
def vocab_size(spark, sf):
    return P.vocab_size(_docs(spark, sf)).select(F.col("vocab").cast("long"), F.col("vocab_no_stop").cast("long"))


@query("top_words", f"""WITH {WORDS} SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM words
WHERE NOT list_contains({STOP_SQL}, word) GROUP BY word ORDER BY cnt DESC, word LIMIT 150""")
def top_words(spark, sf):
    return P.top_words(_docs(spark, sf), 150).select("word", F.col("cnt").cast("long"))


def _describe_sql(src: str, x: str, keys: str = "") -> str:
    sel = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    join = f"USING ({keys})" if keys else "ON TRUE"
    return f"""m AS (SELECT {sel}avg({x}) AS mu, var_pop({x}) AS vp FROM {src} {grp}),
d AS (SELECT {sel}CAST(count({x}) AS BIGINT) AS n, CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max,
        round(avg({x}), 4) AS mean, round(var_samp({x}), 4) AS variance,
        round(avg(power({x} - mu, 3)) / power(any_value(vp), 1.5), 4) AS skewness,
        round(kurtosis_pop({x}), 4) AS kurtosis
      FROM {src} JOIN m {join} {grp})"""


def _desc_cols():
    return [F.col("n").cast("long"), "min", "max", _r4(F.col("mean")).alias("mean"),
            _r4(F.col("variance")).alias("variance"), _r4(F.col("skewness")).alias("skewness"),
            _r4(F.col("kurtosis")).alias("kurtosis")]


LENS = "lens AS (SELECT length(text) AS chars, len(regexp_extract_all(lower(text), '\\p{L}+')) AS tokens FROM documents)"


@query("length_describe", f"""WITH {LENS},
{_describe_sql('lens', 'chars').replace('m AS', 'mc AS').replace('JOIN m ', 'JOIN mc ').replace('d AS', 'dc AS')},
{_describe_sql('lens', 'tokens').replace('m AS', 'mt AS').replace('JOIN m ', 'JOIN mt ').replace('d AS', 'dt AS')}
SELECT 'chars' AS measure, * FROM dc UNION ALL SELECT 'tokens' AS measure, * FROM dt""")
def length_describe(spark, sf):
    lens = P.lengths(_docs(spark, sf))
    a = P.describe(F.col("chars"), lens).select(F.lit("chars").alias("measure"), *_desc_cols())
    b = P.describe(F.col("tokens"), lens).select(F.lit("tokens").alias("measure"), *_desc_cols())
    return a.unionByName(b)


def _hist_sql(src: str, x: str, width: float, keys: str = "", density: bool = False) -> str:
    sel = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    out = (f"CAST(round(cnt * 1.0 / total / {width}, 4) AS DOUBLE) AS density" if density
           else "CAST(round(cnt * 100.0 / total, 4) AS DOUBLE) AS pct")
    return f"""h AS (SELECT {sel}CAST(floor({x} / {width}) AS BIGINT) AS bin, count(*) AS cnt FROM {src} GROUP BY ALL),
ht AS (SELECT *, sum(cnt) OVER ({part}) AS total FROM h)
SELECT {sel}bin, CAST(round(bin * {width}, 4) AS DOUBLE) AS lo, CAST(cnt AS BIGINT) AS cnt, {out} FROM ht"""


@query("length_histogram", f"WITH {LENS},\n" + _hist_sql("lens", "chars", 500.0))
def length_histogram(spark, sf):
    h = P.histogram(P.lengths(_docs(spark, sf)), "chars", 500.0)
    return h.select("bin", _r4(F.col("lo")).alias("lo"), F.col("cnt").cast("long"), _r4(F.col("pct")).alias("pct"))


@query("cumulative_histogram", f"""WITH {LENS},
h AS (SELECT CAST(floor(tokens / 50.0) AS BIGINT) AS bin, count(*) AS cnt FROM lens GROUP BY ALL),
ht AS (SELECT *, sum(cnt) OVER () AS total, sum(cnt) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM h)
SELECT bin, CAST(cnt AS BIGINT) AS cnt, round(cum * 100.0 / total, 4) AS cum_pct FROM ht""")
def cumulative_histogram(spark, sf):
    h = P.cumulative(P.histogram(P.lengths(_docs(spark, sf)), "tokens", 50.0))
    return h.select("bin", F.col("cnt").cast("long"), _r4(F.col("cum_pct")).alias("cum_pct"))


@query("length_coverage", f"""WITH {LENS},
h AS (SELECT tokens AS bin, count(*) AS cnt FROM lens GROUP BY ALL),
ht AS (SELECT *, sum(cnt) OVER () AS total, sum(cnt) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM h)
SELECT CAST(min(bin) AS BIGINT) AS length FROM ht WHERE cum * 100 >= total * 99""")
def length_coverage(spark, sf):
    return P.coverage(P.lengths(_docs(spark, sf)), "tokens", 99).select(F.col("length").cast("long"))


SC = with_views("scored")


@query("label_stats", SC + """
SELECT label, round(avg(score), 4) AS mean, round(min(score), 4) AS min, round(max(score), 4) AS max,
       CAST(count(score) AS BIGINT) AS count, round(stddev_samp(score), 4) AS std, round(var_samp(score), 4) AS var
FROM scored GROUP BY label""")
def label_stats(spark, sf):
    s = P.label_stats(V.scored(spark, sf))
    return s.select("label", *[_r4(F.col(c)).alias(c) for c in ("mean", "min", "max")],
                    F.col("count").cast("long"), _r4(F.col("std")).alias("std"), _r4(F.col("var")).alias("var"))


@query("label_share", SC + """
SELECT label, CAST(count(*) AS BIGINT) AS cnt, round(count(*) * 1.0 / sum(count(*)) OVER (), 4) AS share
FROM scored GROUP BY label""")
def label_share(spark, sf):
    s = P.label_share(V.scored(spark, sf))
    return s.select("label", F.col("cnt").cast("long"), _r4(F.col("share")).alias("share"))


@query("label_describe", SC + ",\n" + _describe_sql("scored", "score", "label") + "\nSELECT * FROM d")
def label_describe(spark, sf):
    s = V.scored(spark, sf)
    return P.describe(F.col("score"), s, ("label",)).select("label", *_desc_cols())


@query("label_histogram", SC + ",\n" + _hist_sql("scored", "score", 0.1, "label", density=True))
def label_histogram(spark, sf):
    h = P.histogram(V.scored(spark, sf), "score", 0.1, ("label",), density=True)
    return h.select("label", "bin", _r4(F.col("lo")).alias("lo"), F.col("cnt").cast("long"),
                    _r4(F.col("density")).alias("density"))


@query("split_sizes", with_views("mr") + """
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS INTEGER) AS n_cols FROM mr_pairs GROUP BY split""")
def split_sizes(spark, sf):
    m = V.mr_pairs(spark, sf)
    return m.groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn(
        "n_cols", F.lit(len(m.columns)).cast("int"))

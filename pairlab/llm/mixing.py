"""Mixing sources to target weights by temperature, with DataFrame operations only.

Source token shares q are raised to an exponent a in [0, 1] and normalised:
w = q^a / sum(q^a).  The exponent is bisected: the largest one whose weights have at least
``entropy_ratio`` of the greatest possible entropy, then, if that repeats some source more
than ``max_repeats`` times, the smallest one that does not (no exponent can: 1, the raw
shares).  One Spark job evaluates the 63 midpoints of six halvings over the source table.

The weights, rounded to ``1 / WEIGHT_UNIT``, are realised under a token budget: a source with
n tokens and a share T of the budget gives T div n whole passes, and in one pass more the
documents whose tokens fit into the rest.  A pass is a permutation of the source by
md5(pass:id); its first three hex digits are the block, so that block b of all passes and
sources holds the same mixture.  Where the last pass ends is found by radix descent: token
sums of the 4096 blocks, then of 4096 cells in the block that the rest ends in, then the rows
of that cell in order; no task ever holds more than a cell of one source.  Whether a row is
taken then needs only its own key and its source's row of the plan.

Edge cases: a null source is the source with an empty name; null and empty texts have no
tokens and cost nothing; a source without tokens has no weight and gives its rows once; rows
with equal ids stand at one place of the permutation and are taken together; an empty table
gives an empty one; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import WORD
from pairlab.session import scratch_path, shared_dir

#: Weights are whole numbers of this unit, so that budgets are exact integers.
WEIGHT_UNIT = 1_000_000
HALVINGS, ROUNDS = 6, 5
BLOCK_DIGITS = 3
#: A source's rows meet its row of the plan in so many parts, so that a source with a third of
#: all rows is not one partition.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def perm_key(epoch: Column, doc_id: Column) -> Column:
    """A row's place in a pass over its source."""
    return F.md5(F.concat_ws(":", epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (src, id, ...) with the columns of their source's row of the plan."""
    salt = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(SALTS))
    parts = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt.cast("long")).join(parts, ["src", "_salt"]).drop("_salt")


def _bisect(shares: DataFrame, holds_below: bool, test) -> float:
    """The end of [0, 1] nearest the change of ``test`` (alpha, z, zl, zr -> bool), which holds
    below it or above it.  z = sum q^a, zl = sum q^a ln q, zr = max q^(a-1)."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (hi - lo) / (1 << HALVINGS)
        points = [lo + step * i for i in range(1, 1 << HALVINGS)]
        rows = (shares.select("q", F.explode(F.array(*map(F.lit, points))).alias("a"))
                .groupBy("a").agg(F.sum(F.pow("q", F.col("a"))).alias("z"),
                                  F.sum(F.pow("q", F.col("a")) * F.log("q")).alias("zl"),
                                  F.max(F.pow("q", F.col("a") - 1)).alias("zr")).collect())
        good = {r["a"]: test(r["a"], r["z"], r["zl"], r["zr"]) for r in rows}
        left = sum(good[p] == holds_below for p in points)
        lo, hi = lo + step * left, lo + step * (left + 1)
    return lo if holds_below else hi


def exponent(sources: DataFrame, budget_ratio: float, entropy_ratio: float | None,
             max_repeats: float | None) -> float:
    """The bisected exponent for a table of (source, n_tokens)."""
    total, n = sources.agg(F.sum("n_tokens"), F.count_if(F.col("n_tokens") > 0)).first()
    if not total or n < 2:
        return 1.0
    shares = sources.where("n_tokens > 0").select((F.col("n_tokens") / F.lit(total)).alias("q"))

    def entropy_holds(a, z, zl, zr):
        return math.log(z) - a * zl / z >= entropy_ratio * math.log(n)

    def repeats_hold(a, z, zl, zr):
        return zr / z * budget_ratio <= max_repeats

    def at(a, test):
        r = shares.agg(F.sum(F.pow("q", F.lit(a))), F.sum(F.pow("q", F.lit(a)) * F.log("q")),
                       F.max(F.pow("q", F.lit(a - 1.0)))).first()
        return test(a, *r)

    a = 1.0
    if entropy_ratio is not None and not at(1.0, entropy_holds):
        a = _bisect(shares, True, entropy_holds)
    if max_repeats is not None and not at(a, repeats_hold):
        a = _bisect(shares, False, repeats_hold) if at(1.0, repeats_hold) else 1.0
    return a


def source_plan(narrow: DataFrame, budget_ratio: float, entropy_ratio: float | None,
                max_repeats: float | None) -> DataFrame:
    """(src, n_src, weight, passes, rest) of a table (src, id, n_tokens)."""
    sources = narrow.groupBy("src").agg(F.sum("n_tokens").alias("n_tokens")).checkpoint()
    a = exponent(sources, budget_ratio, entropy_ratio, max_repeats)
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    z = sources.where("n_tokens > 0").agg(F.sum(F.pow(F.col("n_tokens") / F.lit(max(total, 1)), F.lit(a)))).first()[0]
    weight = F.when(F.col("n_tokens") > 0, F.round(F.pow(F.col("n_tokens") / F.lit(max(total, 1)), F.lit(a))
                                                   / F.lit(z or 1.0) * WEIGHT_UNIT)).otherwise(0).cast("long")
    budget = int(total * budget_ratio)
    share = F.floor(F.col("weight").cast("decimal(38,0)") * F.lit(budget).cast("decimal(20,0)") / WEIGHT_UNIT).cast("long")
    return (sources.withColumn("weight", weight).withColumn("share", share)
            .select("src", F.col("n_tokens").alias("n_src"), "weight",
                    F.expr("if(n_tokens > 0, share div n_tokens, 0)").alias("passes"),
                    F.expr("if(n_tokens > 0, share % n_tokens, 0)").alias("rest")))


def cutoffs(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """(src, cut): the last key that the last pass of each source takes (no row: null)."""
    keyed = (_with_plan(narrow, plan.select("src", "passes", "rest"))
             .select("src", "n_tokens", "rest", perm_key(F.col("passes"), F.col("id")).alias("key")))
    inside = keyed.withColumn("before", F.lit(0).cast("long"))
    best = None
    for level in (1, 2, 3):
        digits = level * BLOCK_DIGITS
        cell = F.col("key") if level == 3 else F.substring("key", 1, digits)
        sums = (inside.groupBy("src", "rest", "before", cell.alias("cell")).agg(F.sum("n_tokens").alias("n")))
        order = Window.partitionBy("src").orderBy("cell")
        sums = sums.withColumn("cum", F.col("before") + F.sum("n").over(order))
        # the greatest cell that fits whole, and the first that doesn't
        found = sums.groupBy("src").agg(
            F.max(F.when(F.col("cum") <= F.col("rest"), F.col("cell"))).alias("fits"),
            F.max(F.when(F.col("cum") <= F.col("rest"), F.col("cum"))).alias("upto"),
            F.min(F.when(F.col("cum") > F.col("rest"), F.col("cell"))).alias("split"),
            F.min("before").alias("before")).checkpoint()
        # a cell that fits whole is a prefix; every key under it is at most prefix + 'g'
        upper = F.when(F.col("fits").isNotNull(), F.concat("fits", F.lit("g")))
        step = found.select("src", upper.alias("cut"))
        best = step if best is None else best.join(step.withColumnRenamed("cut", "cut2"), "src", "left").select(
            "src", F.coalesce("cut2", "cut").alias("cut"))
        if level < 3:
            deeper = found.where("split is not null").select(
                "src", "split", F.coalesce("upto", "before").alias("before"))
            inside = keyed.join(deeper.withColumnRenamed("split", "prefix"),
                                (keyed["src"] == deeper["src"]) & (F.substring("key", 1, digits) == F.col("prefix"))
                                ).select(keyed["src"], "n_tokens", "rest", "key", "before")
    return best


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        tokens: Column | None = None, budget_ratio: float = 1.0, entropy_ratio: float | None = 0.95,
        max_repeats: float | None = 4.0) -> DataFrame:
    """(row struct, n_tokens, weight, epoch, block, perm_key): the documents of the mixture,
    one row for every pass that takes them; ``row`` holds the columns of the document."""
    shared_dir(docs.sparkSession)
    tokens = n_words(F.col(text_col)) if tokens is None else tokens
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    narrow = docs.select(src.alias("src"), F.col(id_col).alias("id"), tokens.alias("n_tokens")).checkpoint()
    plan, path = source_plan(narrow, budget_ratio, entropy_ratio, max_repeats), scratch_path(docs.sparkSession, "mixture")
    # a written table has a known size: Spark sends a small one to the documents, and shuffles them for a large one
    plan.join(cutoffs(narrow, plan), "src", "left").write.parquet(path)
    plan = docs.sparkSession.read.parquet(path)
    rows = docs.select(F.struct("*").alias("row"), src.alias("src"), F.col(id_col).alias("id"),
                       tokens.alias("n_tokens"))
    last = F.coalesce(perm_key(F.col("passes"), F.col("id")) <= F.col("cut"), F.lit(False))
    n = F.col("passes") + F.when(last, 1).otherwise(0)
    epoch = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))
    key = perm_key(F.col("epoch"), F.col("id"))
    return (_with_plan(rows, plan.select("src", "weight", "passes", "cut"))
            .select("row", "id", "n_tokens", "weight", epoch.alias("epoch"))
            .select("row", "n_tokens", "weight", "epoch",
                    F.conv(F.substring(key, 1, BLOCK_DIGITS), 16, 10).cast("int").alias("block"),
                    key.alias("perm_key")))


def oracle(budget_ratio: float = 1.0, entropy_ratio: float = 0.95, max_repeats: float = 4.0) -> str:
    """The same rows as DuckDB SQL over ``documents``."""
    halvings = HALVINGS * ROUNDS
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
s AS (SELECT src, sum(n_tokens)::BIGINT AS n_src FROM d GROUP BY src),
t AS (SELECT sum(n_src)::BIGINT AS total, count(*) FILTER (n_src > 0) AS n FROM s),
q AS (SELECT list(n_src / total ORDER BY src) AS q, any_value(n) AS n FROM s, t WHERE n_src > 0),
f AS (SELECT 1.0::DOUBLE AS a, q, n FROM q),
e1 AS (SELECT ln(list_sum(list_transform(q, lambda x: x))) - list_sum(list_transform(q, lambda x: x * ln(x)))
       >= {entropy_ratio} * ln(n) AS ok FROM q),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, ln(list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2))))
          - (lo + hi) / 2 * list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2) * ln(x)))
            / list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2))) >= {entropy_ratio} * ln(n) AS ok
        FROM b, q WHERE i < {halvings})),
a1 AS (SELECT CASE WHEN (SELECT ok FROM e1) THEN 1.0 ELSE (SELECT lo FROM b WHERE i = {halvings}) END AS a),
r AS (SELECT a, list_max(list_transform(q, lambda x: pow(x, a - 1))) / list_sum(list_transform(q, lambda x: pow(x, a)))
        * {budget_ratio} <= {max_repeats} AS ok,
      list_max(list_transform(q, lambda x: pow(x, 0.0))) / list_sum(q) * {budget_ratio} <= {max_repeats} AS ok1 FROM a1, q),
c(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, list_max(list_transform(q, lambda x: pow(x, (lo + hi) / 2 - 1)))
          / list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2))) * {budget_ratio} <= {max_repeats} AS ok
        FROM c, q WHERE i < {halvings})),
ex AS (SELECT CASE WHEN (SELECT n FROM t) < 2 THEN 1.0 WHEN ok THEN a WHEN ok1 THEN (SELECT hi FROM c WHERE i = {halvings})
       ELSE 1.0 END AS a FROM r),
z AS (SELECT sum(pow(n_src / total, a)) AS z FROM s, t, ex WHERE n_src > 0),
w AS (SELECT src, n_src, CASE WHEN n_src > 0 THEN round(pow(n_src / total, a) / z * {WEIGHT_UNIT})::BIGINT ELSE 0 END AS weight,
      floor(total * {budget_ratio}::DOUBLE)::BIGINT AS budget FROM s, t, ex, z),
p AS (SELECT src, n_src, weight, CASE WHEN n_src > 0 THEN ((weight::HUGEINT * budget) // {WEIGHT_UNIT} // n_src)::BIGINT ELSE 0 END AS passes,
      CASE WHEN n_src > 0 THEN (((weight::HUGEINT * budget) // {WEIGHT_UNIT}) % n_src)::BIGINT ELSE 0 END AS rest FROM w),
k AS (SELECT d.*, weight, passes, rest, md5(concat(passes, ':', coalesce(doc_id::VARCHAR, ''))) AS key FROM d JOIN p USING (src)),
g AS (SELECT *, sum(n_tokens) OVER (PARTITION BY src ORDER BY key RANGE UNBOUNDED PRECEDING) <= rest AS last FROM k),
x AS (SELECT *, unnest(range(passes + CASE WHEN last THEN 1 ELSE 0 END)) AS epoch FROM g)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, weight, epoch::BIGINT AS epoch,
       ('0x' || substr(md5(concat(epoch, ':', coalesce(doc_id::VARCHAR, ''))), 1, {BLOCK_DIGITS}))::INT AS block,
       md5(concat(epoch, ':', coalesce(doc_id::VARCHAR, ''))) AS perm_key
FROM x
"""

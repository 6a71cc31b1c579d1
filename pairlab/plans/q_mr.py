"""Registered queries for MR operators (B1-B11) and split overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import mr as M
from pairlab.operators import overlap as O
from pairlab.plans import views as V
from pairlab.plans.registry import query
from pairlab.plans.sqlviews import with_views

ITEM = M.ITEM
MRV = with_views("mr")


def _mr(spark, sf):
    return V.mr_pairs(spark, sf)


def _sql(body: str) -> str:
    return MRV + ",\n" + body


PARSED = f"""parsed AS (SELECT inst_id, split, mr, regexp_extract_all(mr, '{ITEM}', 1) AS sl,
                          regexp_extract_all(mr, '{ITEM}', 2) AS vl FROM mr_pairs),
items AS (SELECT inst_id, CAST(i - 1 AS INTEGER) AS pos, sl[i] AS slot, vl[i] AS value
          FROM (SELECT *, unnest(generate_series(1, len(sl))) AS i FROM parsed))"""


def _delex_sql(col: str) -> str:
    sl = f"regexp_extract_all({col}, '{ITEM}', 1)"
    vl = f"regexp_extract_all({col}, '{ITEM}', 2)"
    return (f"array_to_string(list_sort(list_transform(generate_series(1, len({sl})), lambda i: "
            f"({sl})[i] || '=' || CASE WHEN ({sl})[i] IN ('name', 'near') THEN 'X-delex' ELSE ({vl})[i] END)), '|')")


@query("mr_parse", _sql(PARSED + "\nSELECT inst_id, pos, slot, value FROM items"))
def mr_parse(spark, sf):
    return M.mr_parse(_mr(spark, sf)).select("inst_id", "pos", "slot", "value")


@query("mr_slot_counts", _sql(PARSED + "\nSELECT slot, CAST(count(*) AS BIGINT) AS cnt FROM items GROUP BY ROLLUP (slot)"))
def mr_slot_counts(spark, sf):
    return M.mr_slot_counts(_mr(spark, sf)).select("slot", F.col("cnt").cast("long"))


@query("mr_slot_values", _sql(PARSED + "\nSELECT slot, value, CAST(count(*) AS BIGINT) AS cnt FROM items GROUP BY slot, value"))
def mr_slot_values(spark, sf):
    return M.mr_slot_values(_mr(spark, sf)).select("slot", "value", F.col("cnt").cast("long"))


def _notags_sql(sep: str) -> str:
    return (f"array_to_string(list_transform(list_filter(string_split(mr, ','), lambda p: regexp_matches(p, '\\[(.+?)\\]')),"
            f" lambda p: trim(regexp_extract(p, '\\[(.+?)\\]', 1))), '{sep}')")


@query("mr_remove_tags", _sql(f"SELECT inst_id, {_notags_sql(',')} AS notags, {_notags_sql(', ')} AS notags_blank FROM mr_pairs"))
def mr_remove_tags(spark, sf):
    m = _mr(spark, sf)
    return m.select("inst_id", M.remove_tags(F.col("mr"), ",").alias("notags"),
                    M.remove_tags(F.col("mr"), ", ").alias("notags_blank"))


def _shuffle_sql(sep: str) -> str:
    return ("array_to_string(list_transform(list_sort(list_transform(string_split(mr, ','), lambda p, i: "
            "{'k': md5('7|' || inst_id || '|' || (i - 1)), 'v': p})), lambda s: s.v), '" + sep + "')")


@query("mr_shuffle", _sql(f"SELECT inst_id, {_shuffle_sql(',')} AS shuffled, {_shuffle_sql(', ')} AS shuffled_blank FROM mr_pairs"))
def mr_shuffle(spark, sf):
    m = _mr(spark, sf)
    return m.select("inst_id", M.shuffle_items(F.col("mr"), F.col("inst_id"), "7", ",").alias("shuffled"),
                    M.shuffle_items(F.col("mr"), F.col("inst_id"), "7", ", ").alias("shuffled_blank"))


@query("mr_equal_sign", _sql("SELECT inst_id, replace(mr, '[', '=[') AS mr_eq FROM mr_pairs"))
def mr_equal_sign(spark, sf):
    return _mr(spark, sf).select("inst_id", M.equal_sign(F.col("mr")).alias("mr_eq"))


def _tags_sql(strict: bool) -> str:
    name = "trim(split_part(p, '=', 1))" if strict else \
        "CASE WHEN i = len(ps) THEN 'tag_name' ELSE trim(split_part(p, '=', 1)) END"
    return (f"array_to_string(list_transform(ps, lambda p, i: '<' || trim(split_part(p, '=', 1)) || '> ' || {name}"
            f" || '=' || split_part(p, '=', 2)), ', ')")


@query("mr_special_tags", _sql(f"""SELECT inst_id, {_tags_sql(True)} AS tagged, {_tags_sql(False)} AS tagged_ref
FROM (SELECT inst_id, string_split(replace(mr, '[', '=['), ',') AS ps FROM mr_pairs)"""))
def mr_special_tags(spark, sf):
    eq = M.equal_sign(F.col("mr"))
    return _mr(spark, sf).select("inst_id", M.special_tags(eq, True).alias("tagged"),
                                 M.special_tags(eq, False).alias("tagged_ref"))


@query("mr_prefix", _sql("""SELECT inst_id, 'data_to_text: ' || mr AS prefixed,
       CASE WHEN starts_with(ref, 'data_to_text: ') THEN substr(ref, 15) ELSE ref END AS unprefixed_ref,
       substr('data_to_text: ' || mr, 15) AS unprefixed FROM mr_pairs"""))
def mr_prefix(spark, sf):
    m = _mr(spark, sf)
    pre = M.add_prefix(F.col("mr"))
    return m.select("inst_id", pre.alias("prefixed"), M.remove_prefix(F.col("ref")).alias("unprefixed_ref"),
                    M.remove_prefix(pre).alias("unprefixed"))


@query("mr_delex", _sql(f"SELECT inst_id, {_delex_sql('mr')} AS key, {_delex_sql('orig_mr')} AS orig_key FROM mr_pairs"))
def mr_delex(spark, sf):
    m = _mr(spark, sf)
    return m.select("inst_id", M.delex_key(F.col("mr")).alias("key"), M.delex_key(F.col("orig_mr")).alias("orig_key"))


NORM = ("CASE slot WHEN 'eatType' THEN 'eat_type' WHEN 'priceRange' THEN 'price_range' "
        "WHEN 'familyFriendly' THEN 'family_friendly' WHEN 'customer rating' THEN 'rating' ELSE slot END")


@query("mr_counts", _sql(PARSED + f"""
SELECT inst_id, {NORM} AS slot, value, CAST(count(*) AS INTEGER) AS n FROM items GROUP BY ALL"""))
def mr_counts(spark, sf):
    return M.mr_counts(_mr(spark, sf)).select("inst_id", "slot", "value", "n")


@query("mr_render", _sql(PARSED + f""",
cnt AS (SELECT inst_id, {NORM} AS slot, value, count(*) AS n FROM items GROUP BY ALL),
ranked AS (SELECT inst_id, slot, value, n,
           list_position(['name', 'eat_type', 'food', 'price_range', 'rating', 'area', 'family_friendly', 'near'], slot) AS r
           FROM cnt),
txt AS (SELECT inst_id, string_agg(array_to_string(list_transform(generate_series(1, n), lambda x: slot || '[' || value || ']'), ', '),
               ', ' ORDER BY r, slot, value) AS t FROM ranked GROUP BY inst_id),
out AS (SELECT inst_id, replace(replace(replace(replace(t, 'rating[', 'customer rating['), 'eat_type', 'eatType'),
               'price_range', 'priceRange'), 'family_friendly', 'familyFriendly') AS mr_out FROM txt)
SELECT o.inst_id, o.mr_out, CAST(o.mr_out = m.mr AS INTEGER) AS same FROM out o JOIN mr_pairs m USING (inst_id)"""))
def mr_render(spark, sf):
    m = _mr(spark, sf)
    return m.select("inst_id", "mr", M.rendered(F.col("mr")).alias("mr_out")).select(
        "inst_id", "mr_out", (F.col("mr_out") == F.col("mr")).cast("int").alias("same"))


# ---------------------------------------------------------------- D1-D4

KEYS = f"""keyed AS (SELECT inst_id, split, {_delex_sql('coalesce(mr, \'\')')} AS key,
                 {_delex_sql('coalesce(orig_mr, \'\')')} AS orig_key FROM mr_pairs),
avoid_dev AS (SELECT key FROM keyed WHERE split = 'test' UNION SELECT orig_key FROM keyed WHERE split = 'test'),
avoid_train AS (SELECT key FROM avoid_dev UNION SELECT key FROM keyed WHERE split = 'devel')"""


def _splits(spark, sf):
    m = _mr(spark, sf)
    return (m.filter(F.col("split") == "train"), m.filter(F.col("split") == "devel"),
            m.filter(F.col("split") == "test"))


@query("devel_no_overlap", _sql(KEYS + """
SELECT inst_id FROM keyed WHERE split = 'devel' AND key NOT IN (SELECT key FROM avoid_dev)"""))
def devel_no_overlap(spark, sf):
    train, devel, test = _splits(spark, sf)
    return O.devel_no_overlap(devel, test).select("inst_id")


@query("train_no_overlap", _sql(KEYS + """
SELECT inst_id FROM keyed WHERE split = 'train' AND key NOT IN (SELECT key FROM avoid_train)"""))
def train_no_overlap(spark, sf):
    train, devel, test = _splits(spark, sf)
    return O.train_no_overlap(train, devel, test).select("inst_id")


def _report_sql(split: str, avoid: str) -> str:
    return f"""SELECT '{split}' AS split,
  CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS to_delete, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(DISTINCT CASE WHEN hit THEN key END) AS BIGINT) AS overlap_keys,
  CAST(count(DISTINCT key) AS BIGINT) AS distinct_keys,
  CAST(count(DISTINCT CASE WHEN NOT hit THEN key END) AS BIGINT) AS remaining_keys,
  CAST(count(DISTINCT orig_key) AS BIGINT) AS orig_keys,
  CAST(count(*) - sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS remaining_rows
FROM (SELECT key, orig_key, key IN (SELECT key FROM {avoid}) AS hit FROM keyed WHERE split = '{split}')"""


@query("overlap_report", _sql(KEYS + "\n" + _report_sql("devel", "avoid_dev") + "\nUNION ALL\n" + _report_sql("train", "avoid_train")))
def overlap_report(spark, sf):
    train, devel, test = _splits(spark, sf)
    r = O.overlap_report(train, devel, test)
    return r.select("split", *[F.col(c).cast("long") for c in
                               ("to_delete", "n_rows", "overlap_keys", "distinct_keys", "remaining_keys",
                                "orig_keys", "remaining_rows")])


@query("shared_keys", _sql(KEYS + """
SELECT 'test-devel' AS pair, key FROM (SELECT key FROM keyed WHERE split = 'test' INTERSECT SELECT key FROM keyed WHERE split = 'devel')
UNION ALL
SELECT 'devel-train' AS pair, key FROM (SELECT key FROM keyed WHERE split = 'devel' INTERSECT SELECT key FROM keyed WHERE split = 'train')
UNION ALL
SELECT 'test-train' AS pair, key FROM (SELECT key FROM keyed WHERE split = 'test' INTERSECT SELECT key FROM keyed WHERE split = 'train')"""))
def shared_keys(spark, sf):
    train, devel, test = _splits(spark, sf)
    out = None
    for name, a, b in (("test-devel", test, devel), ("devel-train", devel, train), ("test-train", test, train)):
        s = O.shared_keys(a, b).select(F.lit(name).alias("pair"), "key")
        out = s if out is None else out.unionByName(s)
    return out

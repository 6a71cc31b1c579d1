"""Registered queries for semantic-noise detection and repair.

The oracles are *key* oracles: the fixture plants its errors by arithmetic on the
order key (``plans/views.py``), so the expected slots, errors, differences and
repaired MRs follow from the key alone, independent of the regex patterns (which
DuckDB's engine could not run: it has no look-behind and ASCII-only word
boundaries).  Rule for the key oracle: a slot is *mentioned* when present and not
dropped (c in 0,3 drops the last present slot), or when it is the first absent slot
and c in 1,3; with c = 2 the area fragment names the other area value; when name
and near are both The Rice Boat, both spans tie with a gold value and both drop.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import noise as N
from pairlab.plans import fixtures as fx
from pairlab.plans import views as V
from pairlab.plans.registry import query
from pairlab.plans.sqlviews import mr_base_sql, with_views

# fixture phrases that several values' patterns match: value -> first value in pattern order
FIRST_IN_ORDER = {3: {"high": "more than £30"},
                  4: {"high": "5 out of 5", "average": "3 out of 5", "low": "1 out of 5"}}
TRB_NAME = fx.NAMES.index("The Rice Boat")
TRB_NEAR = fx.NEARS.index("The Rice Boat")


def _slots_sql() -> str:
    parts = []
    for s in range(8):
        ment = f"(p{s} AND NOT (c IN (0, 3) AND last_slot = {s})) OR (c IN (1, 3) AND first_absent = {s})"
        oval = "CASE WHEN c = 2 THEN ['city centre', 'riverside'][2 - i5] ELSE v5 END" if s == 5 else f"v{s}"
        if s in FIRST_IN_ORDER:  # an absent slot's ambiguous phrase goes to the first value in pattern order
            cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FIRST_IN_ORDER[s].items())
            oval = f"CASE WHEN p{s} THEN v{s} ELSE CASE v{s} {cases} ELSE v{s} END END"
        parts.append(f"SELECT k, {s} AS s, '{fx.NORM_SLOTS[s]}' AS slot, '{fx.MR_SLOTS[s]}' AS mrslot, "
                     f"v{s} AS gval, p{s} AS gold, ({ment}) AS ment, {oval} AS oval, c, "
                     f"(i0 = {TRB_NAME} AND p7 AND i7 = {TRB_NEAR}) AS t2 FROM mr_k")
    return "slots AS (" + "\n  UNION ALL ".join(parts) + ")"


KEYED = "WITH " + mr_base_sql() + ",\n" + _slots_sql() + """,
eff AS (SELECT *, ment AND NOT (t2 AND s IN (0, 7)) AS m FROM slots),
frag AS (SELECT *, CASE
    WHEN gold AND NOT m THEN '"' || slot || '":{"' || gval || '":-1}'
    WHEN NOT gold AND m THEN '"' || slot || '":{"' || oval || '":1}'
    WHEN gold AND m AND gval <> oval THEN '"' || slot || '":{' ||
         CASE WHEN gval < oval THEN '"' || gval || '":-1,"' || oval || '":1'
              ELSE '"' || oval || '":1,"' || gval || '":-1' END || '}'
    END AS fr FROM eff),
per AS (SELECT k AS inst_id,
    CAST(sum(CASE WHEN NOT gold AND m THEN 1 ELSE 0 END) AS INTEGER) AS added,
    CAST(sum(CASE WHEN gold AND NOT m THEN 1 ELSE 0 END) AS INTEGER) AS missing,
    CAST(sum(CASE WHEN gold AND m AND gval <> oval THEN 1 ELSE 0 END) AS INTEGER) AS valerr,
    CAST(0 AS INTEGER) AS repeated,
    CAST(sum(CASE WHEN gold THEN 1 ELSE 0 END) AS INTEGER) AS mr_len,
    coalesce('{' || string_agg(fr, ',' ORDER BY slot) || '}', '{}') AS diff,
    coalesce(string_agg(CASE WHEN m THEN mrslot || '[' || oval || ']' END, ', ' ORDER BY s), '') AS fixed_mr
  FROM frag GROUP BY k),
errs AS (SELECT p.*, m.mr, m.ref, m.split,
    CASE WHEN (added > 0 AND missing > 0) OR valerr > 0 THEN 'M+A' WHEN added > 0 OR repeated > 0 THEN 'Add'
         WHEN missing > 0 THEN 'Mis' ELSE 'OK' END AS cls
  FROM per p JOIN mr_pairs m USING (inst_id))
"""


def _keyed(select: str) -> str:
    # mr_pairs is needed next to the key CTEs: reuse its own definition
    mr = with_views("mr")[len("WITH "):]
    mr_only = mr[mr.index("mr_pairs AS"):]
    return KEYED.replace("per AS (", mr_only + ",\nper AS (", 1) + select


def _errors(spark, sf, **kw):
    return N.instance_errors(V.mr_pairs(spark, sf), **kw)


@query("slot_matches")
def slot_matches(spark, sf):
    """Every pattern match with its span (rows-only check; unit tests cover it)."""
    sp = N.with_spans(V.mr_pairs(spark, sf).select("inst_id", "mr", "ref"))
    return N.slot_matches(sp, "all").select("inst_id", "slot", "value", "start", "end")


@query("resolve_matches", _keyed("SELECT k AS inst_id, slot, oval AS value FROM eff WHERE m"))
def resolve_matches(spark, sf):
    sp = N.with_spans(V.mr_pairs(spark, sf).select("inst_id", "mr", "ref"))
    return N.slot_matches(sp, "kept").select("inst_id", "slot", "value")


@query("reclassify_mr", _keyed("SELECT k AS inst_id, slot, oval AS value, CAST(1 AS INTEGER) AS n FROM eff WHERE m"))
def reclassify_mr(spark, sf):
    sp = N.with_spans(V.mr_pairs(spark, sf).select("inst_id", "mr", "ref"))
    return N.reclassify_mr(sp).select("inst_id", "slot", "value", "n")


@query("slot_diff", _keyed("SELECT inst_id, added, missing, valerr, repeated FROM errs"))
def slot_diff(spark, sf):
    return _errors(spark, sf).select("inst_id", "added", "missing", "valerr", "repeated")


@query("slot_diff_json", _keyed("SELECT inst_id, diff FROM errs"))
def slot_diff_json(spark, sf):
    return _errors(spark, sf).select("inst_id", "diff")


@query("fix_mr", _keyed("SELECT inst_id, fixed_mr FROM errs"))
def fix_mr(spark, sf):
    return _errors(spark, sf).select("inst_id", "fixed_mr")


@query("slot_error_dump", _keyed("SELECT inst_id, mr, ref, added, missing, valerr, repeated, mr_len, diff, fixed_mr FROM errs"))
def slot_error_dump(spark, sf):
    return _errors(spark, sf).select("inst_id", "mr", "ref", "added", "missing", "valerr", "repeated",
                                     "mr_len", "diff", "fixed_mr")


@query("fixed_csv", _keyed("SELECT inst_id, fixed_mr AS mr, ref, CAST(fixed_mr <> mr AS INTEGER) AS fixed, mr AS orig_mr FROM errs"))
def fixed_csv(spark, sf):
    return N.fixed_rows(_errors(spark, sf))


@query("instance_class", _keyed("SELECT inst_id, cls FROM errs"))
def instance_class(spark, sf):
    return _errors(spark, sf).select("inst_id", "cls")


def _stats_sql(keys: str) -> str:
    sel = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return _keyed(f"""SELECT {sel}CAST(count(*) AS BIGINT) AS total_insts, CAST(sum(mr_len) AS BIGINT) AS total_attr,
  round((sum(added) + sum(missing) + sum(valerr) + sum(repeated)) / sum(mr_len), 4) AS semerr,
  round(sum(added) / sum(mr_len), 4) AS ins_rate, round(sum(missing) / sum(mr_len), 4) AS del_rate,
  round(sum(valerr) / sum(mr_len), 4) AS wvl_rate,
  CAST(sum(added) AS BIGINT) AS added, CAST(sum(missing) AS BIGINT) AS missing,
  CAST(sum(valerr) AS BIGINT) AS valerr, CAST(sum(repeated) AS BIGINT) AS repeated,
  round(avg(CASE WHEN cls = 'OK' THEN 1.0 ELSE 0.0 END), 4) AS inst_ok,
  round(avg(CASE WHEN cls = 'Add' THEN 1.0 ELSE 0.0 END), 4) AS inst_add,
  round(avg(CASE WHEN cls = 'Mis' THEN 1.0 ELSE 0.0 END), 4) AS inst_mis,
  round(avg(CASE WHEN cls = 'M+A' THEN 1.0 ELSE 0.0 END), 4) AS inst_ma,
  CAST(sum(CASE WHEN fixed_mr = mr THEN 1 ELSE 0 END) AS BIGINT) AS identical
FROM errs {grp}""")


def _stats_df(df, keys=()):
    st = N.error_stats(df, keys)
    out = [*keys, F.col("total_insts").cast("long"), F.col("total_attr").cast("long")]
    for c in ("semerr", "ins_rate", "del_rate", "wvl_rate"):
        out.append(F.round(c, 4).alias(c))
    for c in ("added", "missing", "valerr", "repeated"):
        out.append(F.col(c).cast("long"))
    for c in ("inst_ok", "inst_add", "inst_mis", "inst_ma"):
        out.append(F.round(c, 4).alias(c))
    out.append(F.col("identical").cast("long"))
    return st.select(*out)


@query("slot_error_stats", _stats_sql(""))
def slot_error_stats(spark, sf):
    return _stats_df(_errors(spark, sf))


@query("slot_error_by_file", _stats_sql("split"))
def slot_error_by_file(spark, sf):
    return _stats_df(_errors(spark, sf, keep=("split",)), ("split",))

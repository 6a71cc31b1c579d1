"""The fixture views as DuckDB SQL (CTE bodies) for the oracle queries.

Written independently of the Spark code in ``views.py``: same rules, plain SQL.
DuckDB lists are 1-based; Spark arrays in ``views.py`` are 0-based in lambdas.
"""

from __future__ import annotations

from pairlab.plans import fixtures as fx


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SEG_REFS = """
seg_docs AS (SELECT doc_id AS inst_id, coalesce(text, '') AS text,
                    string_split(coalesce(text, ''), ' ') AS t FROM documents),
seg_refs AS (
  SELECT inst_id, 0 AS ref_no, text AS ref FROM seg_docs
  UNION ALL
  SELECT inst_id, 1 AS ref_no,
         array_to_string(list_filter(t, lambda x, i: (i - 1 + inst_id) % 5 <> 2), ' ') AS ref
  FROM seg_docs
  UNION ALL
  SELECT inst_id, 2 AS ref_no, array_to_string(t[4:], ' ') AS ref FROM seg_docs WHERE inst_id % 2 = 0
),
seg_sys AS (
  SELECT inst_id, array_to_string(list_filter(t, lambda x, i: (i - 1 + inst_id) % 7 <> 0), ' ') AS sys
  FROM seg_docs
),
seg_sys2 AS (
  SELECT inst_id, array_to_string(list_filter(t, lambda x, i: (i - 1 + inst_id) % 3 <> 1), ' ') AS sys
  FROM seg_docs
),
seg_pairs AS (SELECT r.inst_id, r.ref_no, r.ref, s.sys FROM seg_refs r JOIN seg_sys s USING (inst_id))"""


def mr_base_sql() -> str:
    """mr_k: per order key the planted-error parameters and slot values."""
    cols = ["o_orderkey AS k", "(o_orderkey // 10) % 10 AS c",
            "CASE WHEN (o_orderkey + 7) % 4 <> 0 THEN 7 ELSE 6 END AS last_slot",
            "4 - o_orderkey % 4 AS first_absent"]
    for s, (p, vals) in enumerate(zip(fx.SLOT_DIVISORS, fx.VALUES)):
        cols.append(f"(o_orderkey // {p}) % {len(vals)} AS i{s}")
        cols.append(f"{_sql_list(vals)}[(o_orderkey // {p}) % {len(vals)} + 1] AS v{s}")
        frags = [fx.FRAGMENTS[s][v] for v in vals]
        cols.append(f"{_sql_list(frags)}[(o_orderkey // {p}) % {len(vals)} + 1] AS f{s}")
        cols.append("TRUE AS p0" if s == 0 else f"(o_orderkey + {s}) % 4 <> 0 AS p{s}")
    other_area = _sql_list([fx.FRAGMENTS[5][v] for v in fx.AREAS])
    cols.append(f"{other_area}[2 - (o_orderkey // {fx.SLOT_DIVISORS[5]}) % 2] AS f5_other")
    return "mr_k AS (SELECT " + ",\n  ".join(cols) + " FROM orders)"


def mr_pairs_sql() -> str:
    items = ", ".join(f"CASE WHEN p{s} THEN '{fx.MR_SLOTS[s]}[' || v{s} || ']' END" for s in range(8))
    items_wo = ", ".join(f"CASE WHEN p{s} AND last_slot <> {s} THEN '{fx.MR_SLOTS[s]}[' || v{s} || ']' END"
                         for s in range(8))
    pieces = []
    for s in range(8):
        cond = f"(p{s} AND NOT (c IN (0, 3) AND last_slot = {s})) OR (c IN (1, 3) AND first_absent = {s})"
        text = f"CASE WHEN c = 2 THEN f5_other ELSE f5 END" if s == 5 else f"f{s}"
        pieces.append(f"CASE WHEN {cond} THEN {text} END")
    return (mr_base_sql() + ",\nmr_pairs AS (SELECT k AS inst_id,\n"
            "  CASE WHEN k % 10 = 0 THEN 'test' WHEN k % 10 = 1 THEN 'devel' ELSE 'train' END AS split,\n"
            f"  concat_ws(', ', {items}) AS mr,\n"
            f"  CASE WHEN k % 5 = 0 THEN concat_ws(', ', {items_wo}) ELSE concat_ws(', ', {items}) END AS orig_mr,\n"
            f"  concat_ws(', ', {', '.join(pieces)}) || '.' AS ref\n"
            "FROM mr_k)")


CAPTIONS = """
captions AS (
  SELECT conv_id * 100 + turn AS id, conv_id AS image_id,
         CAST(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS INTEGER) AS category_id,
         text AS caption,
         CAST((conv_id * 100 + turn) % 13 AS DOUBLE) AS x, CAST((conv_id * 100 + turn) % 7 AS DOUBLE) AS y,
         CAST((conv_id * 100 + turn) % 5 + 1 AS DOUBLE) AS w, CAST((conv_id * 100 + turn) % 3 + 1 AS DOUBLE) AS h,
         CAST(((conv_id * 100 + turn) % 4 = 0) AS INTEGER) AS iscrowd
  FROM conversations)"""

RUNS = """
runs AS (
  SELECT 'v' || event_id AS version, event_type AS exp, value AS "BLEU",
         value * 1.5 AS "NIST", value * 0.25 AS "METEOR", value * 0.5 AS "ROUGE_L", value * 2.0 AS "CIDEr",
         '{''num_beams'': ' || (event_id % 7 + 1) || ', ''do_sample'': ' ||
           CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END ||
           ', ''top_k'': ' || coalesce(json_extract_string(props, '$.k'), '0') ||
           ', ''optimizer'': ''' || ['adam', 'rmsprop', 'sgd'][event_id % 3 + 1] || '''}' AS params,
         '/r/' || event_type || '/output/' || event_id || '/x.txt' AS file
  FROM events)"""

TRAIN_RUNS = """
train_runs AS (
  SELECT p_partkey AS id,
         ['t5-small', 't5-base'][p_partkey % 2 + 1] AS model_size,
         ['adam', 'rmsprop', 'sgd'][p_partkey % 3 + 1] AS optimizer,
         ['0.001', '0.0005', '0.0001', 'custom'][p_partkey % 4 + 1] AS learning_rate,
         p_size / 100.0 AS lr_mod,
         (p_retailprice % 100) / 100.0 AS train_accuracy,
         p_retailprice / 1200.0 + (p_partkey % 7) / 1000.0 AS train_loss,
         (p_retailprice % 37) / 37.0 AS val_accuracy,
         p_retailprice / 1000.0 + (p_partkey % 5) / 100.0 AS val_loss,
         p_retailprice / 10.0 AS total_time,
         p_size * 2.5 AS avg_epoch_time,
         CASE WHEN p_partkey % 11 <> 0 THEN 5 END AS epoch_num,
         [60, 90, 120][p_partkey % 3 + 1] AS encoder_max_len,
         [60, 90, 120][(p_partkey // 3) % 3 + 1] AS decoder_max_len,
         CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END AS is_special_token
  FROM part)"""

EPOCH_HIST = """
epoch_hist AS (
  SELECT l_orderkey AS run_id, l_linenumber AS epoch,
         min(l_quantity / 10.0) AS loss, min(l_extendedprice / 100000.0) AS val_loss,
         min(1 - l_discount) AS accuracy, min(1 - l_tax) AS val_accuracy,
         min(l_discount / 100.0) AS lr, min(l_quantity * 2.0) AS secs
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

SCORED = """
scored AS (
  SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
         1.0 / (d.doc_id % 97 + 1) AS score, d.text
  FROM documents d JOIN labels l USING (doc_id))"""


def with_views(*names: str) -> str:
    """WITH clause holding the named views (in dependency order)."""
    parts = []
    for n in names:
        if n == "seg":
            parts.append(SEG_REFS.strip())
        elif n == "mr":
            parts.append(mr_pairs_sql())
        else:
            parts.append({"captions": CAPTIONS, "runs": RUNS, "train_runs": TRAIN_RUNS,
                          "epoch_hist": EPOCH_HIST, "scored": SCORED}[n].strip())
    return "WITH " + ",\n".join(parts)

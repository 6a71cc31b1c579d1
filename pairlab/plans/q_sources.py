"""Registered queries for sources, sinks, integrity checks and caption sets.

File round trips write data derived from the driver tables into the shared scratch
folder (``spark.checkpoint.dir``) and read it back with the readers under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.plans import views as V
from pairlab.plans.registry import query
from pairlab.plans.sqlviews import with_views
from pairlab.session import scratch_path
from pairlab.sources import captions as C
from pairlab.sources import io as IO
from pairlab.sources.tables import table

MRV = with_views("mr")
CAP = with_views("captions")


@query("check_alignment", MRV + "\nSELECT inst_id, mr AS a, orig_mr AS b FROM mr_pairs WHERE mr IS DISTINCT FROM orig_mr")
def check_alignment(spark, sf):
    m = V.mr_pairs(spark, sf)
    return IO.check_alignment(m.select("inst_id", F.col("mr").alias("src")),
                              m.select("inst_id", F.col("orig_mr").alias("src"))).select("inst_id", "a", "b")


@query("group_refs", MRV + """,
asked AS (SELECT inst_id, CASE WHEN inst_id % 7 = 0 THEN 'unknown ' || inst_id ELSE mr END AS mr FROM mr_pairs WHERE split = 'test'),
refs AS (SELECT mr, row_number() OVER (PARTITION BY mr ORDER BY inst_id) - 1 AS ref_no, ref FROM mr_pairs WHERE split <> 'test' OR inst_id % 7 <> 0)
SELECT asked.inst_id, asked.mr, CAST(ref_no AS INTEGER) AS ref_no, ref,
       CASE WHEN ref_no IS NULL THEN 'no reference for source: ' || asked.mr END AS error FROM asked LEFT JOIN refs USING (mr)""")
def group_refs(spark, sf):
    """References of the test sources, by source in file order; a source without any is an error row."""
    m = V.mr_pairs(spark, sf)
    odd = F.col("inst_id") % 7 == 0
    asked = m.where("split = 'test'").select("inst_id", F.when(odd, F.concat(F.lit("unknown "), F.col("inst_id").cast("string"))).otherwise(F.col("mr")).alias("mr"))
    return IO.refs_by_source(asked, m.where((F.col("split") != "test") | ~odd))


@query("group_refs_consecutive", """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS nw
           FROM conversations),
r AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no FROM c)
SELECT conv_id, CAST(run_no AS BIGINT) AS run_no, any_value(role) AS value, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY conv_id, run_no""")
def group_refs_consecutive(spark, sf):
    c = table(spark, sf, "conversations")
    return IO.group_consecutive(c, "conv_id", "turn", "role").select(
        "conv_id", F.col("run_no").cast("long"), "value", F.col("n").cast("long"))


@query("pad_ref_matrix", with_views("seg") + """,
mx AS (SELECT max(ref_no) AS m FROM seg_refs),
grid AS (SELECT DISTINCT inst_id, unnest(generate_series(0, (SELECT m FROM mx))) AS ref_no FROM seg_refs)
SELECT g.inst_id, CAST(g.ref_no AS INTEGER) AS ref_no, CAST(r.ref IS NULL AS INTEGER) AS is_pad,
       md5(coalesce(r.ref, '')) AS ref_md5
FROM grid g LEFT JOIN seg_refs r USING (inst_id, ref_no)""")
def pad_ref_matrix(spark, sf):
    refs = V.seg_refs(spark, sf)
    p = IO.pad_ref_matrix(refs).join(refs.select("inst_id", "ref_no", F.lit(0).alias("real")), ["inst_id", "ref_no"], "left")
    return p.select("inst_id", F.col("ref_no").cast("int"), F.col("real").isNull().cast("int").alias("is_pad"),
                    F.md5(F.col("ref").cast("binary")).alias("ref_md5"))


@query("caption_index", CAP + """
SELECT image_id, CAST(count(*) AS BIGINT) AS n_captions, min(id) AS first_id, max(id) AS last_id FROM captions GROUP BY image_id""")
def caption_index(spark, sf):
    return C.caption_index(V.captions(spark, sf))


def _large(c):
    """Images of six captions or more."""
    return C.caption_index(c).where("n_captions >= 6").select("image_id")


@query("caption_filter", CAP + """,
imgs AS (SELECT image_id FROM captions GROUP BY image_id HAVING count(*) >= 6)
SELECT id FROM captions WHERE image_id IN (SELECT image_id FROM imgs) AND category_id IN (1, 2)
  AND w * h > 2 AND w * h < 12 AND iscrowd = 0""")
def caption_filter(spark, sf):
    c = V.captions(spark, sf)
    return C.filter_captions(c, images=_large(c), categories=[1, 2], area=(2, 12), crowd=0)


CATS = """cats AS (SELECT DISTINCT category_id AS id, CASE category_id WHEN 0 THEN 'system' WHEN 1 THEN 'user' ELSE 'assistant' END AS name,
               CASE WHEN category_id = 0 THEN 'prompt' ELSE 'speaker' END AS supercategory FROM captions)"""


def _cats(c):
    return c.select(F.col("category_id").alias("id")).distinct().select(
        "id", F.when(F.col("id") == 0, "system").when(F.col("id") == 1, "user").otherwise("assistant").alias("name"),
        F.when(F.col("id") == 0, "prompt").otherwise("speaker").alias("supercategory"))


@query("category_filter", CAP + ",\n" + CATS + "\nSELECT id FROM cats WHERE name IN ('user', 'system') AND supercategory = 'speaker'")
def category_filter(spark, sf):
    return C.filter_categories(_cats(V.captions(spark, sf)), names=["user", "system"], supers=["speaker"])


@query("images_by_category", CAP + """
SELECT image_id FROM captions WHERE category_id IN (1, 2) GROUP BY image_id HAVING count(DISTINCT category_id) = 2""")
def images_by_category(spark, sf):
    """The images that have both categories."""
    return C.images_with(V.captions(spark, sf), [1, 2])


@query("load_by_ids", CAP + """,
ids AS (SELECT image_id FROM captions GROUP BY image_id HAVING count(*) >= 6)
SELECT id, image_id, category_id FROM captions WHERE image_id IN (SELECT image_id FROM ids)""")
def load_by_ids(spark, sf):
    c = V.captions(spark, sf)
    return C.load_by_ids(c, _large(c), "image_id").select("id", "image_id", "category_id")


@query("attach_results", CAP + """,
res AS (SELECT image_id, id FROM captions WHERE category_id = 2),
imgs AS (SELECT DISTINCT image_id FROM captions WHERE category_id = 1 AND image_id % 5 <> 0)
SELECT CAST(row_number() OVER (ORDER BY image_id, id) AS BIGINT) AS res_id, image_id, id, NULL AS error
FROM res WHERE image_id IN (SELECT image_id FROM imgs)
UNION ALL SELECT NULL, image_id, id, 'its image is not in the set' FROM res WHERE image_id NOT IN (SELECT image_id FROM imgs)""")
def attach_results(spark, sf):
    """Results of known images, numbered; the others are error rows."""
    c = V.captions(spark, sf)
    images = c.where("category_id = 1 AND image_id % 5 <> 0").select("image_id")
    kept, rejected = C.attach_results(c.where("category_id = 2").select("image_id", "id"), images, [F.col("image_id"), F.col("id")])
    return kept.select("res_id", "image_id", "id", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select(F.lit(None).cast("long").alias("res_id"), "image_id", "id", "error"))


@query("box_enrich", CAP + """
SELECT id, x AS x1, y AS y1, x AS x2, y + h AS y2, x + w AS x3, y + h AS y3, x + w AS x4, y AS y4, w * h AS area,
       CAST(0 AS INTEGER) AS iscrowd FROM captions""")
def box_enrich(spark, sf):
    return C.box_enrich(V.captions(spark, sf))


# ---------------------------------------------------------------- file round trips

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("read_lines", with_views("seg") + f"""
SELECT row_number() OVER (ORDER BY inst_id) - 1 AS inst_id, md5({TRIM.format("replace(sys, chr(10), ' ')")}) AS line_md5 FROM seg_sys""")
def read_lines(spark, sf):
    p = scratch_path(spark, "sys-lines")
    IO.write_text_outputs(V.seg_sys(spark, sf), p, "sys")
    return IO.read_lines(spark, p, across=True).select("inst_id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("read_multi_ref", MRV + """,
numbered AS (SELECT row_number() OVER (ORDER BY inst_id) - 1 AS inst_id, ref, orig_mr FROM mr_pairs)
SELECT inst_id, 0 AS ref_no, ref FROM numbered UNION ALL SELECT inst_id, 1, orig_mr FROM numbered""")
def read_multi_ref(spark, sf):
    """Every row writes its group of lines and the blank line behind it, in many files."""
    p = scratch_path(spark, "multi-ref")
    V.mr_pairs(spark, sf).orderBy("inst_id").select(F.concat_ws("\n", "ref", "orig_mr", F.lit("")).alias("value")).write.text(p)
    return IO.across_files(IO.read_multi_ref(spark, p)).select("inst_id", "ref_no", "ref")


@query("read_pairs_csv", MRV + "\nSELECT mr AS src, ref AS sys FROM mr_pairs")
def read_pairs_csv(spark, sf):
    p = scratch_path(spark, "pairs-tsv")
    V.mr_pairs(spark, sf).select(F.col("mr").alias("MR"), F.col("ref").alias("output")).write.csv(p, sep="\t", header=True)
    return IO.read_pairs_csv(spark, p)


def _squeezed(text):
    return F.md5(F.trim(F.regexp_replace(text, r"\s+", " ")).cast("binary"))


@query("read_mt_xml", with_views("seg") + r"""
SELECT 'sys' AS sysid, CAST(inst_id // 50 AS VARCHAR) AS doc, inst_id AS seg, md5(trim(regexp_replace(sys, '\s+', ' ', 'g'))) AS text_md5,
       inst_id // 50 % 4 = 0 AS wrong_size FROM seg_sys""")
def read_mt_xml(spark, sf):
    """A set written and read; documents whose number of segments differs from the source's are marked (the
    source lacks a segment in every fourth)."""
    p = scratch_path(spark, "mt-xml")
    s = V.seg_sys(spark, sf).select(F.floor(F.col("inst_id") / 50).cast("long").alias("doc"), F.col("inst_id").alias("seg"), F.col("sys").alias("text"))
    IO.write_mt_xml(s, p)
    got = IO.read_mt_xml(spark, p)
    source = s.where("NOT (doc % 4 = 0 AND seg % 50 = 0)").select(F.col("doc").cast("string").alias("doc"))
    wrong = IO.check_doc_sizes(got, source).select("sysid", "doc", F.lit(True).alias("w"))
    return got.join(wrong, ["sysid", "doc"], "left").select("sysid", "doc", "seg", _squeezed(F.col("text")).alias("text_md5"),
                                                            F.coalesce("w", F.lit(False)).alias("wrong_size"))


def _scores_sql() -> str:
    from pairlab.plans.q_scores import _bleu_sql
    cells = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN printf('%.4f', {c}) END AS {c}" for c in ("bleu", "sent_bleu"))
    return f"SELECT CAST(inst_id AS VARCHAR) AS inst_id, {cells} FROM ({_bleu_sql('segment')})"


@query("write_scores_tsv", _scores_sql)
def write_scores_tsv(spark, sf):
    from pairlab.plans.q_scores import bleu_segment
    p = scratch_path(spark, "scores-tsv")
    IO.write_scores_tsv(bleu_segment(spark, sf), p, ["bleu", "sent_bleu"])
    return spark.read.csv(p, sep="\t", header=True)


RUN_SCHEMA = "version STRING, exp STRING, BLEU DOUBLE, NIST DOUBLE, METEOR DOUBLE, ROUGE_L DOUBLE, CIDEr DOUBLE, params STRING, file STRING"


@query("save_run", with_views("runs") + '\nSELECT version, exp, "BLEU", "NIST", "METEOR", "ROUGE_L", "CIDEr", params, file FROM runs')
def save_run(spark, sf):
    """Every run saved as a CSV row and read back."""
    p = scratch_path(spark, "runs")
    IO.save_run(V.runs(spark, sf), p)
    return IO.read_runs(spark, p, RUN_SCHEMA).drop("_path")


@query("read_runs", with_views("runs") + """
SELECT version, exp, "BLEU", CASE WHEN exp <> 'click' THEN "METEOR" END AS "METEOR", params, exp AS folder FROM runs""")
def read_runs(spark, sf):
    """A tree of files whose headers differ: one experiment's has other columns, in another order."""
    p = scratch_path(spark, "runs-all")
    runs = V.runs(spark, sf)
    IO.save_run(runs.where("exp <> 'click'"), p)
    IO.save_run(runs.where("exp = 'click'").select("params", "BLEU", "exp", "version"), p)
    got = IO.read_runs(spark, p, RUN_SCHEMA)
    return got.select("version", "exp", "BLEU", "METEOR", "params", F.regexp_extract("_path", "/exp=([^/]*)/", 1).alias("folder"))


@query("read_train_json", with_views("train_runs") + "\nSELECT * FROM train_runs")
def read_train_json(spark, sf):
    p = scratch_path(spark, "train-json")
    V.train_runs(spark, sf).write.json(p)
    return IO.read_train_json(spark, p, multi_line=False)


def _outputs_sql() -> str:
    from pairlab.plans.q_encode import _gen_sql
    return f"SELECT row_number() OVER (ORDER BY inst_id) AS line_no, gen AS value FROM ({_gen_sql()})"


@query("write_text_outputs", _outputs_sql)
def write_text_outputs(spark, sf):
    from pairlab.operators.infer import batch_generate
    p = scratch_path(spark, "gen-text")
    IO.write_text_outputs(batch_generate(V.mr_pairs(spark, sf)), p, "gen")
    return IO.numbered_lines(spark, p, across=True).select("line_no", "value")


@query("check_columns", MRV + """,
placed AS (SELECT *, row_number() OVER (ORDER BY inst_id) AS line_no FROM mr_pairs)
SELECT line_no, inst_id || ',' || split || ',extra' AS line FROM placed WHERE mr <> orig_mr""")
def check_columns(spark, sf):
    """A4: lines whose field count differs, by number.  The file gets a third field on rows whose MR
    differs from the original MR."""
    p = scratch_path(spark, "ragged-csv")
    more = F.when(F.col("mr") != F.col("orig_mr"), F.lit("extra"))
    V.mr_pairs(spark, sf).orderBy("inst_id").select(F.concat_ws(",", F.col("inst_id").cast("string"), F.col("split"), more).alias("value")).write.text(p)
    return IO.check_columns(spark, p, 2, across=True).select("line_no", "line")

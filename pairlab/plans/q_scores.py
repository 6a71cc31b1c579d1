"""Registered queries for tokenising, n-gram statistics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import ngrams as G
from pairlab.operators import scores as S
from pairlab.plans import sqltext as Q
from pairlab.plans import views as V
from pairlab.plans.registry import query
from pairlab.plans.sqlviews import with_views
from pairlab.sources.tables import table


def _r4(c):
    return F.round(c, 4).cast("double")


# ---------------------------------------------------------------- E1-E4 tokenisers

def _tok_sql(expr: str) -> str:
    return f"""SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tok, md5(array_to_string(toks, ' ')) AS tok_md5
FROM (SELECT doc_id, {expr} AS toks FROM documents)"""


@query("tokenize_mteval", lambda: _tok_sql(Q.mteval_tokens("text", "mteval")))
def tokenize_mteval(spark, sf):
    d = table(spark, sf, "documents")
    toks = T.lower_all(T.tokenize_mteval(F.col("text")))
    return d.select("doc_id", F.size(toks).cast("int").alias("n_tok"),
                    F.md5(F.array_join(toks, " ")).alias("tok_md5"))


@query("tokenize_caption", lambda: _tok_sql(f"string_split({Q.caption_text('text')}, ' ')"))
def tokenize_caption(spark, sf):
    d = table(spark, sf, "documents")
    toks = F.split(T.tokenize_caption(F.col("text")), " ")
    return d.select("doc_id", F.size(toks).cast("int").alias("n_tok"),
                    F.md5(F.array_join(toks, " ")).alias("tok_md5"))


@query("tokenize_words", lambda: _tok_sql("regexp_extract_all(lower(text), '\\p{L}+')"))
def tokenize_words(spark, sf):
    d = table(spark, sf, "documents")
    toks = T.tokenize_words(F.col("text"))
    return d.select("doc_id", F.size(toks).cast("int").alias("n_tok"),
                    F.md5(F.array_join(toks, " ")).alias("tok_md5"))


# ---------------------------------------------------------------- E5-E9

def _stats(spark, sf, max_n, how="mteval"):
    return S.Stats(None, None, max_n, how, texts=V.seg_texts(spark, sf))


def _digests(lists, total: str, *keys):
    """Rows of ``gram_lists`` with the digest of the whole list."""
    return lists.select(*keys, "n_grams", F.col("total").alias(total), F.md5(F.col("lines").cast("binary")).alias("grams"))


def _listed_sql(value: str) -> str:
    return f"md5(string_agg(gram || chr(9) || CAST({value} AS BIGINT), chr(10) ORDER BY gram))"


def _tokens(spark, sf, how="mteval"):
    return G.tokenize_texts(V.seg_texts(spark, sf), how)


@query("ngram_counts", lambda: with_views("seg") + ",\n" + Q.tok_ctes() + "," + Q.gram_ctes(4) + f"""
SELECT inst_id, CAST(ref_no AS INTEGER) AS ref_no, CAST(n AS INTEGER) AS n, count(*) AS n_grams, CAST(sum(cnt) AS BIGINT) AS total, {_listed_sql("cnt")} AS grams
FROM (SELECT inst_id, ref_no, n, gram, cnt FROM rc UNION ALL SELECT inst_id, -1, n, gram, cnt FROM sc) GROUP BY inst_id, ref_no, n""")
def ngram_counts(spark, sf):
    """E5: every text's grams of each order with their counts (``grams`` is the digest of the whole list)."""
    return _digests(G.gram_lists(_tokens(spark, sf), ["inst_id", "ref_no"], 4), "total", "inst_id", "ref_no", "n")


@query("ref_max_counts", lambda: with_views("seg") + ",\n" + Q.tok_ctes() + "," + Q.gram_ctes(4) + f"""
SELECT inst_id, CAST(n AS INTEGER) AS n, count(*) AS n_grams, CAST(sum(rmax) AS BIGINT) AS sum_rmax, {_listed_sql("rmax")} AS grams
FROM rmax GROUP BY inst_id, n""")
def ref_max_counts(spark, sf):
    """Each instance's reference grams with their largest count."""
    return _digests(G.ref_max_lists(_tokens(spark, sf).where("ref_no >= 0"), 4), "sum_rmax", "inst_id", "n")


@query("clipped_hits", lambda: with_views("seg") + ",\n" + Q.tok_ctes() + "," + Q.gram_ctes(4) + """
SELECT inst_id, CAST(n AS INTEGER) AS n, CAST(hits AS BIGINT) AS hits FROM hits""")
def clipped_hits(spark, sf):
    st = _stats(spark, sf, 4)
    return st.segment_stats().select("inst_id", F.col("n").cast("int"), F.col("hits").cast("long"))


@query("ngram_doc_freq", lambda: with_views("seg") + ",\n" + Q.tok_ctes("caption") + "," + Q.gram_ctes(4) + f""",
dfreq AS (SELECT n, gram, count(DISTINCT inst_id) AS df FROM rc GROUP BY n, gram)
SELECT CAST(n AS INTEGER) AS n, substr(md5(gram), 1, 3) AS part, count(*) AS n_grams, CAST(sum(df) AS BIGINT) AS sum_df, {_listed_sql("df")} AS grams
FROM dfreq GROUP BY 1, 2""")
def ngram_doc_freq(spark, sf):
    """Every gram with the number of instances whose references hold it."""
    return _digests(G.doc_freq_lists(_tokens(spark, sf, "caption").where("ref_no >= 0"), 4, empty_token=False), "sum_df", "n", "part")


@query("ngram_info", lambda: with_views("seg") + ",\n" + Q.tok_ctes() + "," + Q.gram_ctes(5) + f""",
tot AS MATERIALIZED (SELECT n, gram, sum(cnt) AS tot FROM rc GROUP BY n, gram),
words AS (SELECT sum(tot) AS words FROM tot WHERE n = 1),
info AS (SELECT t.n, t.gram, t.tot, CASE WHEN t.n = 1 THEN (SELECT words FROM words) ELSE p.tot END AS whole
         FROM tot t LEFT JOIN tot p ON p.n = t.n - 1
              AND p.gram = CASE WHEN t.n > 1 THEN regexp_replace(t.gram, ' [^ ]*$', '') END)
SELECT CAST(n AS INTEGER) AS n, substr(md5(gram), 1, 3) AS part, count(*) AS n_grams, round(sum(log2(whole / tot)), 4) AS info_sum,
       {_listed_sql("tot")} AS totals, {_listed_sql("whole")} AS prefix_totals FROM info GROUP BY 1, 2""")
def ngram_info(spark, sf):
    """Every gram with its total and that of its prefix, and the information they give."""
    info = G.info_lists(_tokens(spark, sf).where("ref_no >= 0"), 5)
    return info.select("n", "part", "n_grams", _r4(F.col("info")).alias("info_sum"), *(
        F.md5(F.col(c).cast("binary")).alias(name) for c, name in (("totals", "totals"), ("wholes", "prefix_totals"))))


# ---------------------------------------------------------------- F1-F4

@query("ref_len_pick", lambda: with_views("seg") + ",\n" + Q.tok_ctes() + "," + Q.gram_ctes(1) + """
SELECT inst_id, CAST(rlen_closest AS DOUBLE) AS closest, CAST(rlen_short AS DOUBLE) AS shortest,
       round(rlen_avg, 4) AS average FROM lens""")
def ref_len_pick(spark, sf):
    d = _stats(spark, sf, 1).instances()
    return d.select("inst_id", *(_r4(S.ref_len(how)).alias(how) for how in ("closest", "shortest", "average")))


def _bleu_sql(level: str) -> str:
    base = with_views("seg") + ",\n" + Q.tok_ctes() + "," + Q.gram_ctes(4)
    keys = "inst_id" if level == "segment" else ""
    sel = "inst_id, " if keys else ""
    grp = "GROUP BY inst_id" if keys else ""
    cols = ", ".join(f"sum(CASE WHEN h.n = {n} THEN h.hits END) AS h{n}, "
                     f"sum(CASE WHEN h.n = {n} THEN l.slen - {n - 1} END) AS c{n}" for n in range(1, 5))

    def bleu(s):
        logs = " + ".join(f"ln(greatest(h{n} + {s}, 1e-15) / greatest(c{n} + {s}, 1e-9))" for n in range(1, 5))
        bp = "CASE WHEN c1 <= rl THEN exp(1.0 - rl / (CASE WHEN c1 = 0 THEN 1e-5 ELSE c1 END)) ELSE 1.0 END"
        return f"round({bp} * exp(({logs}) / 4.0), 4)"
    wide = (f"w AS (SELECT {sel}{cols}, sum(CASE WHEN h.n = 1 THEN l.rlen_closest END) AS rl, "
            f"sum(CASE WHEN h.n = 1 THEN l.slen END) AS sl FROM hits h JOIN lens l USING (inst_id) {grp})")
    if level == "segment":
        return base + ",\n" + wide + f"\nSELECT inst_id, {bleu(0)} AS bleu, {bleu(1)} AS sent_bleu FROM w"
    return base + ",\n" + wide + f"\nSELECT {bleu(0)} AS bleu, CAST(sl AS BIGINT) AS sys_len, CAST(rl AS DOUBLE) AS ref_len FROM w"


@query("bleu_corpus", lambda: _bleu_sql("corpus"))
def bleu_corpus(spark, sf):
    return S.bleu_corpus(None, None, stats=_stats(spark, sf, 4)).select(_r4(F.col("bleu")).alias("bleu"), "sys_len", "ref_len")


@query("bleu_segment", lambda: _bleu_sql("segment"))
def bleu_segment(spark, sf):
    return S.bleu_segment(None, None, stats=_stats(spark, sf, 4)).select("inst_id", _r4(F.col("bleu")).alias("bleu"),
                                            _r4(F.col("sent_bleu")).alias("sent_bleu"))


# ---------------------------------------------------------------- F8, F9

def _nist_sql(level: str) -> str:
    base = with_views("seg") + ",\n" + Q.tok_ctes() + "," + Q.gram_ctes(5)
    if level == "corpus":
        info = """,
tot AS (SELECT n, gram, sum(cnt) AS tot FROM rc GROUP BY n, gram),
words AS (SELECT sum(tot) AS words FROM tot WHERE n = 1),
info AS (SELECT t.n, t.gram, log2(CASE WHEN t.n = 1 THEN (SELECT words FROM words) ELSE p.tot END / t.tot) AS info
         FROM tot t LEFT JOIN tot p ON p.n = t.n - 1
              AND p.gram = CASE WHEN t.n > 1 THEN regexp_replace(t.gram, ' [^ ]*$', '') END),
hi AS (SELECT h.n, sum(h.hits * i.info) AS hit_info FROM hitg h JOIN info i USING (n, gram)
       WHERE h.hits > 0 GROUP BY h.n),
ln_ AS (SELECT h.n, sum(l.slen - h.n + 1) AS cand FROM hits h JOIN lens l USING (inst_id) GROUP BY h.n),
tt AS (SELECT sum(slen) AS sl, sum(rsum / nrefs) AS ar FROM lens),
w AS (SELECT """ + ", ".join(
            f"sum(CASE WHEN ln_.n = {n} THEN coalesce(hi.hit_info, 0) / ln_.cand END) AS t{n}, "
            f"min(CASE WHEN ln_.n = {n} THEN ln_.cand END) AS c{n}" for n in range(1, 6)) + """
      FROM ln_ LEFT JOIN hi USING (n))"""
        sel = "SELECT "
        frm = " FROM w, tt"
    else:
        info = """,
tot AS (SELECT inst_id, n, gram, sum(cnt) AS tot FROM rc GROUP BY inst_id, n, gram),
words AS (SELECT inst_id, sum(tot) AS words FROM tot WHERE n = 1 GROUP BY inst_id),
info AS (SELECT t.inst_id, t.n, t.gram,
                log2(CASE WHEN t.n = 1 THEN wd.words ELSE p.tot END / t.tot) AS info
         FROM tot t JOIN words wd USING (inst_id) LEFT JOIN tot p ON p.inst_id = t.inst_id AND p.n = t.n - 1
              AND p.gram = CASE WHEN t.n > 1 THEN regexp_replace(t.gram, ' [^ ]*$', '') END),
hi AS (SELECT h.inst_id, h.n, sum(h.hits * i.info) AS hit_info FROM hitg h JOIN info i USING (inst_id, n, gram)
       WHERE h.hits > 0 GROUP BY h.inst_id, h.n),
tt AS (SELECT inst_id, slen AS sl, rsum / nrefs AS ar FROM lens),
w AS (SELECT h.inst_id, """ + ", ".join(
            f"sum(CASE WHEN h.n = {n} THEN coalesce(hi.hit_info, 0) / (l.slen - {n - 1}) END) AS t{n}, "
            f"min(CASE WHEN h.n = {n} THEN l.slen - {n - 1} END) AS c{n}" for n in range(1, 6)) + """
      FROM hits h JOIN lens l USING (inst_id) LEFT JOIN hi USING (inst_id, n) GROUP BY h.inst_id)"""
        sel = "SELECT inst_id, "
        frm = " FROM w JOIN tt USING (inst_id)"
    ok = " AND ".join(f"c{n} > 0" for n in range(1, 6))
    terms = " + ".join(f"t{n}" for n in range(1, 6))
    pen = (f"(CASE WHEN sl / ar >= 1 THEN 1.0 WHEN sl / ar <= 0 THEN 0.0 "
           f"ELSE exp(-{S.NIST_BETA!r} * pow(ln(sl / ar), 2)) END)")
    return base + info + f"\n{sel}CASE WHEN {ok} THEN round({pen} * ({terms}), 4) END AS nist{frm}"


@query("nist_corpus", lambda: _nist_sql("corpus"))
def nist_corpus(spark, sf):
    return S.nist_corpus(None, None, stats=_stats(spark, sf, 5)).select(_r4(F.col("nist")).alias("nist"))


@query("nist_segment", lambda: _nist_sql("segment"))
def nist_segment(spark, sf):
    return S.nist_segment(None, None, stats=_stats(spark, sf, 5)).select("inst_id", _r4(F.col("nist")).alias("nist"))


# ---------------------------------------------------------------- F2, F5, F6, F10, F16, F17 (Perl scorer)

def _perl_sql(max_n: int = 9, info: bool = True, systems: int = 1) -> str:
    """CTEs: pst (inst_id, sys_no, n, match, tst_count, ref_count, tst_info, ref_info, ref_length, nrefs) and pw
    (corpus sums a system).  A gram is the hash of its tokens' hashes; every step that is read twice is
    written out, and hits are summed by instance before the next join."""
    ids = lambda c: f"list_transform({Q.mteval_tokens(c, 'perl')}, lambda w: hash(w))"
    outputs = " UNION ALL ".join(["SELECT inst_id, 1 AS sys_no, sys FROM seg_sys"]
                                 + [f"SELECT inst_id, {k} AS sys_no, sys FROM seg_sys{k}" for k in range(2, systems + 1)])
    told = f"""
tot AS MATERIALIZED (SELECT g, any_value(n) AS n, any_value(p) AS p, sum(cnt) AS tot FROM rc GROUP BY g),
info AS MATERIALIZED (SELECT t.g, log2(CASE WHEN t.n = 1 THEN (SELECT sum(tot) FROM tot WHERE n = 1) ELSE pre.tot END / t.tot) AS info
         FROM tot t LEFT JOIN tot pre ON pre.g = t.p AND t.n > 1),
ti AS (SELECT inst_id, sys_no, n, sum(hits) AS match, sum(hits * info) AS tst_info FROM hitg JOIN info USING (g) GROUP BY ALL),
ri AS (SELECT inst_id, n, sum(info) AS ref_info FROM rc JOIN info USING (g) GROUP BY ALL),""" if info else """
ti AS (SELECT inst_id, sys_no, n, sum(hits) AS match, 0.0 AS tst_info FROM hitg GROUP BY ALL),
ri AS (SELECT inst_id, n, 0.0 AS ref_info FROM rcnt),"""
    cols = ", ".join(f"sum(CASE WHEN n = {n} THEN {c} END) AS {c}_{n}" for n in range(1, max_n + 1)
                     for c in ("match", "tst_count", "ref_count", "tst_info", "ref_info"))
    # a token's row sees the following ones; a gram's id is mixed from its prefix's and its last token
    leads = ", ".join(f"lead(h, {k}) OVER w AS h{k}" for k in range(1, max_n))
    mixes = ", ".join(f"hash(g{k}, h{k}) AS g{k + 1}" for k in range(1, max_n))
    each = ", ".join(["{'n': 1, 'g': g1, 'p': 0::UBIGINT}"]
                     + [f"CASE WHEN h{k} IS NOT NULL THEN {{'n': {k + 1}, 'g': g{k + 1}, 'p': g{k}}} END" for k in range(1, max_n)])
    grams = lambda src, keys: f"""SELECT {keys}, x.n AS n, x.g AS g, any_value(x.p) AS p, count(*) AS cnt FROM (
  SELECT {keys}, unnest([{each}]) AS x FROM (SELECT *, h AS g1, {mixes} FROM (SELECT {keys}, h, {leads} FROM (
    SELECT {keys}, unnest(h) AS h, unnest(generate_series(1, len(h))) AS pos FROM {src}) WINDOW w AS (PARTITION BY {keys} ORDER BY pos))))
  WHERE x IS NOT NULL GROUP BY ALL"""  # noqa: E731
    return with_views("seg") + f""",
rt AS MATERIALIZED (SELECT inst_id, ref_no, {ids("ref")} AS h FROM seg_refs),
st AS MATERIALIZED (SELECT inst_id, sys_no, {ids("sys")} AS h FROM ({outputs})),
rc AS MATERIALIZED ({grams("rt", "inst_id, ref_no")}),
rmax AS (SELECT inst_id, g, max(cnt) AS rmax FROM rc GROUP BY inst_id, g),
hitg AS MATERIALIZED (SELECT inst_id, sys_no, n, g, least(cnt, rmax) AS hits FROM ({grams("st", "inst_id, sys_no")}) JOIN rmax USING (inst_id, g)),
rcnt AS (SELECT r.inst_id, o.n, sum(greatest(len(r.h) - o.n + 1, 0)) AS ref_count FROM rt r, range(1, {max_n + 1}) o(n) GROUP BY ALL),{told}
lens AS (SELECT s.inst_id, s.sys_no, len(s.h) AS slen, coalesce(arg_min(len(r.h), CASE WHEN len(r.h) > 0 THEN abs(len(r.h) - len(s.h)) * 100000000 + len(r.h) END), 0) AS ref_length,
                sum(CASE WHEN len(r.h) > 0 THEN 1 ELSE 0 END) AS nrefs FROM st s JOIN rt r USING (inst_id) GROUP BY s.inst_id, s.sys_no, len(s.h)),
pst AS MATERIALIZED (SELECT l.inst_id, l.sys_no, rcnt.n, coalesce(ti.match, 0) AS match, greatest(l.slen - rcnt.n + 1, 0) AS tst_count, ref_count,
               coalesce(ti.tst_info, 0) AS tst_info, coalesce(ri.ref_info, 0) AS ref_info, l.ref_length, l.nrefs
        FROM lens l JOIN rcnt USING (inst_id) LEFT JOIN ti ON ti.inst_id = l.inst_id AND ti.sys_no = l.sys_no AND ti.n = rcnt.n
        LEFT JOIN (SELECT inst_id, n, any_value(ref_info) AS ref_info FROM ri GROUP BY ALL) ri ON ri.inst_id = l.inst_id AND ri.n = rcnt.n),
pw AS MATERIALIZED (SELECT sys_no, {cols}, sum(CASE WHEN n = 1 THEN ref_length END) AS ref_length,
              sum(CASE WHEN n = 1 THEN nrefs END) AS nrefs_sum, sum(CASE WHEN n = 1 THEN 1 END) AS nsegs FROM pst GROUP BY sys_no)"""


def _perl_parts(n: int) -> dict:
    """SQL of the smoothed BLEU and NIST of order n from the sums of a row of pw."""
    # smoothed BLEU: running log sum with the k-th zero-match order counting 1/2^k
    terms = []
    for j in range(1, n + 1):
        zeros = " + ".join(f"(CASE WHEN tst_count_{i} > 0 AND match_{i} = 0 THEN 1 ELSE 0 END)" for i in range(1, j + 1))
        terms.append(f"(CASE WHEN tst_count_{j} = 0 THEN 0 WHEN match_{j} = 0 THEN ln(1.0 / (pow(2, {zeros}) * tst_count_{j})) "
                     f"ELSE ln(match_{j} * 1.0 / tst_count_{j}) END)")
    lens = "(CASE WHEN tst_count_1 > 0 THEN exp(least(0, 1 - ref_length / tst_count_1)) ELSE 0 END)"
    ratio = "(CASE WHEN nrefs_sum > 0 AND ref_count_1 > 0 THEN tst_count_1 / (ref_count_1 / (nrefs_sum * 1.0 / nsegs)) END)"
    pen = (f"(CASE WHEN {ratio} >= 1 THEN 1.0 WHEN {ratio} <= 0 THEN 0.0 WHEN {ratio} > 0 THEN exp(-{S.NIST_BETA!r} * pow(ln({ratio}), 2)) END)")
    nist = [f"(tst_info_{j} / greatest(tst_count_{j}, 1))" for j in range(1, n + 1)]
    return {"bleu_ind": f"round(exp({terms[-1]}), 4)", "bleu_cum": f"round(exp(({' + '.join(terms)}) / {n}) * {lens}, 4)",
            "nist_ind": f"round({nist[-1]} * {pen}, 4)", "nist_cum": f"round(({' + '.join(nist)}) * {pen}, 4)"}


def _perl_report_sql(*names: str, max_n: int = 9) -> str:
    rows = [f"SELECT {n} AS n, " + ", ".join(f"{_perl_parts(n)[c]} AS {c}" for c in names) + " FROM pw" for n in range(1, max_n + 1)]
    return _perl_sql(max_n, any(c.startswith("nist") for c in names)) + "\n" + "\nUNION ALL\n".join(rows)


def _report_df(spark, sf, max_n=9):
    st = _stats(spark, sf, max_n, "perl")
    r = S.ngram_report(None, None, max_n, stats=st)
    return r.select(F.col("n").cast("int"), *[_r4(F.col(c)).alias(c) for c in ("bleu_ind", "bleu_cum", "nist_ind", "nist_cum")])


@query("ngram_report", lambda: _perl_report_sql("bleu_ind", "bleu_cum", "nist_ind", "nist_cum"))
def ngram_report(spark, sf):
    return _report_df(spark, sf)


@query("bleu_smoothed", lambda: _perl_report_sql("bleu_ind", "bleu_cum"))
def bleu_smoothed(spark, sf):
    w = S.perl_corpus_stats(_stats(spark, sf, 9, "perl"), info=False).select(F.posexplode(S.perl_bleu(9)).alias("_n", "x"))
    return w.select((F.col("_n") + 1).cast("int").alias("n"), _r4(F.col("x.ind")).alias("bleu_ind"), _r4(F.col("x.cum")).alias("bleu_cum"))


@query("nist_by_n", lambda: _perl_report_sql("nist_ind", "nist_cum"))
def nist_by_n(spark, sf):
    return _report_df(spark, sf).select("n", "nist_ind", "nist_cum")


def _unsmoothed_sql(max_n: int = 9) -> str:
    rows = []
    for n in range(1, max_n + 1):
        logs = " + ".join(f"(CASE WHEN match_{j} = 0 THEN 0 ELSE ln(match_{j} * 1.0 / tst_count_{j}) END)" for j in range(1, n + 1))
        rows.append(f"SELECT {n} AS n, CASE WHEN match_{n} = 0 THEN NULL ELSE round(match_{n} * 1.0 / tst_count_{n}, 4) END AS bleu_ind, "
                    f"CASE WHEN match_{n} = 0 THEN 0.0 ELSE round(exp(({logs}) / {n} + least(0, 1 - ref_length / tst_count_1)), 4) END AS bleu_cum FROM pw")
    return _perl_sql(max_n, info=False) + "\n" + "\nUNION ALL\n".join(rows)


@query("bleu_unsmoothed", lambda: _unsmoothed_sql(9))
def bleu_unsmoothed(spark, sf):
    st = _stats(spark, sf, 9, "perl")
    w = S.perl_corpus_stats(st, info=False).select(F.posexplode(S.perl_bleu(9, smoothed=False)).alias("_n", "x"))
    return w.select((F.col("_n") + 1).cast("int").alias("n"), _r4(F.col("x.ind")).alias("bleu_ind"), _r4(F.col("x.cum")).alias("bleu_cum"))


@query("segment_stats", lambda: _perl_sql(9) + """
SELECT inst_id, CAST(n AS INTEGER) AS n, CAST(match AS BIGINT) AS match, CAST(tst_count AS BIGINT) AS tst_count,
       CAST(ref_count AS BIGINT) AS ref_count, round(tst_info, 4) AS tst_info, round(ref_info, 4) AS ref_info,
       CAST(ref_length AS DOUBLE) AS ref_length, CAST(nrefs AS BIGINT) AS nrefs FROM pst""")
def segment_stats(spark, sf):
    st = _stats(spark, sf, 9, "perl")
    s = S.perl_segment_stats(st)
    return s.select("inst_id", F.col("n").cast("int"), F.col("match").cast("long"), F.col("tst_count").cast("long"),
                    F.col("ref_count").cast("long"), _r4(F.col("tst_info")).alias("tst_info"),
                    _r4(F.col("ref_info")).alias("ref_info"), F.col("ref_length").cast("double"), F.col("nrefs").cast("long"))


def _levels_sql(max_n: int = 5) -> str:
    cols = ", ".join(f"sum(CASE WHEN n = {n} THEN {c} END) AS {c}_{n}" for n in range(1, max_n + 1)
                     for c in ("match", "tst_count", "ref_count", "tst_info"))
    return _perl_sql(max_n, systems=2) + f""",
lv AS (SELECT CAST(sys_no AS INTEGER) AS sys_no, CAST(inst_id % 20 AS INTEGER) AS doc, inst_id, GROUPING(inst_id % 20) AS gd, GROUPING(inst_id) AS gi, {cols},
  sum(CASE WHEN n = 1 THEN ref_length END) AS ref_length, sum(CASE WHEN n = 1 THEN nrefs END) AS nrefs_sum,
  sum(CASE WHEN n = 1 THEN 1 END) AS nsegs FROM pst GROUP BY GROUPING SETS ((sys_no, inst_id % 20, inst_id), (sys_no, inst_id % 20), (sys_no)))
SELECT CASE WHEN gi = 0 THEN 'segment' WHEN gd = 0 THEN 'document' ELSE 'system' END AS level, sys_no, doc, inst_id,
  {_perl_parts(4)["bleu_cum"]} AS bleu, {_perl_parts(5)["nist_cum"]} AS nist FROM lv"""


@query("score_levels", _levels_sql)
def score_levels(spark, sf):
    """F16: segment, document (doc = inst_id % 20) and system level of two systems in one aggregation."""
    st = S.Stats(None, None, 5, "perl", texts=V.seg_texts(spark, sf, systems=2), systems=2)
    lv = S.score_levels(None, None, (F.col("inst_id") % 20).cast("int"), 5, stats=st)
    return lv.select("level", "sys_no", "doc", "inst_id", _r4(F.col("bleu_cum_4")).alias("bleu"), _r4(F.col("nist_cum_5")).alias("nist"))


# ---------------------------------------------------------------- F7, F11-F15 (caption scorers)

def _bleu_caption_sql() -> str:
    base = with_views("seg") + ",\n" + Q.tok_ctes("caption") + "," + Q.gram_ctes(4)
    cols = ", ".join(f"sum(CASE WHEN h.n = {n} THEN h.hits END) AS c{n}, "
                     f"sum(CASE WHEN h.n = {n} THEN greatest(l.slen - {n - 1}, 0) END) AS g{n}" for n in range(1, 5))
    w = (f"w AS (SELECT {cols}, sum(CASE WHEN h.n = 1 THEN l.slen END) AS tl, "
         f"sum(CASE WHEN h.n = 1 THEN l.rlen_closest END) AS rl FROM hits h JOIN lens l USING (inst_id))")
    ratio = "((tl + 1e-15) / (rl + 1e-9))"
    bp = f"(CASE WHEN {ratio} < 1 THEN exp(1 - 1 / {ratio}) ELSE 1.0 END)"
    outs = []
    for n in range(1, 5):
        prod = " * ".join(f"((c{i} + 1e-15) / (g{i} + 1e-9))" for i in range(1, n + 1))
        outs.append(f"round(pow({prod}, 1.0 / {n}) * {bp}, 4) AS bleu_{n}")
    return base + ",\n" + w + "\nSELECT " + ", ".join(outs) + " FROM w"


@query("bleu_caption", _bleu_caption_sql)
def bleu_caption(spark, sf):
    st = _stats(spark, sf, 4, "caption")
    b = S.caption_bleu(None, None, stats=st)
    return b.select(*[_r4(F.col(f"bleu_{n}")).alias(f"bleu_{n}") for n in range(1, 5)])


@query("rouge_l")
def rouge_l(spark, sf):
    """F11 per instance (whole texts; LCS in SQL would be quadratic per pair, so this is
    checked against a plain dynamic programme in the tests)."""
    return S.rouge_l(None, None, texts=V.seg_texts(spark, sf)).select("inst_id", _r4(F.col("rouge_l")).alias("rouge_l"))


def _cider_sql() -> str:
    base = with_views("seg") + ",\n" + Q.tok_ctes("caption") + "," + Q.gram_ctes(4)
    return base + """,
dfq AS (SELECT n, gram, count(DISTINCT inst_id) AS df FROM rc GROUP BY n, gram),
ninst AS (SELECT count(*) AS ni FROM st),
allg AS (SELECT inst_id, ref_no, n, gram, cnt FROM rc UNION ALL SELECT inst_id, -1, n, gram, cnt FROM sc),
vec AS (SELECT a.inst_id, a.ref_no, a.n, a.gram, a.cnt * (ln((SELECT ni FROM ninst)) - ln(greatest(coalesce(d.df, 0), 1))) AS v
        FROM allg a LEFT JOIN dfq d USING (n, gram)),
norms AS (SELECT inst_id, ref_no, n, sqrt(sum(v * v)) AS nm FROM vec GROUP BY ALL),
dots AS (SELECT r.inst_id, r.ref_no, r.n, sum(least(h.v, r.v) * r.v) AS dot FROM vec h JOIN vec r
         ON h.inst_id = r.inst_id AND h.n = r.n AND h.gram = r.gram AND h.ref_no = -1 AND r.ref_no >= 0 GROUP BY ALL),
blen AS (SELECT inst_id, ref_no, greatest(len(toks) - 1, 0) AS bl FROM rt UNION ALL SELECT inst_id, -1, greatest(len(toks) - 1, 0) FROM st),
cells AS (SELECT b.inst_id, b.ref_no, o.n, exp(-pow(hb.bl - b.bl, 2) / (2 * 36.0)) AS pen,
                 coalesce(nr.nm, 0) AS nr, coalesce(nh.nm, 0) AS nh, coalesce(d.dot, 0) AS dot
          FROM blen b JOIN blen hb ON hb.inst_id = b.inst_id AND hb.ref_no = -1 AND b.ref_no >= 0
          CROSS JOIN range(1, 5) o(n)
          LEFT JOIN norms nr ON nr.inst_id = b.inst_id AND nr.ref_no = b.ref_no AND nr.n = o.n
          LEFT JOIN norms nh ON nh.inst_id = b.inst_id AND nh.ref_no = -1 AND nh.n = o.n
          LEFT JOIN dots d ON d.inst_id = b.inst_id AND d.ref_no = b.ref_no AND d.n = o.n)
SELECT inst_id, round(sum(CASE WHEN nh <> 0 AND nr <> 0 THEN dot / (nh * nr) ELSE dot END * pen) / 4.0
                      / count(DISTINCT ref_no) * 10.0, 4) AS cider
FROM cells GROUP BY inst_id"""


@query("cider", _cider_sql)
def cider(spark, sf):
    st = _stats(spark, sf, 4, "caption")
    return S.cider(None, None, stats=st).select("inst_id", _r4(F.col("cider")).alias("cider"))


def _meteor_sql() -> str:
    tok = lambda x: Q.caption_tokens(x)
    return with_views("seg") + f""",
rp AS (SELECT inst_id, ref_no, t.tok, t.pos FROM (SELECT inst_id, ref_no, {tok('ref')} AS toks FROM seg_refs),
       LATERAL (SELECT unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS pos) t),
hp AS (SELECT inst_id, t.tok, t.pos FROM (SELECT inst_id, {tok('sys')} AS toks FROM seg_sys),
       LATERAL (SELECT unnest(toks) AS tok, unnest(generate_series(0, len(toks) - 1)) AS pos) t),
ro AS (SELECT *, row_number() OVER (PARTITION BY inst_id, ref_no, tok ORDER BY pos) AS occ FROM rp),
ho AS (SELECT *, row_number() OVER (PARTITION BY inst_id, tok ORDER BY pos) AS occ FROM hp),
al AS (SELECT h.inst_id, r.ref_no, h.pos AS hpos, r.pos AS rpos FROM ho h JOIN ro r USING (inst_id, tok, occ)),
br AS (SELECT inst_id, ref_no, CASE WHEN lag(hpos) OVER w IS NULL OR hpos <> lag(hpos) OVER w + 1
                                         OR rpos <> lag(rpos) OVER w + 1 THEN 1 ELSE 0 END AS b
       FROM al WINDOW w AS (PARTITION BY inst_id, ref_no ORDER BY hpos)),
m AS (SELECT inst_id, ref_no, count(*) AS matches, sum(b) AS chunks FROM br GROUP BY ALL),
ln_ AS (SELECT r.inst_id, r.ref_no, len({tok('r.ref')}) AS rlen, len({tok('s.sys')}) AS hlen
        FROM seg_refs r JOIN seg_sys s USING (inst_id)),
sc AS (SELECT l.inst_id, l.ref_no, coalesce(m.matches, 0) AS mt, l.hlen, l.rlen, coalesce(m.chunks, 0) AS ch
       FROM ln_ l LEFT JOIN m USING (inst_id, ref_no)),
sc2 AS (SELECT *, CASE WHEN mt > 0 THEN (mt * 1.0 / hlen) * (mt * 1.0 / rlen) / (0.9 * (mt * 1.0 / hlen) + 0.1 * (mt * 1.0 / rlen))
                        * (1 - 0.5 * pow(ch * 1.0 / mt, 3)) ELSE 0.0 END AS score FROM sc)
SELECT inst_id, round(max(score), 4) AS meteor FROM sc2 GROUP BY inst_id"""


@query("meteor_exact", _meteor_sql)
def meteor_exact(spark, sf):
    return S.meteor_exact(None, None, texts=V.seg_texts(spark, sf)).select("inst_id", _r4(F.col("meteor")).alias("meteor"))


def _tables(spark, sf):
    texts = V.seg_texts(spark, sf)
    mt = _stats(spark, sf, 5)
    seg = {
        "bleu": S.bleu_segment(None, None, stats=mt).select("inst_id", "bleu", "sent_bleu"),
        "nist": S.nist_segment(None, None, stats=mt),
        "meteor": S.meteor_exact(None, None, texts=texts),
        "rouge_l": S.rouge_l(None, None, texts=texts),
        "cider": S.cider(None, None, stats=_stats(spark, sf, 4, "caption")),
    }
    return texts, mt, seg


@query("segment_score_table")
def segment_score_table(spark, sf):
    """one row per instance: BLEU, sentBLEU, NIST, METEOR, ROUGE_L, CIDEr (4 decimals)."""
    _, _, seg = _tables(spark, sf)
    out = seg["bleu"]
    for k in ("nist", "meteor", "rouge_l", "cider"):
        out = out.join(seg[k], "inst_id", "left")
    cols = ["bleu", "sent_bleu", "nist", "meteor", "rouge_l", "cider"]
    return out.select("inst_id", *[_r4(F.col(c)).alias(c) for c in cols])


@query("score_table")
def score_table(spark, sf):
    """the five corpus scores in the fixed order BLEU, NIST, METEOR, ROUGE_L, CIDEr."""
    texts, mt, seg = _tables(spark, sf)
    rows = [S.bleu_corpus(None, None, stats=mt).select(F.lit(1).alias("ord"), F.lit("BLEU").alias("metric"), F.col("bleu").alias("score")),
            S.nist_corpus(None, None, stats=mt).select(F.lit(2).alias("ord"), F.lit("NIST").alias("metric"), F.col("nist").alias("score")),
            S.meteor_exact(None, None, level="corpus", texts=texts).select(F.lit(3).alias("ord"), F.lit("METEOR").alias("metric"), F.col("meteor").alias("score")),
            seg["rouge_l"].agg(F.avg("rouge_l").alias("score")).select(F.lit(4).alias("ord"), F.lit("ROUGE_L").alias("metric"), "score"),
            seg["cider"].agg(F.avg("cider").alias("score")).select(F.lit(5).alias("ord"), F.lit("CIDEr").alias("metric"), "score")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select(F.col("ord").cast("int"), "metric", _r4(F.col("score")).alias("score"))


def _intl_sql() -> str:
    s = "replace(text, '<skipped>', '')"
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "''")):
        s = f"replace({s}, '{old}', '{new}')"
    s = f"lower({s})"
    s = f"regexp_replace({s}, '(\\PN)(\\pP)', '\\1 \\2 ', 'g')"
    s = f"regexp_replace({s}, '(\\pP)(\\PN)', ' \\1 \\2', 'g')"
    s = f"regexp_replace({s}, '(\\pS)', ' \\1 ', 'g')"
    s = f"regexp_replace({s}, '\\pZ+', ' ', 'g')"
    s = f"regexp_replace({s}, '^\\pZ+|\\pZ+$', '', 'g')"
    return _tok_sql(f"string_split({s}, ' ')")


@query("tokenize_international", _intl_sql)
def tokenize_international(spark, sf):
    """The Unicode tokeniser (punctuation unless between digits, symbols, separators)."""
    d = table(spark, sf, "documents")
    toks = T.tokenize_international(F.col("text"))
    return d.select("doc_id", F.size(toks).cast("int").alias("n_tok"), F.md5(F.array_join(toks, " ")).alias("tok_md5"))

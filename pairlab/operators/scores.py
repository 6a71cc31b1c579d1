"""Corpus and segment scores from sufficient statistics.

Every scorer reduces to per-instance statistic rows (hits, candidate n-grams,
reference lengths, information sums) that are plain sums over the corpus, so Spark
does partial + final aggregation and the score itself is a scalar expression on the
summed row.  No per-corpus loop, no driver-side collection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators import ngrams as G
from pairlab.operators import vectors as V
from pairlab.session import scratch_path

# Fixed values of the scorers
BLEU_TINY = 1e-15      # floor of the hit count (Python scorer)
BLEU_SMALL = 1e-9      # floor of the candidate count (Python scorer)
EMPTY_CAND = 1e-5      # candidate length used when it is zero
NIST_BETA = -math.log(0.5) / math.log(1.5) ** 2
CIDER_SIGMA = 6.0
ROUGE_BETA = 1.2


class Stats:
    """Texts dealt by instance, shared by the scorers; see ``operators/vectors.py``."""

    def __init__(self, refs: DataFrame | None, sys: DataFrame | None, max_n: int, how: str = "mteval",
                 texts: DataFrame | None = None, systems: int = 1):
        """Either (refs, sys) or a combined ``texts`` table (inst_id, ref_no, text) with ref_no = -1 for
        the system output (-2, -3, ... for those of further ``systems``)."""
        from pairlab.session import ensure_importable, shared_dir

        self.max_n, self.how, self.systems = max_n, how, systems
        self.texts = G.texts_of(refs, sys) if texts is None else texts
        self.spark = self.texts.sparkSession
        shared_dir(self.spark)
        ensure_importable(self.spark)
        self.rows = V.by_instance(self.texts, how, max_n)

    def instances(self, info: bool = False) -> DataFrame:
        return V.instance_stats(self.rows, self.max_n, info)

    def segment_stats(self, ref_len_how: str = "closest") -> DataFrame:
        """(inst_id, sys_no, n, hits, cand, sys_len, ref_len, n_refs, ref_len_sum) per instance and n."""
        d = self.instances()
        return (d.select("inst_id", "sys_no", F.posexplode("hits").alias("_n", "hits"), "sys_len", ref_len(ref_len_how).alias("ref_len"),
                         "n_refs", "ref_len_sum").withColumn("n", F.col("_n") + 1).drop("_n")
                .withColumn("cand", (F.col("sys_len") - F.col("n") + 1).cast("long")))

    def table(self, name: str, columns: DataFrame) -> DataFrame:
        """A table written to the shared folder, so that its readers don't make it again."""
        path = scratch_path(self.spark, name)
        columns.write.parquet(path)
        return self.spark.read.parquet(path)


def ref_len(how: str) -> Column:
    """one reference length of a statistics row: closest (nearest to the system length, the shorter one
    on a tie), shortest, or average."""
    return {"closest": F.col("closest").cast("double"), "shortest": F.col("shortest").cast("double"),
            "average": F.col("ref_len_sum") / F.col("n_refs")}[how]


# ---------------------------------------------------------------------------
# BLEU (Python scorer): F3, F4
# ---------------------------------------------------------------------------


def _cand(n: int) -> Column:
    return F.col("sys_len") - (n - 1)


def _wide(stats: DataFrame, keys: list, max_n: int, how: str = "closest") -> DataFrame:
    """Statistics rows summed by key, one column per order (hits_n, cand_n); with no keys one row."""
    aggs = []
    for n in range(1, max_n + 1):
        aggs += [F.sum(F.col("hits")[n - 1]).alias(f"hits_{n}"), F.sum(_cand(n)).alias(f"cand_{n}")]
    aggs += [F.sum(ref_len(how)).alias("ref_len"), F.sum("sys_len").alias("sys_len"),
             F.sum(F.col("ref_len_sum") / F.col("n_refs")).alias("avg_ref_len")]
    return stats.groupBy(*keys).agg(*aggs)


def bleu_expr(max_n: int, smoothing: float = 0.0) -> Column:
    """BLEU of a wide statistics row: floors 1e-15/1e-9, brevity penalty when cand <= ref."""
    logs = [F.log(F.greatest(F.col(f"hits_{n}") + smoothing, F.lit(BLEU_TINY))
                  / F.greatest(F.col(f"cand_{n}") + smoothing, F.lit(BLEU_SMALL)))
            for n in range(1, max_n + 1)]
    prec = F.exp(sum(logs[1:], logs[0]) / max_n)
    c1 = F.col("cand_1").cast("double")
    bp = F.when(c1 <= F.col("ref_len"),
                F.exp(1.0 - F.col("ref_len") / F.when(c1 == 0, F.lit(EMPTY_CAND)).otherwise(c1))
                ).otherwise(F.lit(1.0))
    return bp * prec


def bleu_corpus(refs: DataFrame, sys: DataFrame, max_n: int = 4, keys: list[str] | None = None,
                stats: Stats | None = None) -> DataFrame:
    """corpus BLEU (sums over instances, then the geometric mean)."""
    st = stats or Stats(refs, sys, max_n)
    w = _wide(st.instances(), keys or [], max_n)
    return w.select(*(keys or []), bleu_expr(max_n).alias("bleu"),
                    F.col("sys_len").cast("long").alias("sys_len"),
                    F.col("ref_len").cast("double").alias("ref_len"))


def bleu_segment(refs: DataFrame, sys: DataFrame, max_n: int = 4,
                 stats: Stats | None = None) -> DataFrame:
    """per-instance BLEU and the +1-smoothed sentence BLEU."""
    st = stats or Stats(refs, sys, max_n)
    w = _wide(st.instances(), ["inst_id"], max_n)
    return w.select("inst_id", bleu_expr(max_n).alias("bleu"), bleu_expr(max_n, 1.0).alias("sent_bleu"))


# ---------------------------------------------------------------------------
# NIST (Python scorer): F8, F9
# ---------------------------------------------------------------------------


def nist_penalty(ratio: Column) -> Column:
    return (F.when(ratio >= 1, F.lit(1.0)).when(ratio <= 0, F.lit(0.0))
            .otherwise(F.exp(-NIST_BETA * F.pow(F.log(ratio), 2))))


def _nist(w: DataFrame, keys: list, max_n: int) -> DataFrame:
    """Score of rows with cand_n, info_n, sys_len and avg_ref_len; a candidate total that isn't positive
    gives null (the reference divides by zero there)."""
    terms = [F.coalesce(F.col(f"info_{n}"), F.lit(0.0)) / F.col(f"cand_{n}") for n in range(1, max_n + 1)]
    ok = F.lit(True)
    for n in range(1, max_n + 1):
        ok = ok & (F.col(f"cand_{n}") > 0)
    score = F.when(ok, nist_penalty(F.col("sys_len") / F.col("avg_ref_len")) * sum(terms[1:], terms[0]))
    return w.select(*keys, score.alias("nist"))


def nist_corpus(refs: DataFrame, sys: DataFrame, max_n: int = 5, stats: Stats | None = None) -> DataFrame:
    """F8: corpus NIST; information from all references of the corpus.

    Statistics rows and information rows (one an order and system) are unioned and summed at once."""
    st = stats or Stats(refs, sys, max_n)
    w = _nist(_nist_sums(st, max_n), ["sys_no"], max_n)
    return w.drop("sys_no") if st.systems == 1 else w


def _nist_sums(st: Stats, max_n: int) -> DataFrame:
    """A row a system: cand_n, info_n, sys_len, avg_ref_len over all instances."""
    orders, none = range(1, max_n + 1), F.lit(None).cast("double")
    per = st.instances().select("sys_no", *(_cand(n).cast("double").alias(f"cand_{n}") for n in orders),
                                F.col("sys_len").cast("double"), (F.col("ref_len_sum") / F.col("n_refs")).alias("avg_ref_len"),
                                *(F.lit(0.0).alias(f"info_{n}") for n in orders))
    info = V.corpus_info(st.rows, max_n, st.systems, st.texts).select(
        "sys_no", *(none.alias(f"cand_{n}") for n in orders), none.alias("sys_len"), none.alias("avg_ref_len"),
        *(F.when(F.col("n") == n, F.col("tst_info")).otherwise(0.0).alias(f"info_{n}") for n in orders))
    both = per.unionByName(info)
    sums = [F.sum(c).alias(c) for c in both.columns if c != "sys_no"]
    if st.systems > 1:
        return both.groupBy("sys_no").agg(*sums)
    return both.agg(*sums).select(F.lit(1).alias("sys_no"), "*")


def nist_segment(refs: DataFrame, sys: DataFrame, max_n: int = 5, stats: Stats | None = None) -> DataFrame:
    """per-instance NIST; information from that instance's references only (counted with its hits, in
    one task)."""
    st = stats or Stats(refs, sys, max_n)
    w = st.instances(info=True).select(
        "inst_id", *[_cand(n).cast("double").alias(f"cand_{n}") for n in range(1, max_n + 1)],
        *[F.col("info")[n - 1].alias(f"info_{n}") for n in range(1, max_n + 1)], F.col("sys_len").cast("double"),
        (F.col("ref_len_sum") / F.col("n_refs")).alias("avg_ref_len"))
    return _nist(w, ["inst_id"], max_n)


# ---------------------------------------------------------------------------
# Perl scorer: F2, F5, F6, F10, F16, F17 (n up to 9, ASCII lower-casing)
# ---------------------------------------------------------------------------


def perl_segment_stats(st: Stats) -> DataFrame:
    """per (inst_id, sys_no, n): match, tst_count, ref_count, tst_info, ref_info, ref_length (closest, the
    shorter on ties), nrefs (non-empty references).  Information is corpus-wide; ref_info is that of the
    distinct n-grams of each reference.

    Information and statistics rows are joined by instance (null keys are equal)."""
    orders = range(st.max_n)
    cell = lambda sys_no, n: F.coalesce(F.get("info", sys_no * st.max_n + n), F.lit(0.0))
    per = st.instances().groupBy("inst_id", "sys_no").agg(
        *(F.sum(F.col("hits")[n]).alias(f"match_{n}") for n in orders), *(F.sum(F.col("ref_count")[n]).alias(f"ref_count_{n}") for n in orders),
        *(F.sum(F.greatest(F.col("sys_len") - n, F.lit(0).cast("long"))).alias(f"tst_count_{n}") for n in orders),
        F.sum(F.col("closest_nz").cast("double")).alias("ref_length"), F.sum("nrefs").alias("nrefs"), F.sum("sys_len").alias("sys_len"))
    info = V.segment_info(st.rows, st.max_n, st.systems, st.texts).withColumnRenamed("inst_id", "_inst")
    both = per.join(info, F.col("inst_id").eqNullSafe(F.col("_inst")), "left")
    each = F.array(*(F.struct(
        F.lit(n + 1).alias("n"), *(F.col(f"{c}_{n}").alias(c) for c in ("match", "tst_count", "ref_count")),
        cell(F.col("sys_no").cast("int"), n).alias("tst_info"), cell(F.lit(0), n).alias("ref_info")) for n in orders))
    return both.select("inst_id", "sys_no", F.inline(each), "ref_length", "nrefs", "sys_len")


def perl_corpus_stats(st: Stats, info: bool = True) -> DataFrame:
    """One row a system with match_n, tst_count_n, ref_count_n, tst_info_n, ref_info_n, ref_length, nrefs_sum, nsegs:
    the sums over all instances; without ``info`` the information is null (BLEU needs none)."""
    orders = range(1, st.max_n + 1)
    of = lambda c, n: F.col(c)[n - 1].cast("double").alias(f"{'match' if c == 'hits' else c}_{n}")
    per = st.instances().select(
        "sys_no", *(of("hits", n) for n in orders),
        *(F.greatest(_cand(n), F.lit(0)).cast("double").alias(f"tst_count_{n}") for n in orders), *(of("ref_count", n) for n in orders),
        F.col("closest_nz").cast("double").alias("ref_length"), F.col("nrefs").cast("double").alias("nrefs_sum"),
        F.lit(1.0).alias("nsegs"), *(F.lit(None).cast("double").alias(f"{c}_{n}") for c in ("tst_info", "ref_info") for n in orders))
    both = per
    if info:
        rows = V.corpus_info(st.rows, st.max_n, st.systems, st.texts)
        both = per.unionByName(rows.select(
            "sys_no", *(F.when(F.col("n") == n, F.col(c)).otherwise(0.0).alias(f"{c}_{n}") for c in ("tst_info", "ref_info") for n in orders)),
            allowMissingColumns=True)
    return both.groupBy("sys_no").agg(*(F.sum(c).alias(c) for c in both.columns if c != "sys_no"))


def _running(orders: Column, zero: Column, step) -> Column:
    """An array with what ``step(state, order, n)`` gives for each order: (next state, value)."""
    empty = F.array().cast("array<struct<ind: double, cum: double>>")

    def merge(acc, x):
        n = F.size(acc["out"]) + 1
        state, value = step(acc["state"], x, n)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    return F.aggregate(orders, F.struct(zero.alias("state"), empty.alias("out")), merge, lambda acc: acc["out"])


def _pair(ind: Column, cum: Column) -> Column:
    return F.struct(ind.cast("double").alias("ind"), cum.cast("double").alias("cum"))


def perl_bleu(max_n: int, smoothed: bool = True) -> Column:
    """Individual and cumulative BLEU of every order, as array<struct<ind, cum>>.

    Smoothed (default): the k-th order with no match counts 1/2^k of its n-grams; an
    order with no n-grams adds 0.  Unsmoothed: an order with no match gives a
    cumulative score of 0 there and is left out of the running log sum."""
    orders = F.array(*(F.struct(F.col(f"match_{n}").cast("double").alias("m"), F.col(f"tst_count_{n}").cast("double").alias("t"))
                       for n in range(1, max_n + 1)))
    t1, short = F.col("tst_count_1").cast("double"), 1 - F.try_divide(F.col("ref_length").cast("double"), F.col("tst_count_1").cast("double"))
    if smoothed:
        len_score = F.when(t1 > 0, F.exp(F.least(F.lit(0.0), short))).otherwise(0.0)

        def step(state, x, n):
            smooth = F.when((x["t"] > 0) & (x["m"] == 0), state["smooth"] * 2).otherwise(state["smooth"])
            one = F.when(x["t"] == 0, F.lit(0.0)).when(x["m"] == 0, F.log(F.try_divide(F.lit(1.0), smooth * x["t"]))).otherwise(
                F.log(F.try_divide(x["m"], x["t"])))
            score = state["score"] + one
            return F.struct(score.alias("score"), smooth.alias("smooth")), _pair(F.exp(one), F.exp(score / n) * len_score)
    else:
        len_score = F.least(F.lit(0.0), short)

        def step(state, x, n):
            none, one = x["m"] == 0, F.log(F.try_divide(x["m"], x["t"]))
            score = F.when(none, state["score"]).otherwise(state["score"] + one)
            return (F.struct(score.alias("score"), state["smooth"].alias("smooth")),
                    _pair(F.when(~none, F.exp(one)), F.when(none, F.lit(0.0)).otherwise(F.exp(score / n + len_score))))
    return _running(orders, F.struct(F.lit(0.0).alias("score"), F.lit(1.0).alias("smooth")), step)


def perl_nist(max_n: int) -> Column:
    """individual and cumulative NIST of every order, as array<struct<ind, cum>>; denominators floored at 1;
    the length ratio uses the mean number of references per segment."""
    refs = F.try_divide(F.col("ref_count_1").cast("double"), F.try_divide(F.col("nrefs_sum").cast("double"), F.col("nsegs")))
    pen = nist_penalty(F.try_divide(F.col("tst_count_1").cast("double"), refs))  # null where the references are empty
    orders = F.array(*(F.struct((F.col(f"tst_info_{n}") / F.greatest(F.col(f"tst_count_{n}"), F.lit(1))).alias("term"))
                       for n in range(1, max_n + 1)))

    def step(state, x, n):
        score = state["score"] + x["term"]
        return F.struct(score.alias("score")), _pair(x["term"] * pen, score * pen)

    return _running(orders, F.struct(F.lit(0.0).alias("score")), step)


def perl_columns(w: DataFrame, keys: list, max_n: int, smoothed: bool = True) -> DataFrame:
    """Wide sums -> keys and bleu_ind_n, bleu_cum_n, nist_ind_n, nist_cum_n of every order."""
    done = w.select(*keys, perl_bleu(max_n, smoothed).alias("bleu"), perl_nist(max_n).alias("nist"))
    return done.select(*keys, *(F.col(m)[n - 1][c].alias(f"{m}_{c}_{n}") for m in ("bleu", "nist") for n in range(1, max_n + 1)
                                for c in ("ind", "cum")))


def perl_scores(refs, sys, max_n: int = 9, stats: Stats | None = None, smoothed: bool = True) -> DataFrame:
    """a row a system with the individual and cumulative BLEU and NIST of every order."""
    st = stats or Stats(refs, sys, max_n, "perl")
    return perl_columns(perl_corpus_stats(st), ["sys_no"], max_n, smoothed)


def ngram_report(refs, sys, max_n: int = 9, stats: Stats | None = None) -> DataFrame:
    """per system and n the individual and cumulative BLEU and NIST of the corpus (long form)."""
    st = stats or Stats(refs, sys, max_n, "perl")
    rows = perl_corpus_stats(st).select("sys_no", perl_bleu(max_n).alias("bleu"), perl_nist(max_n).alias("nist"))
    return rows.select("sys_no", F.posexplode(F.arrays_zip("bleu", "nist")).alias("_n", "x")).select(
        "sys_no", (F.col("_n") + 1).alias("n"), F.col("x.bleu.ind").alias("bleu_ind"), F.col("x.bleu.cum").alias("bleu_cum"),
        F.col("x.nist.ind").alias("nist_ind"), F.col("x.nist.cum").alias("nist_cum"))


def level_sums(seg: DataFrame, sets: list[list[str]], max_n: int) -> DataFrame:
    """Segment statistics (with any key columns) summed over grouping sets: the keys (null where summed over),
    ``level`` (which set, from 0) and the sums by order."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    aggs = [F.sum(F.when(F.col("n") == n, F.col(c))).alias(f"{c}_{n}") for n in range(1, max_n + 1)
            for c in ("match", "tst_count", "ref_count", "tst_info", "ref_info")]
    one = F.col("n") == 1
    aggs += [F.sum(F.when(one, F.col("ref_length"))).alias("ref_length"), F.sum(F.when(one, F.col("nrefs"))).alias("nrefs_sum"),
             F.sum(F.when(one, F.lit(1))).alias("nsegs")]
    # a key that a set lacks has the bit of its place (from the left) in the grouping id
    bits = [sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in sets]
    level = F.coalesce(*(F.when(F.col("_id") == b, F.lit(i)) for i, b in enumerate(bits)))
    return (seg.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggs, F.grouping_id().alias("_id"))
            .withColumn("level", level).drop("_id"))


def score_levels(refs, sys, doc: Column, max_n: int = 9, stats: Stats | None = None) -> DataFrame:
    """F16: segment, document and system level of every system, in one aggregation over grouping sets."""
    st = stats or Stats(refs, sys, max_n, "perl")
    seg = perl_segment_stats(st).withColumn("doc", doc)
    w = level_sums(seg, [["sys_no", "doc", "inst_id"], ["sys_no", "doc"], ["sys_no"]], max_n)
    level = F.element_at(F.array(F.lit("segment"), F.lit("document"), F.lit("system")), F.col("level") + 1)
    return perl_columns(w.withColumn("level", level), ["level", "sys_no", "doc", "inst_id"], max_n)


# ---------------------------------------------------------------------------
# Caption scorers: F7 (BLEU), F11 (ROUGE_L), F12 (CIDEr), F13 (METEOR, exact)
# ---------------------------------------------------------------------------


def caption_bleu(refs, sys, max_n: int = 4, option: str = "closest", keys=None, level: str = "corpus",
                 stats: Stats | None = None) -> DataFrame:
    """Bleu_1..4 of the caption scorer: tiny/small constants are *added*; the
    brevity factor applies when the length ratio is below 1."""
    st = stats or Stats(refs, sys, max_n, "caption")
    k = ["inst_id"] if level == "segment" else (keys or [])
    aggs = []
    for n in range(1, max_n + 1):
        aggs += [F.sum(F.col("hits")[n - 1]).alias(f"c_{n}"), F.sum(F.greatest(_cand(n), F.lit(0))).alias(f"g_{n}")]
    aggs += [F.sum("sys_len").alias("testlen"), F.sum(ref_len(option)).alias("reflen")]
    w = st.instances().groupBy(*k).agg(*aggs)
    ratio = (F.col("testlen") + BLEU_TINY) / (F.col("reflen") + BLEU_SMALL)
    bp = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(F.lit(1.0))
    prod, cols = F.lit(1.0), []
    for n in range(1, max_n + 1):
        prod = prod * (F.col(f"c_{n}") + BLEU_TINY) / (F.col(f"g_{n}") + BLEU_SMALL)
        cols.append((F.pow(prod, 1.0 / n) * bp).alias(f"bleu_{n}"))
    return w.select(*k, *cols)


def _lcs_with(b: list):
    """The length of the longest common subsequence with ``b``, as a function (bit-parallel, O(len(a) * len(b) / w))."""
    masks: dict = {}
    for i, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(b)) - 1

    def length(a: list) -> int:
        v = full
        for m in map(masks.get, a):
            if m:  # a token that b lacks changes nothing
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(b) - v.bit_count()

    return length


def _lcs_len(a, b) -> int:
    return _lcs_with(list(b))(list(a))


def _pair_texts(refs: DataFrame | None, sys: DataFrame | None, texts: DataFrame | None) -> DataFrame:
    from pairlab.session import ensure_importable

    texts = G.texts_of(refs, sys) if texts is None else texts
    ensure_importable(texts.sparkSession)
    return texts


def rouge_l(refs, sys, beta: float = ROUGE_BETA, level: str = "segment", texts: DataFrame | None = None) -> DataFrame:
    """ROUGE-L with the best precision and best recall taken independently over
    the references; tokens split on one blank (empty text = one empty token).

    The LCS is a per-pair dynamic programme on whole texts (up to tens of thousands of
    tokens), so it runs bit-parallel in Arrow batches; pairs are partitioned by Spark.  Instead of (refs, sys) a
    combined table may be given, as for ``Stats``."""
    j = V.common_lengths(_pair_texts(refs, sys, texts), "blank", _lcs_with)
    per = j.groupBy("inst_id").agg(F.max(F.col("lcs") / F.col("sl")).alias("p"), F.max(F.col("lcs") / F.col("rl")).alias("r"))
    score = F.when((F.col("p") != 0) & (F.col("r") != 0),
                   (1 + beta ** 2) * F.col("p") * F.col("r") / (F.col("r") + beta ** 2 * F.col("p"))).otherwise(0.0)
    seg = per.select("inst_id", score.alias("rouge_l"))
    return seg if level == "segment" else seg.agg(F.avg("rouge_l").alias("rouge_l"))


def cider(refs, sys, max_n: int = 4, sigma: float = CIDER_SIGMA, stats: Stats | None = None,
          level: str = "segment") -> DataFrame:
    """CIDEr.  tf-idf weights with idf = ln(instances) - ln(max(1, df)); per order
    the clipped dot product min(h, r) * r over the norms; a Gaussian on the difference
    of bigram counts (summed in tasks, see ``vectors.cider_parts``); mean over orders and references, times 10."""
    st = stats or Stats(refs, sys, max_n, "caption")
    parts = V.cider_parts(st.texts, st.how, max_n, sigma, st.systems)
    seg = (parts.groupBy(F.col("inst_id.inst_id").alias("inst_id"), "sys_no")
           .agg((F.sum("value") / max_n / F.sum("n_refs") * 10.0).alias("cider")))
    if st.systems == 1:
        seg = seg.drop("sys_no")
    return seg if level == "segment" else seg.groupBy(*([] if st.systems == 1 else ["sys_no"])).agg(F.avg("cider").alias("cider"))


def meteor_stats(refs, sys, texts: DataFrame | None = None) -> DataFrame:
    """F13 statistics per (inst_id, ref_no): exact matches (k-th occurrence of a token to
    its k-th occurrence), lengths and chunks (runs adjacent on both sides), found in blocks of whole instances
    (``vectors.alignments``).  Instead of (refs, sys) a combined table may be given, as for ``Stats``."""
    return V.alignments(_pair_texts(refs, sys, texts), "caption")


def meteor_expr(m: Column, h: Column, r: Column, ch: Column, alpha: float = 0.9, beta: float = 3.0,
                gamma: float = 0.5) -> Column:
    p = m / h
    rc = m / r
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    pen = gamma * F.pow(ch / m, beta)
    return F.when(m > 0, fmean * (1 - pen)).otherwise(0.0)


def meteor_exact(refs, sys, level: str = "segment", key: Column | None = None, texts: DataFrame | None = None) -> DataFrame:
    """F13 (re-aimed): exact-match METEOR, F = 10PR/(R+9P), penalty 0.5 (chunks/m)^3,
    best reference per instance; the corpus score uses the summed statistics of the
    best references (of every ``key``, a column made from inst_id, if given)."""
    st = meteor_stats(refs, sys, texts)
    sc = st.withColumn("score", meteor_expr(F.col("matches").cast("double"), F.col("hlen").cast("double"),
                                            F.col("rlen").cast("double"), F.col("chunks").cast("double")))
    best = sc.groupBy("inst_id").agg(F.max_by(F.struct("matches", "hlen", "rlen", "chunks", "score"),
                                              F.struct("score", -F.col("ref_no"))).alias("b")).select("inst_id", "b.*")
    if level == "segment":
        return best.select("inst_id", F.col("score").alias("meteor"))
    t = best.groupBy(*([] if key is None else [key.alias("key")])).agg(
        *[F.sum(c).cast("double").alias(c) for c in ("matches", "hlen", "rlen", "chunks")])
    return t.select(*([] if key is None else ["key"]), meteor_expr(F.col("matches"), F.col("hlen"), F.col("rlen"), F.col("chunks")).alias("meteor"))

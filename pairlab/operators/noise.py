"""Semantic-noise detection and repair.

C1 and C2 (the realisations named in a sentence, and which of them stand) run in one
Arrow UDF: one pass of an automaton over the sentence says which alternatives of the
pattern table can match at all, and only those are run.  Everything about
one row after that -- counting (C3), the gold-vs-output comparison (C4), the signed
difference (C5), repair (C6), the dump and the class (C7-C9) -- is array expressions on
that row's few items: no shuffle, no join, nothing cached.  Only the totals (C10, C11)
aggregate.
"""

from __future__ import annotations

import functools
import itertools
import re
from re import _constants, _parser
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.realizations import REALIZATIONS
from pairlab.operators import mr as M
from pairlab.session import ensure_importable

MATCH = T.StructType([T.StructField("slot", T.StringType()), T.StructField("value", T.StringType()),
                      T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
COUNT = T.StructType([T.StructField("slot", T.StringType()), T.StructField("value", T.StringType()),
                      T.StructField("n", T.IntegerType())])
SPANS = T.StructType([T.StructField("all", T.ArrayType(MATCH)), T.StructField("kept", T.ArrayType(MATCH)),
                      T.StructField("ref_counts", T.ArrayType(COUNT))])


class Phrase(NamedTuple):
    """One entry of the pattern table; without a value the matched text is the value."""
    slot: str
    value: str | None
    alternatives: tuple[str, ...]


def _bounded(alternative: str) -> str:
    left = "" if alternative[0] == "^" else r"\b"
    right = "" if alternative[-1] == "$" else r"\b"
    return left + alternative + right


@functools.cache
def phrases() -> tuple[Phrase, ...]:
    """The pattern table, in the order in which ties are settled."""
    out = []
    for slot, spec in REALIZATIONS.items():
        by_value = spec.items() if isinstance(spec, dict) else [(None, spec)]
        out += [Phrase(slot, value, tuple(alternatives)) for value, alternatives in by_value]
    return tuple(out)


@functools.lru_cache(maxsize=1 << 14)
def _pattern(alternatives: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(_bounded, alternatives)), re.IGNORECASE)


def folded(text: str) -> str:
    """Text in which letters that a case-insensitive pattern takes for equal are the same."""
    return text.casefold().replace("\u0131", "i")


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    return max(sets, key=lambda x: (min(map(len, x)), -len(x)))


def _needed(parsed) -> list[frozenset[str]]:
    """Sets of strings; every match of a parsed pattern holds at least one of each set."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append(frozenset([folded(run)]))
            run = ""
        if op is _constants.SUBPATTERN:
            found += _needed(arg[-1])
        elif op is _constants.BRANCH:
            each = [_needed(b) for b in arg[1]]
            if all(each):
                found.append(frozenset().union(*map(_best, each)))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[0] > 0:
            found += _needed(arg[2])
    return found


@functools.cache
def _triggers() -> tuple[ahocorasick.Automaton, tuple[tuple[int, int], ...]]:
    """An automaton that gives for each string that it finds a bit, and the alternatives that can match only
    beside the string, each as (phrase, its bit, masks that the bits found must all meet); and
    the (phrase, alternative) that must always be tried."""
    always, bits, places = [], {}, {}
    mask = lambda strings: sum(bits.setdefault(x, 1 << len(bits)) for x in sorted(strings))
    for i, phrase in enumerate(phrases()):
        for j, alternative in enumerate(phrase.alternatives):
            needed = [x for x in _needed(_parser.parse(alternative)) if min(map(len, x)) > 1]  # a blank tells nothing
            if not needed:
                always.append((i, j))
                continue
            first = _best(needed)
            others = tuple(mask(x) for x in needed if x != first)
            for x in first:
                bits.setdefault(x, 1 << len(bits))
                places.setdefault(x, []).append((i, 1 << j, others))
    automaton = ahocorasick.Automaton()
    for x, bit in bits.items():
        automaton.add_word(x, (bit, tuple(places.get(x, ()))))
    automaton.make_automaton()
    return automaton, tuple(always)


@functools.lru_cache(maxsize=1 << 14)
def _phrase(i: int, which: int) -> tuple[str, str | None, re.Pattern]:
    """Slot and value of a phrase, and a pattern of some of its alternatives."""
    p = phrases()[i]
    return p.slot, p.value, _pattern(tuple(a for j, a in enumerate(p.alternatives) if which >> j & 1))


def matches(ref: str) -> list[tuple[str, str, int, int]]:
    """(slot, value, start, end) of all matches, in pattern order.  Only the alternatives whose required
    strings all stand in the sentence are run; the others can't match, so the rest find the same."""
    automaton, always = _triggers()
    seen, beside = 0, [(i, 1 << j, ()) for i, j in always]
    for _, (bit, places) in automaton.iter(folded(ref)):
        if not seen & bit:
            seen |= bit
            beside += places
    able: dict[int, int] = {}
    for i, bit, others in beside:
        for m in others:
            if not seen & m:
                break
        else:
            able[i] = able.get(i, 0) | bit
    out = []
    for i in sorted(able):
        slot, value, pattern = _phrase(i, able[i])
        out += [(slot, value or proper(slot, m[0]), *m.span()) for m in pattern.finditer(ref)]
    return out


@functools.cache
def _spelling(slot: str) -> dict[str, str]:
    return {value.lower(): value for value in REALIZATIONS.get(slot, ())}


def proper(slot: str, value: str) -> str:
    """A value as the table spells it."""
    return _spelling(slot).get(value.lower(), value)


def _standing(hits: list[tuple], gold: set[tuple]) -> list[tuple]:
    """The hits that count, in pattern order.

    Spans are swept by start, longer ones first: a span that ends no later than what has been
    reached lies inside a longer one and falls.  Where several values share a span, the
    one that the gold MR has stands; two gold ones fall together; with none it is the first."""
    at: dict[tuple, list[int]] = {}
    for i, (_, _, start, end) in enumerate(hits):
        at.setdefault((start, end), []).append(i)
    reached, stand = -1, []
    for start, end in sorted(at, key=lambda x: (x[0], -x[1])):
        if end <= reached:
            continue
        reached = end
        rivals = at[start, end]
        expected = [i for i in rivals if hits[i][:2] in gold]
        if len(rivals) == 1 or not expected:
            stand.append(rivals[0])
        elif len(expected) == 1:
            stand += expected
    return [hits[i] for i in sorted(stand)]


def _spans(ref: str | None, gold_items) -> tuple[list, list, list]:
    """All hits, those that stand, and the counts under trap T1 of one sentence, as tuples."""
    gold = {(slot, proper(slot, value)) for slot, value in gold_items}
    hits = matches(ref or "")
    stand = _standing(hits, gold)
    last = phrases()[-1].value
    trapped: dict[tuple, int] = {}
    for slot, value, _, _ in stand:
        trapped[slot, value] = trapped.get((slot, last), 0) + 1
    return hits, stand, [(*k, n) for k, n in trapped.items()]


def find_spans(ref: str, gold_items) -> dict:
    """C1 + C2 for one sentence.  ``gold_items``: (slot, value) pairs of the gold MR
    (normalised slot names).  Returns all hits, those that stand, and the counts under trap T1
    (every value's count restarts from that of the table's last value)."""
    named = lambda rows, keys: [dict(zip(keys, r)) for r in rows]
    return {name: named(rows, kind.names) for name, rows, kind in zip(SPANS.names, _spans(ref, gold_items), (MATCH, MATCH, COUNT))}


def _lists(rows: list[list[tuple]], kind: T.StructType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, built by column."""
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    columns = list(zip(*itertools.chain.from_iterable(rows))) or [()] * len(kind)
    types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() for f in kind]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], kind.names))


@F.arrow_udf(SPANS)
def _spans_udf(ref: pa.Array, gold: pa.Array) -> pa.Array:
    found = [_spans(r, [x.split("\t", 1) for x in g or ()]) for r, g in zip(ref.to_pylist(), gold.to_pylist())]
    return pa.StructArray.from_arrays([_lists([x[k] for x in found], kind) for k, kind in enumerate((MATCH, MATCH, COUNT))], SPANS.names)


def gold_items(mr: Column) -> Column:
    return F.transform(M.mr_items(mr, normalize=True), lambda s: F.concat(s["slot"], F.lit("\t"), s["value"]))


def with_spans(df: DataFrame, mr: str = "mr", ref: str = "ref") -> DataFrame:
    """Adds ``spans`` = struct(all, kept, ref_counts) per row."""
    ensure_importable(df.sparkSession)
    return df.withColumn("spans", _spans_udf(F.col(ref), gold_items(F.col(mr))))


def slot_matches(spanned: DataFrame, which: str = "all") -> DataFrame:
    """C1 (which='all') / C2 (which='kept'): matches as rows (inst_id, slot, value, start, end)."""
    return spanned.select("inst_id", F.inline(F.col(f"spans.{which}")))


def output_counts(reference_counts: bool = False) -> Column:
    """C3 on a row with ``spans``: array<struct<slot, value, n>>."""
    return F.col("spans.ref_counts") if reference_counts else M.counted(F.col("spans.kept"))


def reclassify_mr(spanned: DataFrame, reference_counts: bool = False) -> DataFrame:
    """Output MR counted in long form (inst_id, slot, value, n)."""
    return spanned.select("inst_id", F.inline(output_counts(reference_counts)))


def _sum(items: Column, value) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("int"))


def _n_of(counts: Column, key: Column) -> Column:
    return _sum(F.filter(counts, lambda c: (c["slot"] == key["slot"]) & (c["value"] == key["value"])), lambda c: c["n"])


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compared(df: DataFrame, gold: Column, out: Column, fix_type: str = "all",
             reference_counts: bool = False) -> DataFrame:
    """C4-C6 on the row: adds ``items`` = array<struct<slot, value, g, o, fixed, d>> (gold and
    output count, repaired count, signed difference where it counts) and the row's totals
    repeated, valerr, missing and added.  gold, out: array<struct<slot, value, n>>.

    Occurrences beyond the gold count are repeats.  Of a slot that both sides name, surplus and
    deficit that meet are value errors, what is left is added or missing; a slot that only
    one side names is missing or added whole.  fix_type 'all' counts every kind; 'missing' ignores
    additions and 'added' omissions: ignored kinds are neither counted nor changed (copied back from
    gold).  With reference_counts ignored additions are raised instead of lowered (T15)."""
    fix_missing, fix_added = (F.lit(fix_type == "all" or k in fix_type) for k in ("missing", "added"))

    def kept(x):  # the output count without repeats
        return F.when((x["g"] > 0) & (x["o"] > x["g"]), x["g"]).otherwise(x["o"])

    def both_counts(c):
        keys = F.array_distinct(F.concat(*(F.transform(c[side], lambda x: F.struct(
            x["slot"].alias("slot"), x["value"].alias("value"))) for side in ("gold", "out"))))
        return F.transform(keys, lambda k: F.struct(
            k["slot"].alias("slot"), k["value"].alias("value"), _n_of(c["gold"], k).alias("g"), _n_of(c["out"], k).alias("o")))

    def by_slot(items):
        def one(slot):
            return _let(F.filter(items, lambda x: x["slot"] == slot), lambda own: F.struct(
                slot.alias("slot"), _sum(own, lambda x: x["g"]).alias("g"), _sum(own, lambda x: x["o"]).alias("o"),
                _sum(own, lambda x: x["o"] - kept(x)).alias("rep"),
                _sum(own, lambda x: F.when(fix_missing, F.greatest(x["g"] - kept(x), F.lit(0)))).alias("less"),
                _sum(own, lambda x: F.when(fix_added, F.greatest(kept(x) - x["g"], F.lit(0)))).alias("more")))
        return F.transform(F.array_distinct(F.transform(items, lambda x: x["slot"])), one)

    def result(items, slots):
        both = lambda s: (s["g"] > 0) & (s["o"] > 0)

        def item(x):
            named = lambda side: F.exists(slots, lambda s: (s["slot"] == x["slot"]) & (s[side] > 0))
            change = kept(x) - x["g"]
            counts = F.when(change < 0, fix_missing).when(change > 0, fix_added).otherwise(F.lit(True))
            ignored = F.when((change > 0) & named("g") & F.lit(reference_counts), kept(x) + change).otherwise(x["g"])
            return F.struct(x["slot"].alias("slot"), x["value"].alias("value"), x["g"].alias("g"), x["o"].alias("o"),
                            F.when(counts, F.when(named("o"), kept(x)).otherwise(0)).otherwise(ignored).cast("int").alias("fixed"),
                            F.when(counts, change).otherwise(0).cast("int").alias("d"))

        return F.struct(
            F.transform(items, item).alias("items"),
            _sum(slots, lambda s: F.when(both(s), s["rep"])).alias("repeated"),
            _sum(slots, lambda s: F.when(both(s), F.least(s["less"], s["more"]))).alias("valerr"),
            _sum(slots, lambda s: F.when(both(s), F.greatest(s["less"] - s["more"], F.lit(0)))
                 .when(s["g"] > 0, F.when(fix_missing, s["g"]))).alias("missing"),
            _sum(slots, lambda s: F.when(both(s), F.greatest(s["more"] - s["less"], F.lit(0)))
                 .when(s["o"] > 0, F.when(fix_added, s["o"]))).alias("added"))

    whole = _let(F.struct(gold.alias("gold"), out.alias("out")), lambda c: _let(
        both_counts(c), lambda items: _let(by_slot(items), lambda slots: result(items, slots))))
    return df.withColumn("_compared", whole).select(*df.columns, "_compared.*")


def diff_json(items: Column) -> Column:
    """JSON {slot: {value: out - gold}}, keys sorted, zero entries and empty slots left out
    (compact JSON, UTF-8)."""
    def whole(changed):
        def one(slot):
            own = F.filter(changed, lambda x: x["slot"] == slot)
            values = F.array_sort(F.transform(own, lambda x: F.struct(x["value"].alias("value"), x["d"].alias("d"))))
            return F.concat(F.lit('"'), slot, F.lit('":'), F.to_json(F.map_from_entries(values)))
        return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(changed, lambda x: x["slot"]))), one), ",")
    return F.concat(F.lit("{"), _let(F.filter(items, lambda x: x["d"] != 0), whole), F.lit("}"))


def instance_errors(pairs: DataFrame, fix_type: str = "all", reference_counts: bool = False,
                    mr: str = "mr", ref: str = "ref", keep: tuple = ()) -> DataFrame:
    """C4-C9 per row: inst_id, columns to keep, mr, ref, added, missing, valerr, repeated, mr_len,
    diff, fixed_mr, cls."""
    spanned = with_spans(pairs.select("inst_id", *keep, F.col(mr).alias("mr"), F.col(ref).alias("ref")))
    gold = M.counted(F.coalesce(M.mr_items(F.col("mr"), normalize=True), F.array().cast(M.ITEMS)))
    rows = compared(spanned, gold, output_counts(reference_counts), fix_type, reference_counts)
    fixed = F.transform(F.filter("items", lambda x: x["fixed"] > 0), lambda x: F.struct(
        x["slot"].alias("slot"), x["value"].alias("value"), x["fixed"].alias("n")))
    a, m, v, r = (F.col(c) for c in ("added", "missing", "valerr", "repeated"))
    cls = (F.when(((a > 0) & (m > 0)) | (v > 0), "M+A").when((a > 0) | (r > 0), "Add")
           .when(m > 0, "Mis").otherwise("OK"))
    return rows.select("inst_id", *keep, "mr", "ref", a, m, v, r, _sum(F.col("items"), lambda x: x["g"]).alias("mr_len"),
                       diff_json(F.col("items")).alias("diff"), M.render_items(fixed).alias("fixed_mr"), cls.alias("cls"))


def fixed_rows(errors: DataFrame) -> DataFrame:
    """Repaired MR, original MR and the changed flag."""
    return errors.select("inst_id", F.col("fixed_mr").alias("mr"), "ref",
                         (F.col("fixed_mr") != F.col("mr")).cast("int").alias("fixed"),
                         F.col("mr").alias("orig_mr"))


def error_stats(errors: DataFrame, keys=()) -> DataFrame:
    """C10 (C11 with keys): totals, rates and class shares in one aggregation."""
    n = F.count(F.lit(1))
    L = F.sum("mr_len")
    agg = errors.groupBy(*keys).agg(
        n.alias("total_insts"), L.alias("total_attr"),
        F.sum("added").alias("added"), F.sum("missing").alias("missing"),
        F.sum("valerr").alias("valerr"), F.sum("repeated").alias("repeated"),
        F.avg((F.col("cls") == "OK").cast("double")).alias("inst_ok"),
        F.avg((F.col("cls") == "Add").cast("double")).alias("inst_add"),
        F.avg((F.col("cls") == "Mis").cast("double")).alias("inst_mis"),
        F.avg((F.col("cls") == "M+A").cast("double")).alias("inst_ma"),
        F.sum((F.col("fixed_mr") == F.col("mr")).cast("long")).alias("identical"))
    tot = F.col("total_attr").cast("double")
    return agg.select(*keys, "total_insts", "total_attr",
                      ((F.col("added") + F.col("missing") + F.col("valerr") + F.col("repeated")) / tot).alias("semerr"),
                      (F.col("added") / tot).alias("ins_rate"), (F.col("missing") / tot).alias("del_rate"),
                      (F.col("valerr") / tot).alias("wvl_rate"),
                      "added", "missing", "valerr", "repeated", "inst_ok", "inst_add", "inst_mis", "inst_ma",
                      "identical")

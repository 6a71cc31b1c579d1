"""Meaning-representation operators (B1-B11), all native column expressions.

An MR is text ``slot[value], slot[value], ...``.  Parsing keeps order and repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.plans import fixtures as fx

# bracket-aware item pattern: slot name (trimmed), then the bracketed value
ITEM = r"\s*([^,\[]+?)\s*\[([^\]]*)\]"
# Slot names of the MR text and their normalised names
SLOT_NORMAL = {"eatType": "eat_type", "priceRange": "price_range",
               "familyFriendly": "family_friendly", "customer rating": "rating"}
PREFIX = "data_to_text: "


def normalize_slot(slot: Column) -> Column:
    out = slot
    for k, v in SLOT_NORMAL.items():
        out = F.when(slot == k, F.lit(v)).otherwise(out)
    return out


def mr_items(mr: Column, normalize: bool = False) -> Column:
    """array<struct<pos:int, slot:string, value:string>> of an MR (order kept)."""
    slots = F.regexp_extract_all(mr, F.lit(ITEM), 1)
    vals = F.regexp_extract_all(mr, F.lit(ITEM), 2)
    return F.transform(F.arrays_zip(slots.alias("slot"), vals.alias("value")), lambda s, i: F.struct(
        i.cast("int").alias("pos"),
        (normalize_slot(s["slot"]) if normalize else s["slot"]).alias("slot"),
        s["value"].alias("value")))


def mr_parse(df: DataFrame, col: str = "mr", keys=("inst_id",), normalize: bool = False) -> DataFrame:
    """B1: one row per MR item -> keys + (pos, slot, value)."""
    return df.select(*keys, F.inline(mr_items(F.col(col), normalize)))


def mr_slot_counts(df: DataFrame, col: str = "mr") -> DataFrame:
    """B2: occurrences per slot; the rollup row (slot null) is the total."""
    items = mr_parse(df, col, keys=())
    return items.rollup("slot").agg(F.count(F.lit(1)).alias("cnt"))


def mr_slot_values(df: DataFrame, col: str = "mr") -> DataFrame:
    """Occurrences per (slot, value)."""
    return mr_parse(df, col, keys=()).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("cnt"))


def remove_tags(mr: Column, sep: str = ",") -> Column:
    """Keep the bracket contents of each comma piece (trimmed); pieces without a
    non-empty bracket vanish."""
    pieces = F.filter(F.split(mr, ","), lambda p: p.rlike(r"\[(.+?)\]"))
    return F.array_join(F.transform(pieces, lambda p: F.trim(F.regexp_extract(p, r"\[(.+?)\]", 1))), sep)


def shuffle_items(mr: Column, key: Column, seed: str = "0", sep: str = ",") -> Column:
    """The comma pieces in a pseudo-random order fixed by md5(seed|key|pos); pieces
    are not trimmed (a piece keeps its leading blank, as in the reference)."""
    tagged = F.transform(F.split(mr, ","), lambda p, i: F.struct(
        F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))).alias("k"), p.alias("v")))
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: s["v"]), sep)


def equal_sign(mr: Column) -> Column:
    """slot[value] -> slot=[value]."""
    return F.replace(mr, F.lit("["), F.lit("=["))


def special_tags(mr_eq: Column, strict: bool = True) -> Column:
    """``slot=[v]`` -> ``<slot> slot=[v]`` joined by ', '.  With strict=False the
    last pair prints the literal word ``tag_name`` (the reference's behaviour)."""
    pieces = F.split(mr_eq, ",")
    n = F.size(pieces)

    def one(p, i):
        tag = F.trim(F.substring_index(p, "=", 1))
        value = F.substring_index(p, "=", -1)
        name = tag if strict else F.when(i == n - 1, F.lit("tag_name")).otherwise(tag)
        return F.concat(F.lit("<"), tag, F.lit("> "), name, F.lit("="), value)
    return F.array_join(F.transform(pieces, one), ", ")


def add_prefix(mr: Column) -> Column:
    """The task prefix in front of the (string-cast, null-safe) MR."""
    return F.concat(F.lit(PREFIX), F.coalesce(mr.cast("string"), F.lit("None")))


def remove_prefix(text: Column) -> Column:
    return F.when(text.startswith(PREFIX), F.substring(text, len(PREFIX) + 1, 1 << 30)).otherwise(text)


def delex_key(mr: Column, slots=tuple(fx.DELEX_SLOTS)) -> Column:
    """Canonical key of the delexicalised MR: sorted ``slot=value`` items, values of
    the chosen slots replaced by a constant."""
    items = F.transform(mr_items(mr), lambda s: F.concat(
        s["slot"], F.lit("="),
        F.when(s["slot"].isin(*slots), F.lit(fx.DELEX_TOKEN)).otherwise(s["value"])))
    return F.array_join(F.array_sort(items), "|")


#: Type of ``mr_items``.
ITEMS = "array<struct<pos: int, slot: string, value: string>>"


def counted(items: Column) -> Column:
    """array<struct<slot, value, ...>> -> array<struct<slot, value, n>>, on the row."""
    def count(own):  # bound once, as the inner lambda reads it for every key
        keys = F.array_distinct(F.transform(own, lambda x: F.struct(x["slot"].alias("slot"), x["value"].alias("value"))))
        return F.transform(keys, lambda k: F.struct(
            k["slot"].alias("slot"), k["value"].alias("value"),
            F.size(F.filter(own, lambda x: (x["slot"] == k["slot"]) & (x["value"] == k["value"]))).alias("n")))
    return F.element_at(F.transform(F.array(items), count), 1)


def mr_counts(df: DataFrame, col: str = "mr", keys=("inst_id",)) -> DataFrame:
    """Counted MR in long form keys + (slot, value, n), slots normalised; local to a row."""
    return df.select(*keys, F.inline(counted(mr_items(F.col(col), normalize=True))))


# Slot order used when rendering an MR (same order as the E2E data)
RENDER_ORDER = fx.NORM_SLOTS
CAMEL = [("eat_type", "eatType"), ("price_range", "priceRange"), ("family_friendly", "familyFriendly")]


def render_items(items: Column) -> Column:
    """array<struct<slot, value, n>> (normalised slots) -> MR text in the fixed slot
    order; ``rating[`` becomes ``customer rating[`` and snake_case names camelCase."""
    rank = F.array(*[F.lit(s) for s in RENDER_ORDER])
    keyed = F.transform(items, lambda s: F.struct(
        F.coalesce(F.array_position(rank, s["slot"]), F.lit(99)).alias("r"), s["slot"].alias("slot"),
        s["value"].alias("value"), s["n"].alias("n")))
    texts = F.transform(F.array_sort(keyed), lambda s: F.array_join(
        F.array_repeat(F.concat(s["slot"], F.lit("["), s["value"], F.lit("]")), s["n"]), ", "))
    out = F.array_join(F.filter(texts, lambda t: t != ""), ", ")
    out = F.regexp_replace(out, r"rating\[", "customer rating[")
    for a, b in CAMEL:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rendered(mr: Column) -> Column:
    """B11 on the row: an MR in the fixed slot order."""
    return render_items(counted(mr_items(mr, normalize=True)))


def mr_render(counts: DataFrame, keys=("inst_id",)) -> DataFrame:
    """B11 over the long form: keys + (mr)."""
    return counts.groupBy(*keys).agg(
        render_items(F.collect_list(F.struct("slot", "value", "n"))).alias("mr"))

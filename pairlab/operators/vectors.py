"""N-gram statistics of whole instances from 64-bit gram ids.

The scorers need, for each instance, the n-gram counts of the system output clipped by the largest
count over its references.  Texts are dealt by instance once, as text; only then are they tokenised, in the
task, and a token becomes a 64-bit hash (``functions/tokens.py``).  Inside a task whole instances are taken together in
blocks of about ``BLOCK_TOKENS`` tokens, and all their n-grams are counted at once with numpy: the
id of a gram is mixed from the id of its first n - 1 tokens and its last token, so a gram knows its
prefix; distinct grams of a text, and of an instance's references, are runs of a sorted array; clipping is a
search in it.  What leaves a task is one row an instance, or one row a distinct gram of a block, so no
gram string is ever shuffled and a gram that stands in every text is one row a block.

An instance is one task's work; references from number ``REF_BLOCK`` on (numbers count from 0 in each
instance) are first merged in groups of ``REF_BLOCK``, elsewhere, to one row with their counts, so that an
instance with a third of all references is many tasks too.

NIST needs the information log2(count of the prefix / count) of each gram in the corpus.  All grams that begin at a token of a
reference go to a part of the corpus as one window of codes (``Windows``), chosen by its first two tokens: the prefix of a gram
begins at the same token, so a part that sorts its windows has the totals of both, for every order.  The totals of
frequent tokens are known before (``frequent_tokens``), and rare ones have their windows in one part.

Texts are read once for every pass over them; the exchange by instance is the same and reused.  Two
different grams with equal ids count as one (n distinct grams: n * n / 2**65 such pairs to be expected).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairlab.functions.tokens import token_lists
from pairlab.session import scratch_path

#: Tokens of a block of instances, and references of an instance that are counted text by text.
BLOCK_TOKENS, REF_BLOCK = 1 << 18, 64
#: Up to so many texts of an instance a gram's key has room for the text's number (8 of 64 bits).
MANY_TEXTS = 256
#: The grams of the greatest totals that tasks hold as a table; every other one holds less than this share.
HOT_GRAMS = 1 << 16
#: Windows of tokens are dealt to 2 ** INFO_BITS parts.
INFO_BITS = 9

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def at_home(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key for each (id, place): equal grams of different texts or instances are told apart."""
    return mixed(ids + (place.astype(np.uint64) + np.uint64(1)) * _C)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it each run of equal keys begins."""
    order = np.argsort(keys)
    if not len(keys):
        return order, order
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))


def found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted table, -1 where missing."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def with_fields(fields: list[T.StructField], ddl: str) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


class Grams:
    """Entries (id, prefix, place, greatest count, sum of counts, number of texts); place is a text or instance."""

    def __init__(self, ids, prefix, place, most, total, texts):
        self.ids, self.prefix, self.place, self.most, self.total, self.texts = ids, prefix, place, most, total, texts

    @property
    def keys(self) -> np.ndarray:
        return at_home(self.ids, self.place)

    def merged(self) -> Grams:
        """One entry for each (id, place), in order of its key."""
        order, first = runs(self.keys)
        at = order[first]  # keys come out sorted
        add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
        return Grams(self.ids[at], self.prefix[at], self.place[at],
                     np.maximum.reduceat(self.most[order], first) if len(first) else self.most, add(self.total), add(self.texts))

    def by_id(self, *more: np.ndarray) -> tuple:
        """(ids, prefixes, and the sums of total, texts and further columns) of distinct grams."""
        order, first = runs(self.ids)
        at = order[first]
        return (self.ids[at], self.prefix[at],
                *(np.add.reduceat(x[order], first) if len(first) else x for x in (self.total, self.texts, *more)))

    def some(self, mask: np.ndarray) -> Grams:
        return Grams(self.ids[mask], self.prefix[mask], self.place[mask], self.most[mask], self.total[mask], self.texts[mask])

    @staticmethod
    def joined(parts: list[Grams]) -> Grams:
        return Grams(*(np.concatenate([getattr(g, n) for g in parts]) for n in ("ids", "prefix", "place", "most", "total", "texts")))


def grams_of(tokens: np.ndarray, offsets: np.ndarray, max_n: int):
    """For n = 1 to max_n the distinct grams of every text, with their counts (place: the text)."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(tokens))
    ids, prefix = mixed(tokens * _A + _B), np.zeros(len(tokens), np.uint64)
    for n in range(1, max_n + 1):
        here = text[at]
        order, first = runs(at_home(ids, here))
        count = np.diff(np.append(first, len(order)))
        some = order[first]
        grams = Grams(ids[some], prefix[some], here[some], count, count, np.ones(len(first), np.int64))
        grams.at, grams.first = at[order], first  # where each gram's occurrences are
        yield grams
        inside = at + n < len(tokens)
        inside[inside] = text[at[inside] + n] == here[inside]
        at, prefix = at[inside], ids[inside]
        ids = mixed(prefix * _A + tokens[at + n] * _B + np.uint64(n))


class Block:
    """Whole instances: their keys, texts and lengths.  A row with ``toks`` is a text (a negative ref_no: a
    system's); one without is ``merged``: grams and lengths of several references, or values looked up."""

    def __init__(self, rows: pa.Table, inst: np.ndarray, max_n: int):
        self.n, self.inst, self.max_n = int(inst[-1]) + 1, inst, max_n
        self.keys = rows.column("inst_id").combine_chunks().take(pa.array(np.flatnonzero(np.diff(inst, prepend=-1))))
        self.ref_no = rows.column("ref_no").to_numpy()
        toks = rows.column("toks").combine_chunks()
        self.is_text = pc.is_valid(toks).to_numpy(zero_copy_only=False)
        self.size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.ascontiguousarray(pc.list_flatten(toks).to_numpy(zero_copy_only=False)).view(np.uint64)
        self.is_sys, self.is_ref = self.is_text & (self.ref_no < 0), self.is_text & (self.ref_no >= 0)
        self.systems = np.flatnonzero(self.is_sys)
        self.merged = [(inst[i], _read_row(rows.column("merged")[int(i)].as_py())) for i in np.flatnonzero(~self.is_text)]
        # lengths of all references, by instance
        at = np.concatenate([inst[self.is_ref], *(np.full(len(m["lens"]), i) for i, m in self.merged)]).astype(np.int64)
        size = np.concatenate([self.size[self.is_ref], *(m["lens"] for _, m in self.merged)])
        order = np.argsort(at, kind="stable")
        self.ref_inst, self.ref_size = at[order], size[order]

    def orders(self):
        """For n = 1 to max_n: (n, grams of the references by instance, grams of the system outputs by text,
        where in the first each of the second stands, or -1)."""
        for n, g in enumerate(grams_of(self.tokens, self.offsets, self.max_n), 1):
            system, refs = g.some(self.is_sys[g.place]), g.some(self.is_ref[g.place])
            refs.place = self.inst[refs.place]
            parts = [refs] + [_from_row(m, n, i) for i, m in self.merged]
            refs = Grams.joined(parts).merged()
            system.at, system.first = g.at, g.first[self.is_sys[g.place]]
            yield n, refs, system, found(refs.keys, at_home(system.ids, self.inst[system.place]))

    @property
    def is_plain(self) -> bool:
        """Whether ``common_grams`` finds all hits."""
        return not self.merged and np.bincount(self.inst).max() <= MANY_TEXTS

    def hit_places(self):
        """For n = 1 to max_n: the tokens of system outputs where grams begin that are hits: the first ones of a text, as many as
        count."""
        if self.is_plain:
            for n, _, h, _, _, at, first in self.common_grams(False):
                yield n, at[_from(first, h)]
        else:
            for n, refs, system, at in self.orders():
                yield n, system.at[_from(system.first, clipped(refs, system, at))]

    def common_grams(self, info: bool):
        """As ``orders``, for blocks of texts alone, only the hits (see ``common_grams``)."""
        text = np.repeat(np.arange(len(self.size)), self.size)
        words = np.bincount(self.ref_inst, self.ref_size, minlength=self.n).astype(np.int64)[self.inst[text]] if info else None
        return common_grams(self.tokens, text, self.inst, self.is_sys, self.is_ref, self.max_n, words)


def common_grams(tokens: np.ndarray, text: np.ndarray, inst: np.ndarray, is_sys: np.ndarray, is_ref: np.ndarray, max_n: int,
                 words: np.ndarray | None = None):
    """For n = 1 to max_n: (n, text of a system output, hits of a gram in it, and with ``words``, the reference words of
    each token's instance, how often the references hold the gram's prefix and the gram; then the places of all grams,
    and where in them those of the output's gram begin).

    A gram that a system output shares with a reference begins and ends with shorter ones that they share, so
    only places where these are shared are looked at in the next order."""
    # a text's number in its instance fills the last bits of a key: texts of a gram are neighbours
    nth = _nth(inst)
    bits = np.uint64(int(nth.max(initial=0)).bit_length())
    nth = nth.astype(np.uint64)
    at, ids, prefix = np.arange(len(tokens)), mixed(tokens * _A + _B), words
    for n in range(1, max_n + 1):
        if not len(at):
            return
        here = text[at]
        key = (at_home(ids, inst[here]) << bits) | nth[here]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(order)))
        gram = key[first] >> bits
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        start, of = np.flatnonzero(new), np.cumsum(new) - 1
        owner = here[order[first]]
        by_ref = np.where(is_ref[owner], count, 0)
        most = np.maximum.reduceat(by_ref, start)
        shared = (most > 0) & np.logical_or.reduceat(is_sys[owner], start)
        hit = np.flatnonzero(is_sys[owner] & shared[of])
        h = np.minimum(count[hit], most[of[hit]])
        if words is None:
            yield n, owner[hit], h, None, None, at[order], first[hit]
        else:
            total = np.add.reduceat(by_ref, start)
            yield n, owner[hit], h, prefix[at[order[first[hit]]]], total[of[hit]], at[order], first[hit]
            prefix = np.zeros(len(tokens), np.int64)
            prefix[at[order]] = np.repeat(total[of], count)
        keep = np.zeros(len(tokens) + 1, bool)
        keep[at[order]] = np.repeat(shared[of], count)
        go = keep[at] & keep[at + 1]
        go[go] = text[at[go] + 1] == here[go]
        at = at[go]
        ids = mixed(ids[go] * _A + tokens[at + n] * _B + np.uint64(n))


def _from(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each first its number of places from there on."""
    return np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)


def instance_hits(texts: list[np.ndarray], max_n: int) -> list[int]:
    """The hits of each order of the first text, the others being its references."""
    is_sys = np.arange(len(texts)) == 0
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    hits = [0] * max_n
    for n, _, h, *_ in common_grams(np.concatenate(texts), text, np.zeros(len(texts), np.int64), is_sys, ~is_sys, max_n):
        hits[n - 1] = int(h.sum())
    return hits


def clipped(refs: Grams, system: Grams, at: np.ndarray) -> np.ndarray:
    """Hits of each gram of the system outputs: its count, at most the largest count in a reference."""
    return np.where(at >= 0, np.minimum(system.most, refs.most[at]), 0) if len(refs.ids) else np.zeros(len(at), np.int64)


#: A merged row in one cell (a struct of arrays costs more to hand to Python than most texts do, also where it is null).
MERGED = "binary"


def _merged_row(lens: np.ndarray, tokens: np.ndarray, *columns: np.ndarray) -> bytes:
    """The lengths and tokens of several references, and their grams: order, id, prefix, greatest count, sum, texts."""
    return np.concatenate([np.array([len(lens)]), lens, tokens, *columns]).astype(np.int64).tobytes()


def _read_row(data: bytes) -> dict:
    x = np.frombuffer(data, np.int64)
    lens = x[1:x[0] + 1]
    tokens, rest = np.split(x[x[0] + 1:], [lens.sum()])
    rest = rest.reshape(6, -1)
    return {"lens": lens, "tokens": tokens} | dict(zip(("n", "ids", "prefix", "most", "total", "texts"), rest))


def _from_row(m: dict, n: int, place: int) -> Grams:
    mine = m["n"] == n
    ids, prefix, most, total, texts = (m[c][mine] for c in ("ids", "prefix", "most", "total", "texts"))
    return Grams(ids.view(np.uint64), prefix.view(np.uint64), np.full(len(ids), place), most, total, texts)


def _new_instance(keys: pa.Array) -> np.ndarray:
    """Which rows have another key than the row before (nulls are equal)."""
    out = np.ones(len(keys), bool)
    if len(keys) > 1:
        out[1:] = False
        parts = [keys]
        while any(pa.types.is_struct(p.type) for p in parts):
            parts = [c for p in parts for c in (p.flatten() if pa.types.is_struct(p.type) else [p])]
        for p in parts:
            a, b = p.slice(0, len(p) - 1), p.slice(1)
            other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            out[1:] |= other | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def how_of(rows: DataFrame) -> str:
    """The tokeniser that ``_dealt`` noted at the texts."""
    return rows.schema["text"].metadata["tokens"]


def whole(batches, weight, most: int):
    """Tables of whole instances of rows that come in their order, and the number of each row's instance; about
    ``most`` at a time of what ``weight`` gives for the rows."""
    held = []

    def made(table):
        inst = np.cumsum(_new_instance(table.column("inst_id").combine_chunks())) - 1
        ends = np.cumsum(weight(table))
        lo = 0
        while lo < len(inst):
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)) + 1
            hi = int(np.searchsorted(inst, inst[min(hi, len(inst)) - 1], side="right"))  # to the end of its instance
            yield table.slice(lo, hi - lo), inst[lo:hi] - inst[lo]
            lo = hi

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_new_instance(table.column("inst_id").combine_chunks()))[-1])
            if last:
                yield from made(table.slice(0, last))
                held = table.slice(last).to_batches()
    if held:
        yield from made(pa.Table.from_batches(held))


def _tokenised(rows, how: str):
    """A batch or table with ``toks`` in place of ``text``."""
    at = rows.schema.get_field_index("text")
    text = rows.column(at)
    return rows.set_column(at, "toks", token_lists(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text, how))


def blocks(batches, max_n: int, how: str, most: int | None = None):
    """Whole instances of rows that come in their order, about ``BLOCK_TOKENS`` (or ``most``) tokens at a time."""
    size = lambda table: pc.fill_null(pc.list_value_length(table.column("toks").combine_chunks()), 0).to_numpy()
    for rows, inst in whole((_tokenised(b, how) for b in batches if b.num_rows), size, most or BLOCK_TOKENS):
        yield Block(rows, inst, max_n)


def _merge(max_n: int, how: str):
    """Texts by (instance, group) -> one merged row for each group."""
    def run(batches):
        for b in blocks(batches, max_n, how):
            refs = [(n, g) for n, g, _, _ in b.orders()]
            all_ = Grams.joined([g for _, g in refs])
            order = np.concatenate([np.full(len(g.ids), n) for n, g in refs])
            by = np.argsort(all_.place, kind="stable")
            cut = np.searchsorted(all_.place[by], np.arange(1, b.n))
            columns = (order, all_.ids.view(np.int64), all_.prefix.view(np.int64), all_.most, all_.total, all_.texts)
            split = [np.split(v[by], cut) for v in columns]
            lens = np.split(b.size, np.searchsorted(b.inst, np.arange(1, b.n)))  # all texts are references
            tokens = np.split(b.tokens.view(np.int64), np.cumsum([x.sum() for x in lens])[:-1])
            cells = [_merged_row(*x) for x in zip(lens, tokens, *split)]
            keys, groups = b.keys.flatten()
            yield pa.RecordBatch.from_arrays([keys, groups, pa.array(cells, pa.binary())], ["inst_id", "ref_no", "merged"])
    return run


def by_instance(texts: DataFrame, how: str, max_n: int) -> DataFrame:
    """(inst_id, ref_no, text, merged) dealt by instance and in order.  ``texts``: (inst_id, ref_no, text), a
    negative ref_no is a system's output; ``how`` names the tokeniser (``tokens.KINDS``)."""
    texts = texts.select("inst_id", F.col("ref_no").cast("int").alias("ref_no"), "text")
    group = F.floor(F.col("ref_no") / REF_BLOCK).cast("int").alias("group")
    many = (texts.where(F.col("ref_no") >= REF_BLOCK).select("inst_id", group, "ref_no", "text").repartition("inst_id", "group")
            .select(F.struct("inst_id", "group").alias("inst_id"), "ref_no", _plain(F.col("text"), how).alias("text"),
                    F.lit(None).cast(MERGED).alias("merged")).sortWithinPartitions("inst_id", "ref_no"))
    schema = with_fields([texts.schema["inst_id"]], f"ref_no int, merged {MERGED}")
    merged = many.mapInArrow(_merge(max_n, how), schema).select("inst_id", "ref_no", F.lit(None).cast("string").alias("text"), "merged")
    few = texts.where(F.col("ref_no") < REF_BLOCK).withColumn("merged", F.lit(None).cast(MERGED))
    return _dealt(few.unionByName(merged), how)


def _plain(text: Column, how: str) -> Column:
    """What ``token_lists`` reads: no nulls, and for caption tokens lower case."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(text) if how in ("caption", "blank") else text


def _dealt(rows: DataFrame, how: str) -> DataFrame:
    text = F.when(F.col("merged").isNull(), _plain(F.col("text"), how)).alias("text", metadata={"tokens": how})
    return rows.repartition("inst_id").select("inst_id", "ref_no", text, "merged").sortWithinPartitions("inst_id", "ref_no")


def by_pair(texts: DataFrame, how: str, extra: DataFrame | None = None) -> DataFrame:
    """As ``by_instance``, for measures of a reference: instances are (instance, group of ``REF_BLOCK``
    references), and the system output goes to every group."""
    group = F.greatest(F.floor(F.col("ref_no") / REF_BLOCK), F.lit(0)).cast("int")
    rows = texts.select("inst_id", F.col("ref_no").cast("int").alias("ref_no"), "text", group.alias("group"))
    further = rows.where("group > 0").select(F.col("inst_id").alias("of"), F.col("group").alias("to")).distinct()
    copies = (rows.where("ref_no < 0").join(further, F.col("inst_id").eqNullSafe(F.col("of")))
              .select("inst_id", "ref_no", "text", F.col("to").alias("group")))
    rows = rows.unionByName(copies).select(F.struct("inst_id", "group").alias("inst_id"), "ref_no", "text",
                                           F.lit(None).cast(MERGED).alias("merged"))
    return _dealt(rows if extra is None else rows.unionByName(extra), how)


# ---------------------------------------------------------------- rows an instance

def instance_stats(rows: DataFrame, max_n: int, info: bool = False) -> DataFrame:
    """A row for each system output whose instance has references: (inst_id, sys_no, sys_len, n_refs, nrefs,
    ref_len_sum, closest, closest_nz, shortest, hits, ref_count, info).

    nrefs counts references that have tokens; closest is the reference length nearest to the system's (the
    shorter on a tie), closest_nz that among references with tokens (0 if none); hits and ref_count (the n-grams
    of all references) have a cell for each order, and so has info, the information of the hits from the
    instance's own references (with ``info``, else null)."""
    schema = with_fields([rows.schema["inst_id"]], "sys_no int, sys_len long, n_refs long, nrefs long, ref_len_sum long, closest long, "
                         "closest_nz long, shortest long, hits array<long>, ref_count array<long>, info array<double>")

    how = how_of(rows)

    def run(batches):
        for b in blocks(batches, max_n, how):
            counts = np.bincount(b.ref_inst, minlength=b.n)
            use = b.systems[counts[b.inst[b.systems]] > 0]
            if not len(use):
                continue
            inst, size, place = b.inst[use], b.size[use], np.full(len(b.inst), -1)
            place[use] = np.arange(len(use))
            hits, told = np.zeros((len(use), max_n), np.int64), np.zeros((len(use), max_n))
            former = None
            plain = b.is_plain
            for n, text, h, whole, own, _, _ in b.common_grams(info) if plain else ():
                hits[:, n - 1] = np.bincount(place[text], h, minlength=len(use))
                if info:
                    told[:, n - 1] = np.bincount(place[text], h * np.log2(whole / own), minlength=len(use))
            for n, refs, system, at in () if plain else b.orders():
                h, to = clipped(refs, system, at), place[system.place]
                to, good = np.maximum(to, 0), (to >= 0) & (h > 0)
                hits[:, n - 1] = np.bincount(to[good], h[good], minlength=len(use))
                if info and good.any():
                    one = at[good]
                    if n == 1:
                        whole = np.bincount(refs.place, refs.total, minlength=b.n)[refs.place[one]]
                    else:
                        whole = former.total[found(former.keys, at_home(refs.prefix[one], refs.place[one]))]
                    told[:, n - 1] = np.bincount(to[good], h[good] * np.log2(whole / refs.total[one]), minlength=len(use))
                former = refs
            of = np.arange(1, max_n + 1)
            each = np.maximum(b.ref_size[:, None] - of[None, :] + 1, 0)
            ref_count = np.zeros((b.n, max_n), np.int64)
            np.add.at(ref_count, b.ref_inst, each)
            # all references beside each system output of their instance
            begin = np.searchsorted(b.ref_inst, inst)
            number = counts[inst]
            first = np.concatenate([[0], np.cumsum(number)[:-1]])
            pair = np.repeat(np.arange(len(use)), number)
            length = b.ref_size[np.arange(len(pair)) - first[pair] + begin[pair]]
            far = (np.abs(length - size[pair]) << 32) + length
            least = lambda x: np.minimum.reduceat(x, first)
            never = 1 << 62
            near_nz = least(np.where(length > 0, far, never))
            columns = [size, number, np.add.reduceat((length > 0).astype(np.int64), first), np.add.reduceat(length, first),
                       least(far) & 0xFFFFFFFF, np.where(near_nz == never, 0, near_nz & 0xFFFFFFFF), least(length)]
            lists = lambda m, kind: pa.ListArray.from_arrays(
                pa.array(np.arange(len(use) + 1, dtype=np.int32) * max_n), pa.array(m.ravel(), kind))
            yield pa.RecordBatch.from_arrays(
                [b.keys.take(pa.array(inst)), pa.array(-b.ref_no[use], pa.int32()), *(pa.array(c, pa.int64()) for c in columns),
                 lists(hits, pa.int64()), lists(ref_count[inst], pa.int64()),
                 lists(told, pa.float64()) if info else pa.nulls(len(use), pa.list_(pa.float64()))], schema.fieldNames())

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- information of grams

#: Codes of tokens in a window: none, a rare token (its id follows), and between them the place in the table of frequent ones.
NO_TOKEN, RARE = 0, (1 << 16) - 1
#: Tokens of a block whose windows are sorted together.
WINDOW_TOKENS = 1 << 20


def _token_ids(tokens: np.ndarray) -> np.ndarray:
    """The ids of the grams of one token (different for different tokens)."""
    return mixed(tokens * _A + _B)


def frequent_tokens(rows: DataFrame, texts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, codes, occurrences) of the most frequent tokens of all references, in order of their id, and the number
    of all their tokens.  Codes go by frequency, from 1 on.  ``texts``, where given, are what ``rows`` was dealt from: they need
    not be dealt to be counted."""
    how = how_of(rows)
    if texts is not None:
        rows = texts.select("ref_no", _plain(F.col("text"), how).alias("text"), F.lit(None).cast(MERGED).alias("merged"))

    def counted(batches):
        held, size, words = [], 0, 0

        def summed():
            ids, count = (np.concatenate(x) for x in zip(*held))
            order, first = runs(ids)
            return ids[order[first]], np.add.reduceat(count[order], first)

        def sent(ids, count):
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(count)], ["id", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            refs = pc.greater_equal(batch.column("ref_no"), 0)
            text = pc.filter(batch, pc.and_(refs, pc.is_valid(batch.column("text")))).column("text")
            more = [_read_row(x)["tokens"].view(np.uint64) for x in batch.column("merged").drop_null().to_pylist()]
            tokens = np.concatenate([token_lists(text, how).flatten().to_numpy(zero_copy_only=False).view(np.uint64), *more])
            words += len(tokens)
            ids, count = np.unique(_token_ids(tokens), return_counts=True)
            held.append((ids, count.astype(np.int64)))
            size += len(ids)
            if size >= HELD_TOKENS:
                held = [summed()]
                size = len(held[0][0])
                if size >= HELD_TOKENS // 2:
                    yield sent(*held[0])
                    held, size = [], 0
        if held:
            yield sent(*summed())
        yield sent(np.zeros(1, np.uint64), np.array([words]))

    ids, n = hottest(rows.select("ref_no", "text", "merged").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "n",
                     min(HOT_GRAMS, RARE - 1))
    words, ids, n = int(n[ids == 0].sum()), ids[ids != 0], n[ids != 0]
    codes = np.empty(len(ids), np.int64)
    codes[np.argsort(-n, kind="stable")] = np.arange(1, len(ids) + 1)
    return ids, codes, n, words


#: Distinct tokens that a task holds while it counts.
HELD_TOKENS = 1 << 20


def side_by_side(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of numbers of so many bits as few words that sort alike."""
    per, out = max(64 // max(bits, 1), 1), []
    for lo in range(0, len(columns), per):
        word = np.zeros(len(columns[0]), np.uint64)
        for c in columns[lo:lo + per]:
            word = (word << np.uint64(bits)) | c.astype(np.uint64)
        out.append(word)
    return out


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the row before in one of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _planes(columns: list[np.ndarray]) -> bytes:
    """Columns of 16-bit codes: the upper bytes of all, then the lower ones, compressed apart."""
    codes = np.concatenate(columns).astype(np.uint16)
    upper, lower = (pa.compress(x.astype(np.uint8).tobytes(), codec="zstd", asbytes=True) for x in (codes >> 8, codes & 255))
    return len(upper).to_bytes(4, "little") + upper + lower


def _read_planes(data: bytes, n: int, columns: int) -> np.ndarray:
    """(columns, n) of what ``_planes`` packed."""
    cut = 4 + int.from_bytes(data[:4], "little")
    upper, lower = (np.frombuffer(pa.decompress(x, n * columns, codec="zstd", asbytes=True), np.uint8).astype(np.int64) for x in (data[4:cut], data[cut:]))
    return ((upper << 8) | lower).reshape(columns, n)


class Windows:
    """The rows of a block that tell its grams' information, each a window of ``max_n`` tokens (fewer at a text's end) with a tag.

    A reference has one at each token, and its tag is the least order whose gram there is not found at an earlier
    row of the same text: with that order and each longer one the row stands for the references that hold the
    gram, and with every one for an occurrence.  A system output has one at each token where a hit begins, as long
    as the longest; its tag tells the system and the orders of the hits.  Equal rows are one with a number."""

    def __init__(self, b: Block, codes, by_inst: bool):
        """``codes`` gives those of token ids; without ``by_inst`` equal rows of different instances are one too."""
        refs = [(b.tokens, b.offsets, b.inst, b.is_ref)]
        for i, m in b.merged:
            n = len(m["lens"])
            refs.append((m["tokens"].view(np.uint64), np.concatenate([[0], np.cumsum(m["lens"])]), np.full(n, i), np.ones(n, bool)))
        ids, base, at, end, text, inst, tag = [], 0, [], [], [], [], []
        texts = 0
        for tokens, offsets, of, use in refs:
            here = np.repeat(np.arange(len(use)), np.diff(offsets))
            place = np.flatnonzero(use[here])
            here = here[place]
            at.append(place + base)
            end.append(offsets[here + 1] + base)
            text.append(here + texts)
            inst.append(of[here])
            ids.append(_token_ids(tokens))
            base, texts = base + len(tokens), texts + len(use)
        ids, at, end, text, inst = (np.concatenate(x) for x in (ids, at, end, text, inst))
        distinct, local = np.unique(ids, return_inverse=True)
        bits = int(len(distinct)).bit_length()
        tokens = self._tokens(local + 1, at, end, b.max_n)
        words = side_by_side(tokens, bits)
        order = np.lexsort([*words[::-1], text])
        # how many tokens a row has in common with the one before it of the same text
        same, common = ~changes([text[order]]), np.zeros(len(order), np.int64)
        for c in tokens:
            c = c[order]
            same[1:] &= (c[1:] == c[:-1]) & (c[1:] != NO_TOKEN)
            common += same
        tag = np.empty(len(order), np.int64)
        tag[order] = common + 1
        # system outputs: the hits that begin at each token
        hits = np.zeros(len(b.tokens), np.int64)
        for n, places in b.hit_places():
            hits[places] |= 1 << (n - 1)
        place = np.flatnonzero(hits)
        owner = np.repeat(np.arange(len(b.size)), b.size)[place]
        longest = np.frexp(hits[place].astype(float))[1]
        more = self._tokens(local + 1, place, place + longest, b.max_n)
        tokens = [np.concatenate(x) for x in zip(tokens, more)]
        tag = np.concatenate([tag, ((-b.ref_no[owner].astype(np.int64)) << (b.max_n + 1)) + hits[place]])
        inst = np.concatenate([inst, b.inst[owner]]) if by_inst else np.zeros(len(tag), np.int64)
        words = side_by_side(tokens, bits)
        self.code = np.append(NO_TOKEN, codes(distinct))
        part = self._part(distinct, tokens)
        order = np.lexsort([tag, inst, *words[::-1], part])
        first = np.flatnonzero(changes([x[order] for x in (part, *words, inst, tag)]))
        self.number = np.diff(np.append(first, len(order)))
        order = order[first]
        self.tokens, self.tag, self.inst, self.part, self.distinct = [c[order] for c in tokens], tag[order], inst[order], part[order], distinct

    @staticmethod
    def _tokens(local: np.ndarray, at: np.ndarray, end: np.ndarray, max_n: int) -> list[np.ndarray]:
        """The numbers of the tokens from a place on, before an end."""
        local = np.append(local, NO_TOKEN)
        return [local[np.where(at + j < end, at + j, len(local) - 1)] for j in range(max_n)]

    def _part(self, distinct: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
        """By the first two tokens, or by the first alone if it is rare."""
        ids = np.append(np.uint64(0), distinct)
        key = ids[tokens[0]]
        if len(tokens) > 1:
            key = np.where(self.code[tokens[0]] == RARE, key, key + ids[tokens[1]] * _A)
        return (mixed(key * _C) >> np.uint64(64 - INFO_BITS)).astype(np.int64)

    def cells(self):
        """(part, number of rows, their windows, ids of rare tokens, and tags, numbers and instances) of each part."""
        ids = np.append(np.uint64(0), self.distinct)
        codes = [self.code[c] for c in self.tokens]
        begin = np.flatnonzero(changes([self.part]))
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(self.part)).tolist()):
            mine = [c[lo:hi] for c in codes]
            rare = np.concatenate([ids[c[lo:hi][m == RARE]] for c, m in zip(self.tokens, mine)])
            yield (int(self.part[lo]), hi - lo, _planes(mine), rare.tobytes(),
                   _packed(np.concatenate([x[lo:hi] for x in (self.tag, self.number, self.inst)])))


def _totals(cells: list[tuple], max_n: int, frequent) -> tuple:
    """Tags, numbers and instances of the rows of a part's cells, and for each order how often its references hold the gram that a
    row's window begins with (0: its window is shorter)."""
    _, table, occurrences, _ = frequent
    codes, rare, rest = [], [], []
    for n, windows, ids, numbers in cells:
        codes.append(_read_planes(windows, n, max_n))
        rare.append(np.frombuffer(ids, np.uint64))
        rest.append(_unpacked(3 * n, numbers).astype(np.int64).reshape(3, n))
    # rare tokens get codes of this part
    _, back = np.unique(np.concatenate(rare), return_inverse=True)
    lo = 0
    for c, ids in zip(codes, rare):
        c[c == RARE] = back[lo:lo + len(ids)] + RARE
        lo += len(ids)
    codes = list(np.concatenate(codes, axis=1))
    tag, number, inst = np.concatenate(rest, axis=1)
    order = np.lexsort(side_by_side(codes, int(max(c.max(initial=0) for c in codes)).bit_length())[::-1])
    held = np.where(tag <= max_n + 1, number, 0)[order]
    known = np.zeros(RARE + 1, np.int64)
    known[table] = occurrences
    new, totals = np.zeros(len(order), bool), []
    new[:1] = True
    for j, c in enumerate(codes):
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        total = np.repeat(np.add.reduceat(held, first), np.diff(np.append(first, len(order))))
        if j == 0:  # only a rare token has all its rows in this part
            total = np.where(c < RARE, known[np.minimum(c, RARE)], total)
        out = np.empty(len(order), np.int64)
        out[order] = np.where(c == NO_TOKEN, 0, total)
        totals.append(out)
    return tag, number, inst, totals


def _information(tag, number, totals, words: int, max_n: int, systems: int):
    """(kind, order, rows, information): kind 0 are the references, others the systems."""
    is_ref = tag <= max_n + 1
    system = np.where(is_ref, 0, tag >> (max_n + 1))
    before = np.full(len(tag), np.log2(max(words, 1)))
    for j, total in enumerate(totals):
        now = np.log2(np.maximum(total, 1))
        bits = number * (before - now)
        counts = (total > 0) & np.where(is_ref, tag <= j + 1, (tag >> j) & 1 == 1)
        for k in range(systems + 1):
            some = np.flatnonzero(counts & (system == k) if k else counts & is_ref)
            yield k, j, some, bits[some]
        before = now


_CELL = "id int, block long, size long, windows binary, rare binary, numbers binary"


def _cells(rows: DataFrame, max_n: int, frequent, by_inst: bool) -> DataFrame:
    """The cells of all blocks, dealt by part and in order; with ``by_inst`` the keys of a block's instances are rows of part -1."""
    how = how_of(rows)
    schema = with_fields([], _CELL)
    if by_inst:
        schema = schema.add("keys", T.ArrayType(rows.schema["inst_id"].dataType))

    def run(batches):
        ids, table, _, _ = frequent.value

        def codes(x):
            at = found(ids, x)
            return np.where(at >= 0, table[at], RARE) if len(ids) else np.full(len(x), RARE)

        for b in blocks(batches, max_n, how, WINDOW_TOKENS):
            cells = list(Windows(b, codes, by_inst).cells())
            block = uuid.uuid4().int >> 65
            part, size, *binary = zip(*cells) if cells else ((),) * 5
            columns = [pa.array(part, pa.int32()), pa.array([block] * len(cells), pa.int64()), pa.array(size, pa.int64()),
                       *(pa.array(x, pa.binary()) for x in binary)]
            if by_inst:
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(cells), pa.list_(b.keys.type))], schema.fieldNames())
                keys = pa.ListArray.from_arrays(pa.array([0, b.n], pa.int32()), b.keys)
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([block]), pa.array([0]), *[pa.nulls(1, pa.binary())] * 3, keys],
                                                 schema.fieldNames())
            else:
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(run, schema).repartition(tasks, "id").sortWithinPartitions("id")


def _parts(batches, columns: int):
    """(part, the cells of all blocks) of rows in order of their part: (block, size, windows, rare, numbers, ...) each."""
    now, held = None, []
    for b in batches:
        for part, *row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(row)
    if held:
        yield now, held


def corpus_info(rows: DataFrame, max_n: int, systems: int = 1, texts: DataFrame | None = None) -> DataFrame:
    """(n, sys_no, tst_info, ref_info): the information of all hits of a system, and of the distinct
    grams of every reference, for each order.

    The grams of all orders that begin at a token go to a part together, as one window of codes; there windows are
    sorted once, and a gram's occurrences are those of the windows that begin with it."""
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_tokens(rows, texts))

    def summed(batches):
        sums, some = np.zeros((systems + 1, max_n)), False
        for _, cells in _parts(batches, 6):
            some = True
            tag, number, _, totals = _totals([c[1:] for c in cells], max_n, frequent.value)
            for k, j, _, bits in _information(tag, number, totals, frequent.value[3], max_n, systems):
                sums[k, j] += bits.sum()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(1, max_n + 1, dtype=np.int32), systems + 1)),
                                              pa.array(np.repeat(np.arange(systems + 1, dtype=np.int32), max_n)), pa.array(sums.ravel())], ["n", "kind", "bits"])

    bits = _cells(rows, max_n, frequent, False).mapInArrow(summed, "n int, kind int, bits double").groupBy("n").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("bits"))).alias(f"b{k}") for k in range(systems + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("sys_no"), F.col(f"b{k}").alias("tst_info"), F.col("b0").alias("ref_info"))
                     for k in range(1, systems + 1)))
    return bits.select("n", F.inline(each))


def hottest(table: DataFrame, weight: str, least: int = HOT_GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """The ids of greatest weight (``least`` of them, and id 0) and their weights, in order of the id: at most
    1 MB.  Any other gram has less than its 1 / ``least`` share of all weight."""
    top = table.where("id <> 0").orderBy(F.desc(weight), "id").limit(least).unionByName(table.where("id = 0"))
    got = top.select("id", weight).toArrow()
    ids, values = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(ids)
    return ids[order], values[order]


def segment_info(rows: DataFrame, max_n: int, systems: int = 1, texts: DataFrame | None = None) -> DataFrame:
    """(inst_id, info array<double>): the information of the distinct grams of every reference (the first ``max_n`` cells),
    then that of the hits of each system, from the totals of the whole corpus.

    As ``corpus_info``, but a part answers each block with the totals of its windows' grams, small numbers
    that pack well; a block's instances are whole, so what leaves its task is a row an instance."""
    kinds = systems + 1
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_tokens(rows, texts))
    key_type = rows.schema["inst_id"].dataType
    answer = T.StructType([T.StructField("block", T.LongType()), T.StructField("size", T.LongType()), T.StructField("numbers", T.BinaryType()),
                           T.StructField("totals", T.BinaryType()), T.StructField("keys", T.ArrayType(key_type))])

    def answered(batches):
        def plain():
            nonlocal keys
            for batch in batches:
                mine = batch.filter(pc.equal(batch.column(0), -1))
                if mine.num_rows:
                    keys.append(pa.RecordBatch.from_arrays([mine.column(1), mine.column(2), mine.column(5), mine.column(5), mine.column(6)], answer.fieldNames()))
                yield batch.filter(pc.greater_equal(batch.column(0), 0))

        keys = []
        for _, cells in _parts(plain(), 6):
            tag, _, _, totals = _totals([c[1:] for c in cells], max_n, frequent.value)
            least = np.where(tag <= max_n + 1, tag - 1, 0)  # totals that no order of a reference's row asks for
            totals = [np.where(j + 1 >= least, x, 1) * (x > 0) for j, x in enumerate(totals)]
            lo, out = 0, []
            for block, n, _, _, numbers in cells:
                out.append((block, n, numbers, _packed(np.concatenate([x[lo:lo + n] for x in totals]))))
                lo += n
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), answer_keys)], answer.fieldNames())
        yield from keys

    answer_keys = pa.list_(to_arrow_type(key_type))

    def summed(batches):
        held, keys, now = [], None, None

        def settle():
            into = np.zeros((len(keys), kinds, max_n))
            for n, numbers, totals in held:
                tag, number, inst = _unpacked(3 * n, numbers).astype(np.int64).reshape(3, n)
                totals = _unpacked(max_n * n, totals).astype(np.int64).reshape(max_n, n)
                for k, j, some, bits in _information(tag, number, totals, frequent.value[3], max_n, systems):
                    into[:, k, j] += np.bincount(inst[some], bits, minlength=len(keys))
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (kinds * max_n))
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(into.ravel()))], ["inst_id", "info"])

        for batch in batches:
            for i, (block, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if block != now:
                    if keys is not None:
                        yield settle()
                    now, held, keys = block, [], None
                if n:
                    held.append((n, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                else:
                    keys = pa.concat_arrays([batch.column(4).slice(i, 1).flatten()])
        if keys is not None:
            yield settle()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (_cells(rows, max_n, frequent, True).mapInArrow(answered, answer).repartition(tasks, "block").sortWithinPartitions("block")
            .mapInArrow(summed, with_fields([rows.schema["inst_id"]], "info array<double>")))


# ---------------------------------------------------------------- tf-idf similarity (CIDEr)

#: Bytes of text of a block of instances, and 2 ** DF_BITS parts that grams are dealt to, to count the instances that hold them.
BLOCK_BYTES, DF_BITS = 1 << 23, 12


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, the first bytes of all before the second ones, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(size: int, data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _dealt_ids(ids: np.ndarray) -> np.ndarray:
    """Ids whose first bits tell a part; different ones stay different."""
    return mixed(ids * _C)


def _counted_ids(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct dealt ids in order, and the sums of their counts."""
    ids, count = (np.concatenate(x) for x in zip(*parts))
    ids = _dealt_ids(ids)
    order, first = runs(ids)
    return ids[order[first]], np.add.reduceat(count[order], first) if len(first) else count


def _by_part(block: int, ids: np.ndarray, count: np.ndarray, asks: bool) -> pa.RecordBatch:
    """A row for each part of a block's ids: their differences and counts, packed."""
    part = ids >> np.uint64(64 - DF_BITS)
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    ends = np.append(begin[1:], len(part))
    step = np.diff(ids, prepend=np.zeros(1, np.uint64))
    step[begin] = ids[begin]
    cuts = list(zip(begin.tolist(), ends.tolist()))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[begin].astype(np.int32)), pa.array([block] * len(cuts), pa.int64()), pa.array([asks] * len(cuts), pa.bool_()),
         pa.array(ends[:len(begin)] - begin, pa.int64()), pa.array([_packed(step[lo:hi]) for lo, hi in cuts], pa.binary()),
         pa.array([_packed(count[lo:hi]) for lo, hi in cuts], pa.binary())], ["part", "block", "asks", "size", "ids", "count"])


def _frequencies(batches):
    """Rows of ``_by_part`` in order of their part -> (block, part, size, data) for each that asks: how many
    instances hold each of its grams."""
    held, now = [], None

    def answers():
        ids = [np.cumsum(_unpacked(n, x), dtype=np.uint64) for _, _, n, x, _ in held]
        count = [_unpacked(n, x).astype(np.int64) for _, _, n, _, x in held]
        order, first = runs(np.concatenate(ids))
        sums = np.add.reduceat(np.concatenate(count)[order], first)
        freq = np.zeros(len(order), np.int64)
        freq[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
        ends = np.cumsum([len(x) for x in ids]).tolist()
        rows = [(block, now, n, _packed(freq[end - n:end])) for (block, asks, n, _, _), end in zip(held, ends) if asks]
        held.clear()
        if rows:
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                                             ["block", "part", "size", "data"])

    for b in batches:
        for part, *row in zip(*(b.column(i).to_pylist() for i in range(6))):
            if part != now and held:
                yield from answers()
            now = part
            held.append(row)
    if held:
        yield from answers()


def cider_parts(texts: DataFrame, how: str, max_n: int, sigma: float, systems: int = 1) -> DataFrame:
    """(inst_id, sys_no, n_refs, value): for groups of references of an instance, the sum over references and
    orders of the clipped cosine of tf-idf vectors times a Gaussian of the difference in length.

    Blocks of whole groups are written once, as text.  A block sends its distinct gram ids, with the number of its
    instances whose references hold them, to 2 ** ``DF_BITS`` parts by id, as packed differences in a row a part;
    a part sums them and answers each row with the sums, in the same order.  So a gram passes one
    exchange as a few bytes, and its frequency another one.  Instances with several groups of references
    are counted beside that (a block of groups would count them for each)."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = texts.where(F.col("ref_no") >= REF_BLOCK).select(F.col("inst_id").alias("_many")).distinct()
    marks = many.select(F.struct(F.col("_many").alias("inst_id"), F.lit(0).alias("group")).alias("inst_id"), F.lit(0).alias("ref_no"),
                        F.lit(None).cast("string").alias("text"), F.lit(_merged_row(*[np.empty(0, np.int64)] * 2)).alias("merged"))
    pairs = by_pair(texts, how, marks)
    key = pairs.schema["inst_id"]

    def written(batches):
        size = lambda table: pc.fill_null(pc.binary_length(table.column("text").combine_chunks()), 0).to_numpy()
        for rows, inst in whole(batches, size, BLOCK_BYTES):
            outputs = np.unique(inst[(rows.column("ref_no").to_numpy() < 0) & (pc.struct_field(rows.column("inst_id").combine_chunks(), "group").to_numpy() == 0)])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([len(outputs)], pa.int64()),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "outputs", "data"])

    def read(data: bytes) -> Block:
        rows = pa.ipc.open_stream(data).read_all()
        return Block(_tokenised(rows, how), np.cumsum(_new_instance(rows.column("inst_id").combine_chunks())) - 1, max_n)

    def asked(batches):
        for batch in batches:
            for block, data in zip(*(batch.column(i).to_pylist() for i in range(2))):
                b = read(data)
                counted = b.keys.field("group").to_numpy() == 0
                counted[[i for i, _ in b.merged]] = False
                parts = []
                for g in grams_of(b.tokens, b.offsets, max_n):
                    inst = b.inst[g.place]
                    one, use = np.zeros(len(inst), np.int64), np.flatnonzero(b.is_ref[g.place] & counted[inst])
                    order, first = runs(at_home(g.ids[use], inst[use]))
                    one[use[order[first]]] = 1
                    parts.append((g.ids, one))
                yield _by_part(block, *_counted_ids(parts), True)

    def told(batches):
        for b in blocks(batches, max_n, how):
            yield _by_part(0, *_counted_ids([(refs.ids, np.ones(len(refs.ids), np.int64)) for _, refs, _, _ in b.orders()]), False)

    path = scratch_path(spark, "cider-blocks")
    pairs.mapInArrow(written, "block long, outputs long, data binary").write.parquet(path)
    made = spark.read.schema("block long, outputs long, data binary").parquet(path)
    n_all = float(max(made.agg(F.sum("outputs")).first()[0] or 0, 1))
    schema = "part int, block long, asks boolean, size long, ids binary, count binary"
    several = by_instance(texts.join(many, F.col("inst_id").eqNullSafe(F.col("_many")), "left_semi").where("ref_no >= 0"), how, max_n)
    # few files would be few tasks
    counts = made.select("block", "data").repartition(tasks, "block").mapInArrow(asked, schema).unionByName(several.mapInArrow(told, schema))
    freq = (counts.repartition(tasks, "part").sortWithinPartitions("part")
            .mapInArrow(_frequencies, "block long, part int, size long, data binary"))
    schema = with_fields([key], "sys_no int, n_refs long, value double")

    def run(batches):
        block, freq = None, []
        for batch in batches:
            for part, size, data in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                if part >= 0:
                    freq.append(_unpacked(size, data).astype(np.int64))
                    continue
                if block is not None:
                    yield valued(read(block), freq)
                block, freq = data, []
        if block is not None:
            yield valued(read(block), freq)

    def valued(b, freq):
        grams = list(grams_of(b.tokens, b.offsets, max_n))
        ids = np.unique(_dealt_ids(np.concatenate([g.ids for g in grams])))
        freq = np.concatenate([np.empty(0, np.int64), *freq])
        refs = np.flatnonzero(b.is_ref)
        sums = {no: np.zeros(len(b.inst)) for no in range(1, systems + 1)}
        out_of = {no: np.flatnonzero(b.is_sys & (b.ref_no == -no)) for no in sums}
        text_of = {no: _spread(b.n, b.inst[at], at) for no, at in out_of.items()}
        for g in grams:
            home = at_home(g.ids, b.inst[g.place])
            v = g.total * (np.log(n_all) - np.log(np.maximum(freq[np.searchsorted(ids, _dealt_ids(g.ids))], 1)))
            norm = np.sqrt(np.bincount(g.place, v * v, minlength=len(b.inst)))
            r = np.flatnonzero(b.is_ref[g.place])
            for no, total in sums.items():
                s = np.flatnonzero(b.ref_no[g.place] == -no)
                s = s[np.argsort(home[s])]
                at = found(home[s], home[r])
                both = at >= 0
                dot = np.bincount(g.place[r[both]], np.minimum(v[s[at[both]]], v[r[both]]) * v[r[both]], minlength=len(b.inst)).astype(float)
                nh = np.where(text_of[no][b.inst] >= 0, norm[text_of[no][b.inst]], 0)
                total += np.divide(dot, nh * norm, out=dot, where=(nh != 0) & (norm != 0))
        count = np.bincount(b.inst[refs], minlength=b.n)
        out = []
        for no, total in sums.items():
            here = text_of[no]
            pen = np.exp(-(np.maximum(b.size[here[b.inst[refs]]] - 1, 0) - np.maximum(b.size[refs] - 1, 0)) ** 2.0 / (2 * sigma ** 2))
            value = np.bincount(b.inst[refs], total[refs] * pen, minlength=b.n).astype(float)
            use = np.flatnonzero((here >= 0) & (count > 0))
            out.append(pa.RecordBatch.from_arrays([b.keys.take(pa.array(use)), pa.array(np.full(len(use), no, np.int32)),
                                                   pa.array(count[use], pa.int64()), pa.array(value[use])], schema.fieldNames()))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(x.num_rows for x in out) else out[0]

    rows = made.select("block", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("size"), "data").unionByName(freq)
    return rows.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(run, schema)


def _spread(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(n, -1, np.int64)
    out[at] = values
    return out


# ---------------------------------------------------------------- texts beside each other (METEOR, ROUGE-L)

#: Stands for a null ref_no while texts are dealt.
NO_REF = (1 << 31) - 1


def _pair_rows(texts: DataFrame, how: str) -> DataFrame:
    """As ``by_pair``, without instances of null key; a null ref_no is ``NO_REF``."""
    return by_pair(texts.where("inst_id IS NOT NULL").withColumn("ref_no", F.coalesce(F.col("ref_no").cast("int"), F.lit(NO_REF))), how)


def _beside(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of a reference and a system output of its instance, as texts of the block."""
    refs = np.flatnonzero(b.is_ref)
    number = np.bincount(b.inst[b.systems], minlength=b.n)
    begin = np.concatenate([[0], np.cumsum(number)[:-1]])  # system outputs come in order of their instance
    many = number[b.inst[refs]]
    ref = np.repeat(refs, many)
    nth = np.arange(len(ref)) - np.repeat(np.cumsum(many) - many, many)
    return ref, b.systems[np.repeat(begin[b.inst[refs]], many) + nth]


def in_order(*columns: np.ndarray) -> list[np.ndarray]:
    """The rows of columns of whole numbers from 0, sorted: as one number each where they fit into 63 bits."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    packed = columns[0].astype(np.int64)
    for c, n in zip(columns[1:], bits[1:]):
        packed = (packed << n) | c
    packed = np.sort(packed)
    out = []
    for n in bits[:0:-1]:
        out.append(packed & ((1 << n) - 1))
        packed = packed >> n
    return [packed, *out[::-1]]


def _nth(*key: np.ndarray) -> np.ndarray:
    """Which occurrence of its key (from 0) each row is, where equal keys are neighbours."""
    n = len(key[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    first = np.flatnonzero(new)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def alignments(texts: DataFrame, how: str) -> DataFrame:
    """(inst_id, ref_no, rlen, hlen, matches, chunks) for every reference and system output of an instance: the k-th
    occurrence of a token matches its k-th occurrence, chunks are runs of matches that are adjacent on both
    sides.  Rows of an instance with equal ref_no are matched as one text."""
    schema = with_fields([texts.schema["inst_id"]], "ref_no int, rlen int, hlen int, matches long, chunks long")

    def run(batches):
        for b in blocks(batches, 1, how):
            ref, system = _beside(b)
            if not len(ref):
                continue
            text = np.repeat(np.arange(len(b.size)), b.size)
            pos = np.arange(len(b.tokens)) - b.offsets[:-1][text]
            # texts of equal instance and ref_no are one
            new = np.append(True, (b.inst[1:] != b.inst[:-1]) | (b.ref_no[1:] != b.ref_no[:-1]))[:len(b.inst)]
            one = np.cumsum(new) - 1
            words, token = np.unique(b.tokens, return_inverse=True)
            h, r = b.is_sys[text], b.is_ref[text]
            inst, token_h, hpos = in_order(b.inst[text[h]], token[h], pos[h])
            nth = _nth(inst, token_h)
            to, token_r, rpos = in_order(one[text[r]], token[r], pos[r])
            nth_r, inst_of = _nth(to, token_r), np.zeros(one[-1] + 1, np.int64)
            inst_of[one] = b.inst
            # (instance, token, occurrence) as one number; a block has fewer than 2**31 tokens and instances
            most = int(max(nth.max(initial=0), nth_r.max(initial=0))) + 1
            named = lambda i, t, k: mixed((i * len(words) + t).astype(np.uint64) * _A) + k.astype(np.uint64) if b.n * len(words) * most >> 63 else (
                (i * len(words) + t) * most + k).astype(np.uint64)
            key = named(inst, token_h, nth)
            if len(key) > 1 and not (key[1:] > key[:-1]).all():
                order = np.argsort(key)
                key, hpos = key[order], hpos[order]
            at = found(key, named(inst_of[to], token_r, nth_r))
            to, hpos, rpos = in_order(to[at >= 0], hpos[at[at >= 0]], rpos[at >= 0])
            fresh = np.ones(len(to), bool)
            fresh[1:] = (to[1:] != to[:-1]) | (hpos[1:] != hpos[:-1] + 1) | (rpos[1:] != rpos[:-1] + 1)
            matches, chunks = np.bincount(to, minlength=one[-1] + 1), np.bincount(to[fresh], minlength=one[-1] + 1)
            no = b.ref_no[ref]
            known = no != NO_REF
            yield pa.RecordBatch.from_arrays(
                [b.keys.field("inst_id").take(pa.array(b.inst[ref])), pa.array(no, pa.int32(), mask=~known), pa.array(b.size[ref], pa.int32()),
                 pa.array(b.size[system], pa.int32()), pa.array(np.where(known, matches[one[ref]], 0), pa.int64()),
                 pa.array(np.where(known, chunks[one[ref]], 0), pa.int64())], schema.fieldNames())

    return _pair_rows(texts, how).mapInArrow(run, schema)


def common_lengths(texts: DataFrame, how: str, lcs) -> DataFrame:
    """(inst_id, ref_no, rl, sl, lcs) for every reference and system output of an instance: the tokens of both, and of
    their longest common subsequence, ``lcs`` (system's tokens) -> function of a reference's."""
    schema = with_fields([texts.schema["inst_id"]], "ref_no int, rl int, sl int, lcs int")

    def run(batches):
        for b in blocks(batches, 1, how):
            ref, system = _beside(b)
            if not len(ref):
                continue
            _, small = np.unique(b.tokens, return_inverse=True)  # small numbers are quicker keys
            cells = lambda i: small[b.offsets[i]:b.offsets[i + 1]].tolist()
            out, order = np.zeros(len(ref), np.int32), np.argsort(system, kind="stable")
            now = None
            for i in order.tolist():
                if system[i] != now:
                    now = system[i]
                    length = lcs(cells(now))
                out[i] = length(cells(ref[i]))
            no = b.ref_no[ref]
            yield pa.RecordBatch.from_arrays(
                [b.keys.field("inst_id").take(pa.array(b.inst[ref])), pa.array(no, pa.int32(), mask=no == NO_REF),
                 pa.array(b.size[ref], pa.int32()), pa.array(b.size[system], pa.int32()), pa.array(out)], schema.fieldNames())

    return _pair_rows(texts, how).mapInArrow(run, schema)

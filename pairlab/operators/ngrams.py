"""N-gram tables with the grams themselves (E5, E6, E8, E9), and the texts that all scorers read.

Inputs are tables (inst_id, ref_no, text); a system output has ref_no = -1.  Counts are taken by
(instance, reference, gram) with partial aggregation before the exchange.  The scorers need sums over
these tables only and take them from 64-bit gram ids (``operators/vectors.py``); the tables here
are for readers of the grams.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import vectors as V
from pairlab.session import ensure_importable, scratch_path

# how -> (text expression, empty text is one token)
TOKENISERS = {
    "mteval": (lambda c: T.mteval_text(c, "mteval"), True),
    "perl": (lambda c: T.mteval_text(c, "perl"), False),
    "perl_cased": (lambda c: T.mteval_text(c, "cased"), False),
    "caption": (lambda c: T.tokenize_caption(c), False),
    "blank": (lambda c: T.tokenize_caption(c), True),
}


SYS = -1  # ref_no of the system output in a combined text table


def texts_of(refs: DataFrame, sys: DataFrame, ref_col: str = "ref", sys_col: str = "sys") -> DataFrame:
    """Combine references and system outputs into one (inst_id, ref_no, text) table;
    the system output has ref_no = -1."""
    return refs.select("inst_id", F.col("ref_no").cast("int"), F.col(ref_col).alias("text")).unionByName(
        sys.select("inst_id", F.lit(SYS).alias("ref_no"), F.col(sys_col).alias("text")))


def tokenize_texts(texts: DataFrame, how: str = "mteval") -> DataFrame:
    """Normalise every text to blank-separated tokens ``txt`` and its token count ``len``.

    how = "mteval": 13a tokens, lower-cased with full Unicode rules (Python scorer)
    how = "perl":   13a tokens, ASCII-only lower-casing (Perl scorer)
    how = "perl_cased": 13a tokens, case kept
    how = "caption": caption tokens (lower-cased, punctuation removed), whitespace split
    how = "blank":  caption tokens split on one blank (empty text = one empty token)
    """
    fn, empty_token = TOKENISERS[how]
    t = texts.select("inst_id", "ref_no", fn(F.col("text")).alias("txt"))
    return t.withColumn("len", T.token_count(F.col("txt"), empty_token))


def tokenize_pairs(refs: DataFrame, sys: DataFrame, how: str = "mteval",
                   ref_col: str = "ref", sys_col: str = "sys"):
    """Tokenise references and system outputs separately (small inputs, tests)."""
    t = tokenize_texts(texts_of(refs, sys, ref_col, sys_col), how)
    return t.filter(F.col("ref_no") != SYS), t.filter(F.col("ref_no") == SYS).drop("ref_no")


#: The sorted grams of each order and their counts: as arrays, or as text with a line "gram TAB count" for each.
LISTS = "array<struct<n: int, gram: array<string>, cnt: array<long>>>"
LINES = "array<struct<n: int, n_grams: long, total: long, lines: string>>"


def _grams(txt: str, max_n: int, min_n: int, empty_token: bool):
    """The grams of a normalised text by order (as ``text.ngram_array``)."""
    toks = txt.split(" ")
    words = [t for t in toks if t]
    for n in range(min_n, max_n + 1):
        if n == 1:
            yield n, toks if txt or empty_token else ()
        else:
            yield n, map(" ".join, zip(*(words[k:] for k in range(n))))


def _counted(txt: str, max_n: int, min_n: int, empty_token: bool) -> dict[int, Counter]:
    """The grams of a normalised text by order, with their counts."""
    return {n: Counter(grams) for n, grams in _grams(txt, max_n, min_n, empty_token)}


def _most(counts: list[Counter]) -> Counter:
    if len(counts) == 1:
        return counts[0]
    out = counts[0].copy()
    for c in counts[1:]:
        out |= c
    return out


def _listed(texts: pa.Array, max_n: int, min_n: int, empty_token: bool, as_lines: bool) -> pa.Array:
    """Cells of ``LISTS`` or ``LINES`` from cells array<struct<part, txt>>: counts are summed over the texts of a part,
    and the greatest of the parts is taken."""
    begin, rows = [0], []
    flat = texts.flatten()
    part, txt = flat.field("part").to_pylist(), flat.field("txt").to_pylist()
    at = 0
    for size in pc.list_value_length(texts).to_pylist():
        parts: dict = {}
        for k in range(at, at + size):
            if txt[k] is None:
                continue
            new, old = _counted(txt[k], max_n, min_n, empty_token), parts.get(part[k])
            if old is None:
                parts[part[k]] = new
            else:
                for n, c in new.items():
                    old[n].update(c)
        at += size
        for n in range(min_n, max_n + 1) if parts else ():
            most = _most([p[n] for p in parts.values()])
            if most:
                rows.append((n, *_lined(most)) if as_lines else (n, list(most), list(most.values())))
        begin.append(len(rows))
    order, *rest = zip(*rows) if rows else ((), (), ()) + ((),) * as_lines
    kinds = [pa.int64(), pa.int64(), pa.string()] if as_lines else [pa.list_(pa.string()), pa.list_(pa.int64())]
    lists = pa.StructArray.from_arrays([pa.array(order, pa.int32()), *(pa.array(c, k) for c, k in zip(rest, kinds))],
                                       ["n", "n_grams", "total", "lines"] if as_lines else ["n", "gram", "cnt"])
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), lists)


def _lined(most: Counter) -> tuple[int, int, str]:
    return len(most), most.total(), "\n".join([f"{g}\t{most[g]}" for g in sorted(most)])


#: Rows whose grams are held at once by a task.
LISTED_ROWS = 256


def _lists(df: DataFrame, keys: list[str], part: Column, max_n: int, min_n: int, empty_token: bool, as_lines: bool = True) -> DataFrame:
    """keys + the columns of ``LINES`` or ``LISTS``: the texts of a key are put into one row, so that no gram passes an
    aggregation."""
    ensure_importable(df.sparkSession)

    @F.arrow_udf(LINES if as_lines else LISTS)
    def listed(texts: pa.Array) -> pa.Array:
        part = lambda lo: _listed(texts.slice(lo, LISTED_ROWS), max_n, min_n, empty_token, as_lines)
        return pa.concat_arrays([part(lo) for lo in range(0, max(len(texts), 1), LISTED_ROWS)])

    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(part.alias("part"), "txt")).alias("x"))
    return rows.select(*keys, F.inline(listed("x")))


def gram_lists(df: DataFrame, keys: list[str], max_n: int, min_n: int = 1, empty_token: bool = True) -> DataFrame:
    """E5 as lists: keys + (n, n_grams, total, lines), the sorted grams of a key with their counts, a line each; no row
    for an order without grams."""
    return _lists(df, keys, F.lit(0), max_n, min_n, empty_token)


def ref_max_lists(df: DataFrame, max_n: int, min_n: int = 1, empty_token: bool = True) -> DataFrame:
    """E6 as lists: (inst_id, n, n_grams, total, lines), the sorted grams of an instance with their largest count in a
    reference, a line each."""
    return _lists(df, ["inst_id"], F.col("ref_no"), max_n, min_n, empty_token)


def gram_counts(df: DataFrame, keys: list[str], max_n: int, min_n: int = 1,
                empty_token: bool = True) -> DataFrame:
    """E5: count of every n-gram per key over a tokenised table -> keys + (n, gram, cnt)."""
    return (_lists(df, keys, F.lit(0), max_n, min_n, empty_token, as_lines=False)
            .select(*keys, "n", F.inline(F.arrays_zip("gram", "cnt"))))


#: Distinct grams that a task holds before it sends them; grams are dealt to 4096 parts by the first digits of their md5.
HELD_GRAMS, PARTS = 1 << 20, 4096
_BETWEEN = b"\xff"  # no byte of UTF-8


def _part_of(gram: bytes) -> int:
    return int.from_bytes(md5(gram).digest()[:2]) >> 4


def _sent(parts: dict[int, list[tuple]]) -> pa.RecordBatch:
    """(part, n_grams, size, grams): the rows (gram, order, numbers...) of each part, packed: orders, numbers and the
    grams in order, compressed."""
    packed, sizes = [], []
    for rows in parts.values():
        rows.sort()
        grams, orders, *numbers = zip(*rows)
        data = b"".join([bytes(orders), *(np.array(x, np.int64).tobytes() for x in numbers), _BETWEEN.join(grams)])
        packed.append(pa.compress(data, codec="zstd", asbytes=True))
        sizes.append((len(rows), len(data)))
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), *(pa.array(x, pa.int64()) for x in (zip(*sizes) if sizes else ((), ()))),
                                       pa.array(packed, pa.binary())], ["part", "n_grams", "size", "grams"])


def _read(n: int, size: int, packed: bytes, numbers: int = 1):
    """What ``_sent`` packed: rows (gram, order, numbers...)."""
    data = pa.decompress(packed, size, codec="zstd", asbytes=True)
    columns = [np.frombuffer(data, np.int64, n, n + 8 * n * i).tolist() for i in range(numbers)]
    return zip(data[n + 8 * n * numbers:].split(_BETWEEN), data[:n], *columns)


_SENT = "part int, n_grams long, size long, grams binary"


def _dealt(parts: DataFrame) -> DataFrame:
    """Parts are narrow and the work on them isn't: as many tasks as the session has, whatever the bytes."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "part").sortWithinPartitions("part")


def _by_part(batches):
    """(part, its rows of ``_sent``) of rows in order of their part."""
    now, held = None, []
    for b in batches:
        for part, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(row)
    if held:
        yield now, held


def doc_freq_lists(df: DataFrame, max_n: int, min_n: int = 1, empty_token: bool = True) -> DataFrame:
    """E8 as lists: (n, part, n_grams, total, lines), the sorted grams of a part (the first three digits of a gram's md5)
    with the number of instances that hold them, a line each.

    A task counts the instances that hold a gram, for about ``HELD_GRAMS`` grams at a time, and sends the counts
    to their part as packed rows; only there are they summed and sorted, so a gram passes one exchange."""
    ensure_importable(df.sparkSession)

    def sent(batches):
        counts = {n: Counter() for n in range(min_n, max_n + 1)}
        for b in batches:
            texts = b.column(0)
            for i in range(len(texts)):
                mine: dict[int, set] = {n: set() for n in counts}
                for txt in texts[i].as_py():
                    for n, grams in _grams(txt, max_n, min_n, empty_token):
                        mine[n].update(grams)
                for n, grams in mine.items():
                    counts[n].update(grams)
                if sum(map(len, counts.values())) >= HELD_GRAMS:
                    yield _sent(dealt(counts))
                    counts = {n: Counter() for n in counts}
        yield _sent(dealt(counts))

    def dealt(counts):
        parts = defaultdict(list)
        for n, c in counts.items():
            for gram, k in c.items():
                gram = gram.encode()
                parts[_part_of(gram)].append((gram, n, k))
        return parts

    rows = df.groupBy("inst_id").agg(F.collect_list("txt").alias("x")).select("x")
    return _dealt(rows.mapInArrow(sent, _SENT)).mapInArrow(_summed, "n int, part string, n_grams long, total long, lines string")


def _lines(grams: list[bytes], numbers) -> str:
    return b"\n".join([b"%b\t%d" % x for x in zip(grams, numbers)]).decode()


def _summed(batches):
    """Rows of ``_sent`` in order of their part -> the sorted grams of each part and order with their sums."""
    for part, rows in _by_part(batches):
        sums = defaultdict(lambda: defaultdict(int))
        for row in rows:
            for gram, n, k in _read(*row):
                sums[n][gram] += k
        for n, c in sorted(sums.items()):
            grams = sorted(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([f"{part:03x}"]), pa.array([len(c)], pa.int64()), pa.array([sum(c.values())], pa.int64()),
                 pa.array([_lines(grams, map(c.get, grams))])], ["n", "part", "n_grams", "total", "lines"])


#: Orders whose grams are sent to the part of their prefix; longer ones go together, by their first words, to 2 ** WINDOW_BITS parts.
LEAD, WINDOW_BITS = 2, 10


def info_lists(df: DataFrame, max_n: int, empty_token: bool = True) -> DataFrame:
    """E9 as lists: (n, part, n_grams, info, totals, wholes), the sorted grams of a part (as ``doc_freq_lists``) with their
    totals, and with those of their prefixes (see ``ngram_info``), a line each, and the sum of their information.

    A word or pair of words goes to the part of its prefix, where its total meets that of the prefix.  Longer grams go there
    together, as the whole run of words that begins at a place (``_Windows``): a gram and its prefix begin with the same two
    words.  From there each gram goes to its own part, as packed rows both times."""
    ensure_importable(df.sparkSession)

    def listed(batches):
        for part, rows in _by_part(batches):
            columns = [pa.concat_arrays(x) for x in zip(*(_read_columns(*row) for row in rows))]
            for n in pc.unique(columns[1]).sort().to_pylist():
                grams, _, total, whole = (c.filter(pc.equal(columns[1], n)) for c in columns)
                order = pc.sort_indices(grams)
                grams, total, whole = grams.take(order), total.take(order), whole.take(order)
                info = np.log2(whole.to_numpy() / total.to_numpy()).sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), pa.array([f"{part:03x}"]), pa.array([len(grams)], pa.int64()), pa.array([info], pa.float64()),
                     _joined_lines(grams, total), _joined_lines(grams, whole)], ["n", "part", "n_grams", "info", "totals", "wholes"])

    short, long = _Short(min(max_n, LEAD), empty_token), _Windows(max_n)

    def sent(batches):
        for b in batches:
            for txt in b.column(0).to_pylist():
                if txt is not None:
                    yield from short.taken(txt)
                    yield from long.taken(txt) if max_n > LEAD else ()
        yield _sent(short.dealt())
        yield _sent(long.dealt())

    def met(batches):
        found, held = [], 0
        for part, rows in _by_part(batches):
            more = list((short if part < PARTS else long).met(rows))
            found += more
            held += sum(len(grams) for grams, *_ in more)
            if held >= HELD_GRAMS:
                yield _sent_columns(found)
                found, held = [], 0
        if held:
            yield _sent_columns(found)

    totals = _dealt(df.select("txt").mapInArrow(sent, _SENT)).mapInArrow(met, _SENT)
    return _dealt(totals).mapInArrow(listed, "n int, part string, n_grams long, info double, totals string, wholes string")


def _sent_columns(found: list[tuple]) -> pa.RecordBatch:
    """As ``_sent``, from lists of grams with arrays of their orders and numbers."""
    grams = [g for x in found for g in x[0]]
    columns = [np.concatenate(x) for x in list(zip(*found))[1:]]
    part = np.frombuffer(b"".join([md5(g).digest()[:2] for g in grams]), ">u2") >> 4
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    grams = np.fromiter(grams, object, len(grams))[order].tolist()
    begin = np.flatnonzero(V.changes([part])).tolist()
    packed, sizes = [], []
    for lo, hi in zip(begin, [*begin[1:], len(part)]):
        data = b"".join([columns[0][lo:hi].astype(np.uint8).tobytes(), *(c[lo:hi].tobytes() for c in columns[1:]), _BETWEEN.join(grams[lo:hi])])
        packed.append(pa.compress(data, codec="zstd", asbytes=True))
        sizes.append((hi - lo, len(data)))
    return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), *(pa.array(x, pa.int64()) for x in zip(*sizes)),
                                       pa.array(packed, pa.binary())], ["part", "n_grams", "size", "grams"])


def _read_columns(n: int, size: int, packed: bytes) -> tuple:
    """What ``_sent`` packed with two numbers, as arrays: grams, orders and the numbers."""
    data = pa.decompress(packed, size, codec="zstd", asbytes=True)
    numbers = np.frombuffer(data, np.int64, 2 * n, n).reshape(2, n)
    text = np.frombuffer(data, np.uint8, offset=17 * n)
    between = text == _BETWEEN[0]
    ends = np.append(np.flatnonzero(between), len(text)) - np.arange(n)
    grams = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(text[~between]))
    return grams, pa.array(np.frombuffer(data, np.uint8, n).astype(np.int32)), *map(pa.array, numbers)


def _joined_lines(grams: pa.Array, numbers: pa.Array) -> pa.Array:
    """One text with a line "gram TAB number" each."""
    lines = pc.binary_join_element_wise(grams, numbers.cast(pa.string()), "\t")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")


class _Windows:
    """Grams of more than ``LEAD`` words: the distinct runs of ``max_n`` words (shorter at a text's end) that begin with two words go
    to a part by these, with their numbers; there they are sorted once, and a gram's total is the number of the runs that
    begin with it."""

    def __init__(self, max_n: int):
        self.max_n, self.words, self.sizes = max_n, [], []

    def taken(self, txt: str):
        words = [w for w in txt.split(" ") if w]
        self.words += words
        self.sizes.append(len(words))
        if len(self.words) >= HELD_GRAMS:
            yield _sent(self.dealt())

    def dealt(self) -> dict[int, list[tuple]]:
        words, sizes, self.words, self.sizes = self.words, self.sizes, [], []
        parts = defaultdict(list)
        names = sorted(set(words))
        number = dict(zip(names, range(1, len(names) + 1)))
        code = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        end = np.repeat(np.cumsum(sizes), sizes).astype(np.int64)
        at = np.flatnonzero(np.arange(len(code)) + LEAD <= end)
        columns = [np.where(at + j < end[at], code[np.minimum(at + j, len(code) - 1)], 0) for j in range(self.max_n)]
        order, new = _sorted_runs(columns)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order))).tolist()
        columns = [c[order[first]] for c in columns]
        hashed = np.array([0] + [crc32(w.encode()) for w in names], np.uint64)
        part = (hashed[columns[0]] * np.uint64(0x9E3779B97F4A7C15) + hashed[columns[1]]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - WINDOW_BITS)
        long, named = np.count_nonzero(columns, axis=0).tolist(), ["", *names]
        for k, n, m, run in zip(part.tolist(), long, count, zip(*(map(named.__getitem__, c.tolist()) for c in columns))):
            parts[PARTS + k].append((" ".join(run[:n]).encode(), n, m))
        return parts

    def met(self, rows):
        """(grams, orders, totals, prefixes' totals) of a part's grams."""
        runs, _, count = zip(*(x for row in rows for x in _read(*row)))
        words = [r.split(b" ") for r in runs]
        long = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for x in words for w in x]
        number = {w: i for i, w in enumerate(sorted(set(flat)), 1)}
        inside = np.arange(self.max_n) < long[:, None]
        codes, ends = np.zeros((2, *inside.shape), np.int64)
        codes[inside], ends[inside] = (np.fromiter(map(f, flat), np.int64, len(flat)) for f in (number.__getitem__, len))
        ends = np.cumsum(ends, axis=1) + np.arange(self.max_n)
        columns = list(codes.T)
        order, _ = _sorted_runs(columns)
        count, new, before = np.array(count, np.int64)[order], np.zeros(len(order), bool), None
        new[:1] = True
        for n, c in enumerate(columns, 1):
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(count, first)
            if n > LEAD:
                some = np.flatnonzero(c[first])
                at = order[first[some]]
                yield [runs[i][:e] for i, e in zip(at.tolist(), ends[at, n - 1].tolist())], np.full(len(at), n), total[some], before[first[some]]
            before = np.repeat(total, np.diff(np.append(first, len(order))))


def _sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts rows of numbers, and which rows differ from the one before in it."""
    words = V.side_by_side(columns, int(max(c.max(initial=0) for c in columns)).bit_length())
    order = np.lexsort(words[::-1])
    return order, V.changes([w[order] for w in words])


class _Short:
    """Grams of up to ``LEAD`` words: a gram meets its prefix in the prefix's part.  A task sums grams
    before it sends them, so a frequent prefix's part gets the words that may follow it a task, however often they do."""

    parent = 128  # added to the order of a gram that is sent as a prefix; that of the words' number, which all parts get

    def __init__(self, max_n: int, empty_token: bool):
        self.max_n, self.empty_token = max_n, empty_token
        self.counts = {n: Counter() for n in range(1, max_n + 1)}

    def taken(self, txt: str):
        for n, grams in _grams(txt, self.max_n, 1, self.empty_token):
            self.counts[n].update(grams)
        if sum(map(len, self.counts.values())) >= HELD_GRAMS:
            yield _sent(self.dealt())

    def dealt(self) -> dict[int, list[tuple]]:
        counts, self.counts = self.counts, {n: Counter() for n in self.counts}
        words = counts[1].total()
        parts, former = defaultdict(list, {i: [(b"", self.parent, words)] for i in range(PARTS) if words}), {}
        for n, c in counts.items():
            part_of = {}
            for name, k in c.items():
                gram = name.encode()
                if n < self.max_n or n == 1:
                    part_of[name] = mine = _part_of(gram)
                    parts[mine].append((gram, n + self.parent, k))
                parts[mine if n == 1 else former[name.rpartition(" ")[0]]].append((gram, n, k))
            former = part_of
        return parts

    def met(self, rows):
        """As ``_Windows.met``."""
        totals, grams, words = defaultdict(int), defaultdict(int), 0
        for row in rows:
            for gram, n, k in _read(*row):
                if n == self.parent:
                    words += k
                elif n > self.parent:
                    totals[gram] += k
                else:
                    grams[n, gram] += k
        if grams:
            orders, names = zip(*grams)
            whole = [words if n == 1 else totals[gram.rpartition(b" ")[0]] for n, gram in grams]
            yield list(names), np.array(orders), np.fromiter(grams.values(), np.int64, len(grams)), np.array(whole, np.int64)


def ref_max_counts(ref_counts: DataFrame) -> DataFrame:
    """Per instance the maximum count of each n-gram over its references."""
    return ref_counts.groupBy("inst_id", "gram").agg(F.max("cnt").alias("rmax"), F.first("n").alias("n"))


def doc_freq(ref_counts: DataFrame) -> DataFrame:
    """In how many instances each n-gram occurs in any reference -> (n, gram, df)."""
    return (ref_counts.select("inst_id", "n", "gram").distinct()
            .groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df")))


#: Grams of greatest totals whose counts go to every task, as 64-bit ids: 1.5 MB at most.
HOT_GRAMS = 1 << 16


def ngram_info(ref_counts: DataFrame) -> DataFrame:
    """NIST information of every reference n-gram: (n, gram, tot, whole, info).

    info(w1..wn) = log2(count(w1..wn-1) / count(w1..wn)) over all reference n-grams; the prefix of a
    unigram is the total number of reference words (``whole`` is the count of the prefix).

    A frequent gram is the prefix of very many: the ``HOT_GRAMS`` most frequent are looked up from a broadcast
    table of fixed size, and only other prefixes meet the totals in a join, each with less than a
    1 / ``HOT_GRAMS`` share of all occurrences.  Rows that are done keep a key of their own there (it
    begins with a blank, so it finds nothing)."""
    spark = ref_counts.sparkSession
    path = scratch_path(spark, "gram-totals")
    ref_counts.groupBy("n", "gram").agg(F.sum("cnt").alias("tot")).write.parquet(path)
    totals = spark.read.parquet(path)
    words = F.broadcast(totals.where("n = 1").agg(F.sum("tot").alias("words")))
    hot = F.broadcast(totals.orderBy(F.desc("tot"), "n", "gram").limit(HOT_GRAMS).select(
        (F.col("n") + 1).alias("n"), F.xxhash64("gram").alias("hot"), F.col("tot").alias("hot_tot")))
    prefix = F.when(F.col("n") > 1, F.regexp_replace("gram", " [^ ]*$", ""))
    rows = totals.withColumn("prefix", prefix).withColumn("hot", F.xxhash64("prefix")).join(hot, ["n", "hot"], "left")
    done = (F.col("n") == 1) | F.col("hot_tot").isNotNull()
    rows = rows.withColumn("key", F.when(done, F.concat(F.lit(" "), "gram")).otherwise(F.col("prefix")))
    further = totals.select((F.col("n") + 1).alias("n"), F.col("gram").alias("key"), F.col("tot").alias("rare_tot"))
    whole = F.when(F.col("n") == 1, F.col("words")).otherwise(F.coalesce("hot_tot", "rare_tot"))
    return (rows.join(further, ["n", "key"], "left").crossJoin(words)
            .select("n", "gram", "tot", whole.alias("whole"), F.log2(whole / F.col("tot")).alias("info")))

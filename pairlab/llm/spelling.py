"""Spelling variant grouping by dense prefix-suffix tiling.

Words are counted in one pass over the texts.  Two words are near if one inserted, deleted or
replaced code point turns one into the other; then the length of their common prefix plus that of
their common suffix reaches the longer length minus one.  That is measured densely: code points are
laid out in padded matrices, aligned left for the prefix and right for the suffix, and every word of
one block is compared with every word of another, column by column.

Which blocks meet: with m the shorter length, two near words share their first m // 2 code points or
their last m - m // 2.  So a word of length L stands in four families: for m = L and m = L - 1, those
of its first m // 2 and of its last m - m // 2 code points.  Families are laid side by side in tiles of
at least ``TILE`` words; one of over ``BLOCK`` words is cut by the words' hash into blocks, and every pair of
blocks is a tile of its own, wherever Spark deals it.  A tile returns at most one row a word (its number of near
words, and the most frequent one), never pairs; a pair counts in the one family that both its words
share first, so sums over tiles are exact.  A word that stands in a family alone meets none.

Edge cases: a null text has no words, a null id is the empty text in the damage hash; repeated
rows count each time; ties of frequency go to the smaller word in code-point order; words of
equal frequency are never each other's form; an empty table gives an empty one; other columns are
dropped; very long texts are read in pieces cut between words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import CRC_SQL, crc32_sql
from pairlab.session import scratch_path

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: One word in so many of a document (by hash) loses a code point.
DAMAGE = 199
#: Words that a tile of small families has at least, words of a block of a larger family, words of a strip of
#: a tile, and distinct words that a task counts before it hands them on.
TILE, BLOCK, STRIP, HELD = 256, 4096, 128, 300_000
#: Comparisons of a task, about: tiles are few bytes and much work, so tasks are counted by the work.
COMPARED = 50_000_000
#: Code points that are searched at once.
PIECE = 1 << 20
_LETTERS = "A-Za-zÀ-ÿ"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``LEAST_CHARS`` code points, after the
    damage: where ``damage`` divides h, the crc32 of ``id:run``, the code point h % length is lost."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string").cast("binary"))
    runs, stop = re.compile(f"[{_LETTERS}]{{{LEAST_CHARS},}}"), re.compile(f"[^{_LETTERS}]|$")

    def pieces(text: str):
        lo = 0
        while lo < len(text):
            hi = len(text) if len(text) - lo <= PIECE else stop.search(text, lo + PIECE).start()
            yield text[lo:hi] if (lo, hi) != (0, len(text)) else text
            lo = hi

    def run(batches):
        seen = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or b"").lower().decode()  # bytes.lower changes A-Z alone
                start = zlib.crc32(f"{batch.column(0)[i].as_py()}:".encode())
                for piece in pieces(text):
                    found = Counter(runs.findall(piece))
                    for word in [w for w in found if zlib.crc32(w.encode(), start) % damage == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        n, left = found.pop(word), word[:at] + word[at + 1:]
                        if len(left) >= LEAST_CHARS:
                            seen[left] += n
                    seen.update(found)
                    if len(seen) > HELD:
                        yield rows()
                        seen.clear()
        if seen:
            yield rows()

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and right, padded with 0, a column for every position; and lengths."""
    size = np.array([len(w) for w in words], np.int64)
    width = int(size.max(initial=1))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row, begin = np.repeat(np.arange(len(words)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
    col = np.arange(len(flat)) - begin[row] if len(words) else row
    left = np.zeros((width, len(words)), np.uint8 if flat.max(initial=0) < 256 else np.uint32)
    right = left.copy()
    left[col, row] = flat
    right[size[row] - 1 - col, row] = flat
    return left, right, size


def common_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every pair of columns of a and b: how many equal rows they begin with."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    out = np.zeros(alive.shape, np.uint8 if len(a) < 256 else np.int32)
    for x, y in zip(a, b):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        out += alive
    return out


def near(words_a: list[str], words_b: list[str]):
    """Strips (first row of a, near matrix, common prefix, shorter length): whether two words differ
    by exactly one edit."""
    (left_a, right_a, size_a), (left_b, right_b, size_b) = matrices(words_a), matrices(words_b)
    wide = max(len(left_a), len(left_b))
    fit = lambda m, w: np.pad(m, ((0, w - len(m)), (0, 0)))
    left_a, right_a, left_b, right_b = (fit(m, wide) for m in (left_a, right_a, left_b, right_b))
    for lo in range(0, len(words_a), STRIP):
        rows = slice(lo, lo + STRIP)
        prefix = common_length(left_a[:, rows], left_b)
        both = prefix.astype(np.int16 if wide < 1 << 14 else np.int64) + common_length(right_a[:, rows], right_b)
        longer = np.maximum(size_a[rows, None], size_b[None, :])
        shorter = np.minimum(size_a[rows, None], size_b[None, :])
        same = (size_a[rows, None] == size_b[None, :]) & (prefix >= longer)
        yield lo, (both >= longer - 1) & (longer - shorter <= 1) & ~same, prefix, shorter


def tile(a: tuple, b: tuple) -> list[dict]:
    """Near words of block a in block b; a block is (words, their numbers, families, m, whether the
    family is one of prefixes).  Block b is sorted by falling number, then word."""
    words_a, _, family_a, m_a, first_a = a
    words_b, n_b, family_b, _, _ = b
    out = []
    for lo, hit, prefix, shorter in near(words_a, words_b):
        rows = slice(lo, lo + STRIP)
        m = m_a[rows, None]
        # the family is that of the pair (m its shorter length), and the first one that both share
        hit &= (family_a[rows, None] == family_b[None, :]) & (shorter == m) & (first_a[rows, None] | (prefix < m // 2))
        for i in np.flatnonzero(hit.any(axis=1)):
            best = int(hit[i].argmax())
            out.append({"word": words_a[lo + i], "n_near": int(hit[i].sum()), "best_n": int(n_b[best]), "best": words_b[best]})
    return out


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def families(words: DataFrame) -> DataFrame:
    """(word, n, m, first, part): the four families of every word."""
    size = F.length("word")
    wide = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= LEAST_CHARS)
    k = F.floor(F.col("m") / 2).cast("int")
    back = F.col("m") - k
    kinds = F.array(F.struct(F.lit(True).alias("first"), F.substring(F.col("word"), F.lit(1), k).alias("part")),
                    F.struct(F.lit(False).alias("first"), F.substring(F.col("word"), F.col("size") - back + 1, back).alias("part")))
    return wide.select("word", "n", "m", F.explode(kinds).alias("x")).select("word", "n", "m", "x.first", "x.part")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has near words: how many, and the
    most frequent of them (ties: the smallest)."""
    spark, path = words.sparkSession, scratch_path(words.sparkSession, "families")
    rows = families(words)
    key = ["m", "first", "part"]
    rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1").write.parquet(path)
    sizes = spark.read.parquet(path)
    work = sizes.agg(F.sum(F.col("members") * F.greatest(F.col("members"), F.lit(TILE)))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / COMPARED))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    held = rows.join(sizes, key).withColumn("blocks", blocks).withColumn("mine", mine)
    # a word of a family of several blocks goes to every pair of blocks that holds its own
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda j: F.struct(F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j")))
    dealt = held.withColumn("pair", F.explode(pair)).select(*key, "pair.i", "pair.j", "mine", "blocks", "word", "n")
    order = [*key, "i", "j"]
    dealt = dealt.repartition(tasks, *order).sortWithinPartitions(*order).select("m", "first", "part", "i", "j", "mine", "word", "n")

    def block(rows):
        """Sorted by falling number, then word."""
        rows = sorted(rows, key=lambda r: (-r[3], r[2]))
        return ([r[2] for r in rows], np.array([r[3] for r in rows]), np.array([r[0] for r in rows]),
                np.array([r[4] for r in rows]), np.array([r[5] for r in rows], bool))

    def run(batches):
        now, family, side, a, b = None, -1, None, [], []  # a: the tile's first block, or whole small families; b: its second block

        def done():
            if side is not None:
                x, y = block(a), block(b)
                out = tile(x, y) + tile(y, x)
            else:
                x = block(a)
                out = tile(x, x)
            return pa.RecordBatch.from_pylist(out, NEAR)

        for batch in batches:
            for m, first, part, i, j, mine, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (m, first, part, i, j) != now:
                    # the next family: the tile is done once it is large, or where either is a pair of blocks
                    if now is not None and (len(a) + len(b) >= TILE or side is not None or i != j):
                        yield done()
                        a, b = [], []
                    now, family, side = (m, first, part, i, j), family + 1, (i, j) if i != j else None
                (b if side is not None and mine == j else a).append((family, None, word, n, m, first))
        if now is not None:
            yield done()

    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top)
            .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one, by doubling the steps.  A form is
    ``RATIO`` times as frequent as its word, so a chain is short and has no circle."""
    spark, path = forms.sparkSession, scratch_path(forms.sparkSession, "roots")
    forms.select("word", F.col("form").alias("root")).write.parquet(f"{path}/0")
    step = 0
    while True:
        now = spark.read.parquet(f"{path}/{step}")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        (now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
         .write.parquet(f"{path}/{step + 1}"))
        step += 1
        if spark.read.parquet(f"{path}/{step}").where("moved").isEmpty():
            return spark.read.parquet(f"{path}/{step}").select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of at least ``LEAST_CHARS`` code points that
    stands ``LEAST_COUNT`` times, its most frequent near word if ``RATIO`` times as frequent, and the end of
    its chain of forms."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "spelling")
    counted(docs, id_col, text_col).where(F.col("n") >= LEAST_COUNT).write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    (words.join(near_words(words), "word", "left")
     .select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
             F.when(is_form, F.col("best_n")).alias("form_n")).write.parquet(f"{path}/forms"))
    forms = spark.read.parquet(f"{path}/forms")
    ends = roots(forms.where("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for the query: near words meet at what one deletion leaves."""
    return f"""WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_LETTERS}]+')) AS run FROM documents),
counts AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM counts, crc),
damaged AS (SELECT c, CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(0, length(word))) AS INT) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, (list(other ORDER BY other_n DESC, other))[1] AS best FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near,
  CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
walk AS (SELECT word, coalesce(form, word) AS at FROM forms UNION SELECT walk.word, forms.form FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""

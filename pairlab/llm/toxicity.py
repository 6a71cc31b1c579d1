"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The classifier is fitted on at most ``max_rows`` labelled training rows, chosen by a hash of
their ids; a second hash deals them to three parts.  On the first a lexicon is learned: whole
words and word beginnings (``STEMS`` characters) that far more toxic than other texts hold, the
``LEXICON`` best of them, beside the fixed list ``INSULTS``.  On the second the trees are
fitted, on the third the calibration.  The features are densities of both lexicons (plain and
with disguised spellings undone), nearness of lexicon words to second-person words, and rates of
capitals, punctuation, digits, symbols, drawn-out letters and disguised words.

Scoring reads every whole text; the model that goes to the tasks has a fixed size.  The score is
the calibrated probability, with a thousandth of the trees' probability to order its ties.

Edge cases: a null text is an empty one and gets a score; null ids are scored but never
learned from; labels with a null id or value are none, and of several labels of one id the
greatest counts; repeated rows are scored each; when the labels hold fewer than ``min_rows`` rows
of either class every score is the share of toxic labels (0 without labels); an empty table
gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.common import slices, texts_of
from pairlab.session import shared_dir

#: Labelled rows that the classifier may learn from.
MAX_ROWS = 20_000
LEXICON = 256
STEMS = (4, 5, 6, 7)
MIN_LOG_ODDS = 1.6
INSULTS = frozenset("""
    idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage filth pathetic worthless disgusting
    useless clown clowns fool fools freak freaks creep bastard bitch asshole ass shit fuck fucking crap jerk pig pigs
    vermin retard retarded ugly hate kill die cretin imbecile nazi whore slut
    idiota imbecil basura asqueroso puta mierda estupido tonto
    idiote connard salope merde ordure debile pute abruti
    arschloch dumm dummkopf trottel abschaum scheisse hure wichser
    """.split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre ti tus usted".split())
NEAR = 5
_WORD = re.compile(r"\w+")
# begins where a run of letters begins, so a long run is tried once
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$!*#.\-]+[^\W\d_]+)+")
_SHOUTED = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{2,}(?!\w)")
_UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
                       "*": None, "#": None, ".": None, "-": None})


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTER = _bytes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
_DISGUISE = _bytes("0123456789@$!*#.-")
_COUNTED = [_bytes(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?.,;:", "#$%&*|<>@", "0123456789", "!")]
FEATURES = ("log_words", "listed", "listed_log", "learned", "learned_log", "learned_weight", "learned_kinds",
            "you", "near_you", "capitals", "shouted", "exclaimed", "punctuation", "symbols", "digits", "drawn",
            "disguised", "disguised_listed", "log_chars")


class Matcher:
    """Which lexicon entry each word meets (its own, or that of its longest known beginning)."""

    LIMIT = 500_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def __call__(self, word: str) -> str | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) > self.LIMIT:
            self.known.clear()
        keys = (word, *(word[:k] + "-" for k in reversed(STEMS) if len(word) >= k))
        got = self.known[word] = next((k for k in keys if k in self.lexicon), None)
        return got


def features(text: str, match: Matcher) -> list[float]:
    low = text.lower()
    ws = _WORD.findall(low)
    data = np.frombuffer(text.encode(), np.uint8)
    n, chars, seen = max(1, len(ws)), max(1, len(text)), set(ws)
    counts = np.bincount(data, minlength=256)
    capitals, punctuation, symbols, digits, exclaimed = (int(counts[x].sum()) for x in _COUNTED)
    letter = _LETTER[data]
    drawn = int(np.count_nonzero((data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & letter[:-2]))
    if counts[0xC3]:  # accented capitals of Latin-1
        capitals += int(np.count_nonzero((data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] != 0x97)))
    entries = {w: k for w in seen if (k := match(w))} if match.lexicon else {}
    listed = [i for i, w in enumerate(ws) if w in INSULTS] if not INSULTS.isdisjoint(seen) else []
    hits = [i for i, w in enumerate(ws) if w in entries] if entries else []
    you = [i for i, w in enumerate(ws) if w in YOU] if (listed or hits) and not YOU.isdisjoint(seen) else []
    n_you = len(you) if you else sum(map(ws.count, YOU & seen))
    near = sum(any(abs(i - j) <= NEAR for j in _around(you, i)) for i in {*listed, *hits})
    disguised = _DISGUISED.findall(low) if np.any(_DISGUISE[data[:-1]] & letter[1:]) else []
    undone = [d.translate(_UNDO) for d in disguised]
    letters = max(1, int(np.count_nonzero(letter)))
    return [math.log1p(len(ws)), len(listed) / n, math.log1p(len(listed)), len(hits) / n, math.log1p(len(hits)),
            sum(match.lexicon[entries[ws[i]]] for i in hits) / n, float(len(set(entries.values()))), n_you / n, near / n,
            capitals / letters, len(_SHOUTED.findall(text)) / n if capitals > 1 else 0.0, exclaimed / n, punctuation / n,
            symbols / n, digits / chars, drawn / n, len(disguised) / n,
            sum(d in INSULTS or match(d) is not None for d in undone) / n, math.log1p(len(text))]


def _around(places: list[int], i: int) -> list[int]:
    """The places next to i in a sorted list."""
    at = bisect_left(places, i)
    return places[max(0, at - 1):at + 1]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: object | None
    calibration: object | None
    share: float


def labelled(labels: DataFrame, training: Column | None, max_rows: int, id_col: str) -> DataFrame:
    """(id, toxic, part) of at most ``max_rows`` training rows, by a hash of the id."""
    rows = (labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
            .where("_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic")))
    if training is not None:
        rows = rows.where(training)
    key = F.md5(F.col("_id").cast("string").cast("binary"))
    part = F.pmod(F.crc32(F.concat(key, F.lit("part")).cast("binary")), F.lit(10))
    return (rows.withColumn("key", key).orderBy("key", "_id").limit(max_rows)
            .select("_id", (F.col("toxic") > 0).cast("double").alias("toxic"),
                    F.when(part < 4, 0).when(part < 8, 1).otherwise(2).alias("part")))


def learn_lexicon(texts: DataFrame, n_toxic: int, n_other: int, size: int = LEXICON) -> dict[str, float]:
    """Log odds of the ``size`` most telling words and word beginnings of (text, toxic) rows."""

    def count(batches):
        seen: dict[str, list[int]] = {}

        def out():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()),
                 pa.array([x[1] for x in seen.values()], pa.int64())], ["item", "pos", "neg"])
            seen.clear()
            return rows

        for b in batches:
            for text, toxic in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                own = set(_WORD.findall(text.lower()))
                for item in own | {w[:k] + "-" for w in own for k in STEMS if len(w) >= k}:
                    seen.setdefault(item, [0, 0])[0 if toxic else 1] += 1
                if len(seen) > 200_000:
                    yield out()
        yield out()

    odds = (F.log((F.col("pos") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_other + 1.0)))
    rows = (texts.mapInArrow(count, "item string, pos long, neg long").groupBy("item")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3").withColumn("odds", odds)
            .where(F.col("odds") >= MIN_LOG_ODDS).orderBy((F.col("pos") * F.col("odds")).desc(), "item").limit(size))
    return {r["item"]: r["odds"] for r in rows.collect()}


def with_features(rows: DataFrame, text_col: str, lexicon: dict[str, float]) -> DataFrame:
    """The rows with their text replaced by ``f``, an array of features."""
    names = [c for c in rows.columns if c != text_col]
    at, others = rows.columns.index(text_col), [rows.columns.index(c) for c in names]
    out = T.StructType([*(rows.schema[c] for c in names), T.StructField("f", T.ArrayType(T.DoubleType()))])

    def run(batches):
        match = Matcher(lexicon)
        for batch in batches:
            for b in slices(batch):
                f = [features(t, match) for t in texts_of(b.column(at))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in others), pa.array(f, pa.list_(pa.float64()))],
                                                 [*names, "f"])

    return rows.mapInArrow(run, out)


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = MAX_ROWS, min_rows: int = 3, trees: int = 20,
        depth: int = 3) -> Model:
    """A model from labels (id, toxic); ``training`` is a condition on the id column ``_id``."""
    shared_dir(docs.sparkSession)
    sample = labelled(labels, training, max_rows, id_col)
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(sample), "_id").checkpoint())
    seen = {(r["part"], r["toxic"]): r["count"] for r in texts.groupBy("part", "toxic").count().collect()}
    share = sum(n for (_, y), n in seen.items() if y) / max(1, sum(seen.values()))
    if any(sum(seen.get((part, y), 0) for part in (1, 2)) < min_rows for y in (0.0, 1.0)):
        return Model({}, None, None, share)
    lexicon = learn_lexicon(texts.where("part = 0").select("text", "toxic"), seen.get((0, 1.0), 0), seen.get((0, 0.0), 0))
    rows = with_features(texts.where("part > 0").select("toxic", "part", "text"), "text", lexicon)
    rows = rows.select("toxic", "part", array_to_vector("f").alias("features")).coalesce(4).checkpoint()
    gbt = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3,
                        maxBins=32, minInstancesPerNode=3, seed=7).fit(rows.where("part = 1"))
    held = gbt.transform(rows.where("part = 2")).select("toxic", _probability().alias("p"))
    iso = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="calibrated").fit(held)
    return Model(lexicon, gbt, iso, share)


def _probability() -> Column:
    return vector_to_array("probability")[1]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, predicted int) of every row."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    if model.trees is None:
        done = src.select(id_col, F.lit(float(model.share)).alias("score"))
    else:
        rows = with_features(src, "text", model.lexicon).select(id_col, array_to_vector("f").alias("features"))
        rows = model.trees.transform(rows).select(id_col, _probability().alias("p"))
        rows = model.calibration.transform(rows)
        done = rows.select(id_col, (F.col("calibrated") * 0.999 + F.col("p") * 0.001).alias("score"))
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

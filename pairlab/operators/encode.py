"""Encoding and batching.

The reference loads a pretrained subword vocabulary; here the vocabulary is built
from the corpus (pad 0, end 1, unknown 2, then by frequency), and numbering uses the
range-partitioned ranking of ``runs.rank_within`` so no single task orders it.  Frequent tokens are
looked up in the row from a table of bounded size; only rare ones are joined.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions import text as X
from pairlab.operators.mr import PREFIX
from pairlab.operators.runs import rank_within

PAD, END, UNK = 0, 1, 2


def tokens(col: Column, special_prefix: bool = False) -> Column:
    """Lower-cased 13a tokens; with ``special_prefix`` the task prefix is one token."""
    if not special_prefix:
        return X.lower_all(X.tokenize_mteval(col))
    rest = F.when(col.startswith(PREFIX), F.substring(col, len(PREFIX) + 1, 1 << 30)).otherwise(col)
    toks = X.lower_all(X.tokenize_mteval(rest))
    return F.when(col.startswith(PREFIX), F.concat(F.array(F.lit(PREFIX.strip())), toks)).otherwise(toks)


def build_vocab(texts: DataFrame, col: str = "text") -> DataFrame:
    """G1: (token, cnt, id) with ids from 3 by count descending, then token."""
    counts = (texts.select(F.explode(tokens(F.col(col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = rank_within(counts.withColumn("_g", F.lit(0)), "_g", [F.col("cnt").desc(), F.col("token")])
    return ranked.select("token", "cnt", (F.col("rank") + UNK).cast("int").alias("id"))


#: Tokens of the vocabulary that every task holds, the most frequent ones, and their greatest length: 16 MB at most.
HOT_TOKENS, HOT_CHARS = 1 << 16, 64


def _hot(vocab: DataFrame) -> tuple[dict[str, int], bool]:
    """The most frequent tokens with their ids, and whether that is the whole vocabulary."""
    first = vocab.where(F.col("id") <= HOT_TOKENS + UNK)
    short = first.where(F.length("token") <= HOT_CHARS).select("token", "id").toArrow()
    rest = vocab.where((F.col("id") > HOT_TOKENS + UNK) | (F.length("token") > HOT_CHARS))
    return dict(zip(short.column(0).to_pylist(), short.column(1).to_pylist())), rest.isEmpty()


def encode_fixed(df: DataFrame, vocab: DataFrame, col: str, max_len: int = 60, key: str = "inst_id",
                 prefix: bool = False, special_prefix: bool = False) -> DataFrame:
    """Ids truncated to max_len - 1, the end id appended, padded with 0 to max_len;
    the attention mask marks the real positions.  -> key, ids, mask.

    The vocabulary has two tiers: its most frequent tokens (ids count by frequency) are a table of bounded size
    that is looked up in the row, so no frequent token is ever a key; only tokens beyond it meet the
    vocabulary in a join and come back to their row (keys are unique).  A vocabulary that the table holds
    whole needs no join."""
    from pairlab.session import ensure_importable, scratch_path, shared_dir

    spark = df.sparkSession
    shared_dir(spark)
    ensure_importable(spark)
    path = scratch_path(spark, "vocab")
    vocab.select("token", "id").write.parquet(path)
    vocab = spark.read.parquet(path)
    hot, whole = _hot(vocab)
    text = F.concat(F.lit(PREFIX), F.coalesce(F.col(col).cast("string"), F.lit("None"))) if prefix else F.col(col)
    kept = F.slice(tokens(text, special_prefix), 1, max_len - 1)
    out = T.StructType([df.schema[key], *T.StructType.fromDDL("ids array<int>, rare array<struct<pos: int, token: string>>").fields])

    def look_up(batches):
        for b in batches:
            ids, rare = [], []
            for words in b.column(1).to_pylist():
                found = [hot.get(w, UNK) for w in words or ()]
                ids.append(found)
                rare.append([] if whole else [{"pos": i, "token": w} for i, (w, n) in enumerate(zip(words or (), found)) if n == UNK])
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(rare, kind)], [key, "ids", "rare"])

    rows = df.select(key, kept.alias("toks")).mapInArrow(look_up, out)
    if not whole:
        met = (rows.select(key, F.inline("rare")).join(vocab, "token").groupBy(key)
               .agg(F.map_from_entries(F.collect_list(F.struct("pos", "id"))).alias("known")))  # max_len - 1 at most
        rows = rows.join(met, key, "left").withColumn("ids", F.when(F.col("known").isNull(), F.col("ids")).otherwise(
            F.transform("ids", lambda x, i: F.coalesce(F.try_element_at("known", i), x))))
    real = F.concat("ids", F.array(F.lit(END)))
    missing = F.lit(max_len) - F.size(real)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(real)), F.array_repeat(F.lit(0), missing))
    return rows.select(key, F.concat(real, F.array_repeat(F.lit(PAD), missing)).alias("ids"), mask.alias("mask"))


def encoded_lengths(df: DataFrame, mr: str = "mr", ref: str = "ref", key: str = "inst_id") -> DataFrame:
    """Real tokens per row (+1 end token).  As in the reference, the sentence is
    measured with the task prefix too (it was passed through the MR function)."""
    def n(c):
        return F.size(tokens(F.concat(F.lit(PREFIX), c))) + 1
    return df.select(key, n(F.col(mr)).alias("mr_len"), n(F.col(ref)).alias("ref_len"))


def make_batches(df: DataFrame, size: int = 30, key: str = "inst_id", seed: str = "0",
                 shuffle: bool = True) -> DataFrame:
    """batch_id = floor(position / size); the position follows md5(seed|key) when
    shuffling, else the key.  Positions come from the range-partitioned ranking."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))) if shuffle else F.col(key)
    r = rank_within(df.withColumn("_g", F.lit(0)).withColumn("_o", order), "_g", [F.col("_o"), F.col(key)])
    return r.withColumn("batch_id", F.floor((F.col("rank") - 1) / size).cast("long")).drop("_g", "_o")


def step_counts(df: DataFrame, split: str = "split", epochs: int = 5, batch: int = 30) -> DataFrame:
    """(rows // epochs) // batch per split."""
    c = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    return c.withColumn("steps", F.floor(F.floor(F.col("rows") / epochs) / batch).cast("long"))

"""The corpus pipeline: five stages over ``documents``, each one of the operators in pairlab.llm.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and
returns a DataFrame; all but the last return the columns of documents.  ``run`` writes each
stage to the shared folder (spark.checkpoint.dir) and rereads it, so a lost executor costs the
running stage at most.

Edge cases: as the operators define them.  Documents with a null id pass near-duplicate
removal; null texts fail the quality rules; an empty table goes through as an empty one; of repeated
rows one stays; ties are settled by the smallest id; long texts are worked on whole, in chunks of
bounded size; further columns, whatever their names, are carried along until the last stage, which
returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlab.llm import bpe, minhash, mixing, quality, secretscan
from pairlab.llm.common import table
from pairlab.session import ensure_importable, scratch_path, shared_dir


def _ready(spark: SparkSession) -> None:
    shared_dir(spark)
    ensure_importable(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or look unlike the trusted ones go."""
    _ready(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id."""
    _ready(spark)
    return minhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; the documents stay."""
    _ready(spark)
    return secretscan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight gives them under the token budget."""
    _ready(spark)
    return mixing.mix(docs).select("row.*")


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lang, source, round_trip): packed token ids of every text, and
    whether they decode to its bytes."""
    _ready(spark)
    return bpe.encode(docs, keep=("lang", "source"), check="round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("bpe", bpe_round_trip),
]

#: MinHash groups, the n-gram ratio and BPE have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
    return docs

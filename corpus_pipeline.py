"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; its result is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

In every stage an empty table gives an empty one, columns beyond those of
documents are dropped, and equal rows are judged alike; see each for nulls,
empty texts and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.llm import bpe, decontaminate, quality, secret_scan, simhash
from prospectra.llm.common import materialise
from prospectra.operators.scratch import clear, left

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go; null and empty texts fail the base rule."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id.

    Near duplicates have a Jaccard similarity of 0.8 or more in their runs of
    five words (see similar).  Null and empty texts are copies of each other; of
    equal rows one stays; rows without a doc_id stay, as do unlinked rows of one id.
    """
    return simhash.keep_one_each(docs, similarity=0.8, width=5).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, benchmark).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the new text; null texts stay null."""
    made = secret_scan.redact(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with their number and digests; a null text has none."""
    return bpe.bpe_report(docs, carry=["lang", "source", "n_chars"], ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding", tokens),
]

#: The learned list, the components and the encoder are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = left()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + "-".join(name.split()))
        clear(spark, docs, since=before)  # what the stage wrote on its way, and the stage before
    return docs

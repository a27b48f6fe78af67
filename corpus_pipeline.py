"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes what its predecessor kept and returns the same columns; the
last one returns token ids.  A stage's result is written to the cluster's
shared folder and read again, so a later failure costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import byte_bpe, decontam, langid, near_dedup, secrets
from fieldmark.llm.frames import bounded_batches, settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; trees are fitted on the labelled ones among ``docs``."""
    bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return near_dedup.drop_near_copies(docs, near_dedup.Similar(width=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    bounded_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in the text."""
    bounded_batches(spark)
    return secrets.redact_secrets(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, and whether the ids decode to its text."""
    bounded_batches(spark)
    rows = byte_bpe.decode(settle(byte_bpe.encode(docs), "ids"))  # two steps, so that fewer workers run at once
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_level_bpe", byte_level_bpe),
]

#: The stages need byte trees, signatures and merges, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs

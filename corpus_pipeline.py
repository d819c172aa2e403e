"""From raw documents to a training mix: five stages, each written as Parquet before the next one reads it.

1. language ID: documents without a recognised language go;
2. near-dedup: SimHash and an exact join find candidates; of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) the document with the smallest id stays;
3. benchmark decontamination: documents that hold a ten-word window of a benchmark item go;
4. PII: identifiers in texts are replaced by their kind;
5. mixing: documents are placed on the curriculum; the result is in training order.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from hyperloom.llm import common, decontam, langid, mixing, nearcopies, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # stages on word shingles take five words and a similarity of 0.8
    return nearcopies.deduplicate(docs, k=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


STAGES = [("language ID", language), ("near-dedup", near_dedup), ("decontamination", decontamination), ("PII", privacy), ("mixing", mix)]

#: Trained and iterative stages are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared checkpoint folder and read again."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

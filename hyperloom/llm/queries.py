"""The registered queries of the training-data operators: whole tables, production parameters, and SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm, media, mixing, pii, simhash, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and components of links at 4 or fewer differing bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, tau=4).select("doc_id", "fingerprint", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on the curriculum: sizes, targets, words taken and training positions, in training order."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lossless WebP, read back."""
    return media.with_media(_table(spark, sf_dir, "documents"), media=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text, disguised forms included."""
    return pii.scan(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores learnt from weak votes and the labels that aren't held out."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in documents."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10).drop("item_ids")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document log-likelihoods under counts and under the recurrent model."""
    return lm.language_model(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that tries to break the template, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(chat.TRAP).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    )
    return chat.digests(chat.format_conversations(turns.unionByName(trap)))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every text."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths with its suffix sums."""
    counts = tokencount.with_token_count(_table(spark, sf_dir, "documents"))
    return tokencount.suffix_sums(tokencount.histogram(counts))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_webp, op4_pii, op5_toxicity, op6_decontam, op7_lm, op8_chat, op9_langid, op10_tokens, pipeline)}
ORACLES = {"op2_mixing": mixing.SQL, "op6_decontam": decontam.SQL, "op8_chat": chat.SQL}

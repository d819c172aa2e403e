"""Token counts by an exact histogram of encoded lengths.

Documents are encoded where they lie and leave as (length, 1); lengths are summed before the shuffle. With the histogram,
suffix sums answer for every context limit L: how many documents and tokens are at least L long, and how many tokens
stay if every document is cut at L. Quantiles are read off the same sums.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, column, cut, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this vocabulary cuts a text into words before merging (a fixed value of the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A vocabulary file is sent to the executors; larger ones are refused.
MOST_VOCABULARY_BYTES = 64 * 1024 * 1024
#: Lengths are dealt into ranges of this width for the two levels of suffix sums.
RANGE = 1024


def encoder(data: bytes):
    """The encoder of a file of ranks (a base64 token and its rank a line)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have 0. The driver reads the vocabulary file."""
    if os.path.getsize(vocabulary) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MOST_VOCABULARY_BYTES} bytes")
    bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = encoder(data.value)
        for b in batches:
            texts, counts = column(b, "text"), []
            for i, j in pieces(texts):
                counts += [len(own.encode_ordinary(t)) if t else 0 for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length, written to the shared checkpoint folder as what follows reads it several times."""
    return cut(counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) -> n_tokens, n_docs, docs_at_least, tokens_at_least, docs_before, tokens_before, truncated_total of each length that occurs.

    truncated_total: tokens that stay if documents are cut at n_tokens. Sums run within ranges of lengths and over the (few) ranges.
    """
    h = lengths.withColumn("r", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = h.groupBy("r").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select("r", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("d", "t")])
    total = h.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    here = Window.partitionBy("r").orderBy(F.col("n_tokens").desc())
    h = h.join(ranges, "r").withColumn("docs_at_least", F.col("d_later") + F.sum("n_docs").over(here)).withColumn("tokens_at_least", F.col("t_later") + F.sum("tokens").over(here))
    h = h.join(F.broadcast(total))  # one row
    return h.withColumn("docs_before", F.col("all_docs") - F.col("docs_at_least")).withColumn("tokens_before", F.col("all_tokens") - F.col("tokens_at_least")).select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_before", "tokens_before", (F.col("tokens_before") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total")
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, n_fit, n_cut, tokens_kept, tokens_lost for any list of limits, from the histogram alone."""
    h = histogram.select("n_tokens", "n_docs")
    out = [F.struct(F.lit(int(x)).alias("context_limit"), F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs")).otherwise(0)).alias("n_fit"), F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs")).otherwise(0)).alias("n_cut"),
                    F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")).alias("tokens_kept"), F.sum(F.greatest(F.col("n_tokens") - x, F.lit(0)) * F.col("n_docs")).alias("tokens_lost")) for x in limits]
    return h.agg(F.array(*out).alias("rows")).select(F.inline("rows"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of documents does not exceed."""
    reach = F.col("docs_before") + F.col("n_docs")
    whole = F.col("docs_before") + F.col("docs_at_least")
    out = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(reach >= F.ceil(whole * F.lit(q)), F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return histogram.agg(F.array(*out).alias("rows")).select(F.inline("rows"))

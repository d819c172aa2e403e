"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch; with texts of 100 KB a batch still fits a small Python worker.
BATCH_ROWS = 2048
BATCH_BYTES = 16 * 1024 * 1024


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small enough for workers with a few hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make a local one only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="hyperloom-checkpoints-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove the shuffle files of plans that nobody refers to any more, as after a cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(texts: list, most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold at most so many characters each (one text at least)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most_chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column of an Arrow batch as Python values."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()

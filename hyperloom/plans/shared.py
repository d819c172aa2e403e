"""Plan helpers: lineage cuts in the shared folder, global ordinals without a global sort task, reproducible draws."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the session's spark.checkpoint.dir; a local folder is made only where none is set and the master is local."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="hyperloom-checkpoints-")
        context.setCheckpointDir(shared)
    return df.checkpoint()


def with_ordinal(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with its place (from 0) in the given order.

    Rows are sorted by ranges; a row's place is the size of the ranges before its own plus its place there. The sorted rows are written once, as both steps read
    them; only one count per range meets in one task.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    keyed = cut(keyed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return keyed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running_sums(df: DataFrame, by: str, index: str, columns: list[str], block: int = 1 << 16) -> DataFrame:
    """df with each column replaced by its sum up to ``index`` (dense, from 0) within ``by``.

    Sums run inside blocks of the index, so a task sees a block, and over the totals of blocks, of which a group has one row for each ``block`` rows.
    """
    cut_ = df.withColumn("_block", F.floor(F.col(index) / block))
    totals = cut_.groupBy(by, "_block").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(by, "_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns])
    inside = Window.partitionBy(by, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut_.select(*[F.sum(c).over(inside).alias(c) if c in columns else c for c in cut_.columns]).join(before, [by, "_block"])
    return sums.select(*[(F.col(c) + F.col(f"_before_{c}")).alias(c) if c in columns else c for c in df.columns])


def draw(*key: Column | str) -> Column:
    """A reproducible number from a key: the first 32 bits of the MD5 of its parts joined by ``|``."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")

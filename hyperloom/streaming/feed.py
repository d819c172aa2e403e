"""Incremental atom feed: new atoms arrive as a stream, membership counts and clique weights are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hypergraph import Hypergraph


def clique_deltas(atoms: DataFrame) -> DataFrame:
    """Clique weights that a batch of atoms adds."""
    return Hypergraph(atoms, atoms.select("predicate").distinct().withColumn("arg_types", F.array().cast("array<string>"))).clique_graph()


def follow(spark: SparkSession, folder: str, schema, out: str, checkpoint: str):
    """Append the clique weights of every micro-batch of atoms(edge_id, predicate, args) under ``out`` by batch; summing them gives the graph, and a batch that
    is redone overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        clique_deltas(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The graph so far."""
    return spark.read.parquet(out).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))

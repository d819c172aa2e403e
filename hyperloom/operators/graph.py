"""Graph operators: components, breadth-first levels, diameter estimate, induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut
from .hypergraph import symmetric


def connected_components(graph: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 100) -> DataFrame:
    """(node, component): component is its smallest node. Labels spread and jump (a label's own label), so rounds grow with the logarithm of the diameter."""
    sym = cut(symmetric(graph).filter("u <> v").select("u", "v"))
    every = graph.select(F.col("src").alias("node")).union(graph.select("dst"))
    every = (every.union(nodes.select("node")) if nodes is not None else every).distinct()
    labels = cut(every.select("node", F.col("node").alias("component")))
    for _ in range(most_rounds):
        near = sym.join(labels, sym.v == labels.node).groupBy("u").agg(F.min("component").alias("low"))
        spread = labels.join(near, labels.node == near.u, "left").select("node", F.least("component", F.coalesce("low", "component")).alias("c"))
        jump = spread.select(F.col("node").alias("n2"), F.col("c").alias("c2"))
        new = cut(spread.join(jump, spread.c == jump.n2).select("node", F.least("c", "c2").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old")
        done = changed.isEmpty()
        labels = new
        if done:
            return labels
    raise RuntimeError("components did not settle")


def bfs_levels(graph: DataFrame, start: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """(node, level) reached from the nodes of start; a level is one join of the frontier."""
    sym = cut(symmetric(graph).select("u", "v").distinct())
    seen = cut(start.select("node", F.lit(0).cast("long").alias("level")).distinct())
    frontier = seen
    for level in range(1, most_levels):
        new = frontier.join(sym, frontier.node == sym.u).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(new.withColumn("level", F.lit(level).cast("long")))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("too many levels")


def two_sweep(graph: DataFrame) -> DataFrame:
    """One row: start (smallest node), far (smallest of the farthest from it), diameter (largest level from far): a lower bound of the diameter."""
    start = graph.agg(F.min(F.least("src", "dst")).alias("node"))
    one = bfs_levels(graph, start)
    far = one.orderBy(F.desc("level"), "node").limit(1)
    two = bfs_levels(graph, far.select("node"))
    return start.select(F.col("node").alias("start")).join(F.broadcast(far.select(F.col("node").alias("far")))).join(F.broadcast(two.agg(F.max("level").alias("diameter"))))


def diameters(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, diameter): the two-sweep estimate of each cluster's largest component, all clusters level by level together. No edge joins two clusters;
    nodes(node, cluster) of edges."""
    parts = connected_components(graph).join(nodes, "node")
    sizes = parts.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    start = sizes.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "node")).alias("m")).select("m.node")
    one = bfs_levels(graph, start).join(nodes, "node")
    far = one.groupBy("cluster").agg(F.min(F.struct((-F.col("level")).alias("level"), "node")).alias("m")).select("m.node")
    return bfs_levels(graph, far).join(nodes, "node").groupBy("cluster").agg(F.max("level").alias("diameter"))


def induced(graph: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(node)."""
    m = members.select("node").distinct()
    return graph.join(m, graph.src == m.node, "left_semi").join(m, graph.dst == m.node, "left_semi")


def dropped_nodes(graph: DataFrame, members: DataFrame) -> DataFrame:
    """Members that an induced subgraph of more than one node loses, having no edge inside."""
    inside = induced(graph, members)
    return members.select("node").distinct().join(inside.select(F.col("src").alias("node")).union(inside.select("dst")).distinct(), "node", "left_anti")

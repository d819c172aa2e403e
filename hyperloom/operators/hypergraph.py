"""Algebra of the typed relational hypergraph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hypergraph:
    """atoms(edge_id, predicate, args) and predicates(predicate, arg_types); everything else is a lazy view of them."""

    atoms: DataFrame
    predicates: DataFrame

    @cached_property
    def edges(self) -> DataFrame:
        """Atoms with more than one argument; repeated atoms stay apart."""
        return self.atoms.filter(F.size("args") > 1)

    @cached_property
    def singletons(self) -> DataFrame:
        """(node, predicate), each once."""
        return self.atoms.filter(F.size("args") == 1).select(F.col("args")[0].alias("node"), "predicate").distinct()

    @cached_property
    def incidence(self) -> DataFrame:
        """(edge_id, predicate, pos, node) of non-singleton edges, one row per slot."""
        return self.edges.select("edge_id", "predicate", F.posexplode("args").alias("pos", "node"))

    @cached_property
    def slots(self) -> DataFrame:
        return self.atoms.select("edge_id", "predicate", F.posexplode("args").alias("pos", "node"))

    @cached_property
    def nodes(self) -> DataFrame:
        """(node, node_type, first_slot (edge_id, pos)): the type of the last slot that a node was written in."""
        at = F.struct("edge_id", "pos")
        typed = self.slots.join(F.broadcast(self.predicates), "predicate")  # one row per predicate
        return typed.groupBy("node").agg(F.max_by(F.get("arg_types", F.col("pos")), at).alias("node_type"), F.min(at).alias("first_slot"))

    def node_ids(self) -> DataFrame:
        """(node, node_id): ids by first appearance, from 0."""
        from ..plans.shared import with_ordinal

        first = self.nodes.select("node", F.col("first_slot.edge_id").alias("_edge"), F.col("first_slot.pos").alias("_pos"))
        return with_ordinal(first, "node_id", "_edge", "_pos").select("node", "node_id")

    def counts(self) -> DataFrame:
        """One row: nodes, edges (distinct singletons included), predicates of non-singleton edges, node types."""
        n = self.slots.agg(F.count_distinct("node").alias("n_nodes"))
        e = self.edges.agg(F.count("*").alias("n_multi"), F.count_distinct("predicate").alias("n_predicates"))
        s = self.singletons.agg(F.count("*").alias("n_single"))
        t = self.predicates.select(F.explode("arg_types").alias("t")).agg(F.count_distinct("t").alias("n_types"))
        one = n.join(F.broadcast(e)).join(F.broadcast(s)).join(F.broadcast(t))  # a row each
        return one.select("n_nodes", (F.col("n_multi") + F.col("n_single")).alias("n_edges"), "n_predicates", "n_types")

    def orphans(self) -> DataFrame:
        """Nodes that only singleton edges have; none of them means weakly connected."""
        return self.singletons.select("node").distinct().join(self.incidence.select("node").distinct(), "node", "left_anti")

    def is_connected(self) -> bool:
        return self.orphans().isEmpty()

    def degrees(self) -> DataFrame:
        """(node, degree): memberships, each slot counted."""
        return self.incidence.groupBy("node").agg(F.count("*").alias("degree"))

    def clique_graph(self, weighted: bool = True, most_arity: int = 1000) -> DataFrame:
        """(src, dst, weight) with src <= dst: every pair of slots of an edge. Pairs are made within each edge's own arguments, so nothing but
        the summed pairs is shuffled. Arities beyond most_arity are refused: their pairs would outgrow the data."""
        pairs = F.flatten(F.transform("args", lambda a, i: F.transform(F.slice(F.col("args"), i + 2, F.lit(1 << 30)), lambda b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")))))
        pair = lambda i, j: F.struct(F.least(F.get("args", F.lit(i)), F.get("args", F.lit(j))).alias("src"), F.greatest(F.get("args", F.lit(i)), F.get("args", F.lit(j))).alias("dst"))
        # the common arities need no lambda, which would be interpreted row by row
        few = F.when(F.size("args") == 2, F.array(pair(0, 1))).when(F.size("args") == 3, F.array(pair(0, 1), pair(0, 2), pair(1, 2)))
        checked = few.when(F.size("args") <= most_arity, pairs).otherwise(F.raise_error(F.lit(f"an edge has more than {most_arity} arguments")).cast("array<struct<src:string,dst:string>>"))
        rows = self.edges.select(F.inline(checked))
        return rows.groupBy("src", "dst").agg((F.count("*") if weighted else F.lit(1).cast("long")).alias("weight"))

    def summary(self) -> DataFrame:
        """(predicate, arity, atoms): what a printout of the hypergraph lists."""
        return self.atoms.groupBy("predicate", F.size("args").alias("arity")).agg(F.count("*").alias("atoms"))

    def majority(self, clusters: DataFrame) -> DataFrame:
        """(cluster, edge_id, predicate, inside, slots_inside): edges of which more than half of the slots' number are distinct nodes of the cluster (strictly); slots_inside is
        the weight that a walk gives the edge."""
        slots = self.edges.select("edge_id", "predicate", F.size("args").alias("n"), F.explode("args").alias("node"))
        hits = slots.join(clusters, "node").groupBy("cluster", "edge_id", "predicate", "n").agg(F.count_distinct("node").alias("inside"), F.count("*").alias("slots_inside"))
        return hits.filter(F.col("inside") > F.col("n") / 2).drop("n")

    def border(self, clusters: DataFrame) -> DataFrame:
        """(cluster, node): minority members of a cluster's majority edges; they belong to its hypergraph but are no sources."""
        members = self.majority(clusters).select("cluster", "edge_id").join(self.incidence.select("edge_id", "node"), "edge_id").select("cluster", "node").distinct()
        return members.join(clusters.select("cluster", "node"), ["cluster", "node"], "left_anti")

    def leaf(self, clusters: DataFrame) -> DataFrame:
        """Atoms of each cluster's own hypergraph: majority edges, and singletons of its own nodes."""
        edges = self.majority(clusters).select("cluster", "edge_id").join(self.edges, "edge_id")
        own = self.atoms.filter(F.size("args") == 1).withColumn("node", F.col("args")[0]).join(clusters, "node").select("edge_id", "cluster", "predicate", "args")
        return edges.unionByName(own)


def symmetric(graph: DataFrame) -> DataFrame:
    """(u, v, weight) in both directions; loops once."""
    return graph.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionByName(graph.filter("src <> dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), "weight"))


def ranked(df: DataFrame, by: str, *order, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))

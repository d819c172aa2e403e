"""Random walks over the hypergraph: budgets, sampled walks with reproducible draws, hitting times, path statistics, exact walks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WalkConfig
from ..plans.shared import cut, draw
from .hypergraph import Hypergraph


def walk_length(config: WalkConfig, diameter: int | None) -> int:
    """A known diameter decides, else the configured length."""
    return diameter + 1 if diameter is not None else config.max_path_length


def most_paths(n_predicates: int, length: int, max_path_length: int) -> int:
    return 1 + n_predicates * (n_predicates**length - 1) // (n_predicates - 1) if n_predicates > 1 else 1 + max_path_length


def walks_for_times(length: int, epsilon: float) -> int:
    return round((length - 1) ** 2 / (4 * epsilon**2))


def walks_for_paths(n_paths: int, max_num_paths: int, epsilon: float) -> int:
    return round(min(max_num_paths + 1, n_paths + 1) * math.log(n_paths) / epsilon**2)


def budget(config: WalkConfig, n_predicates: int, length: int) -> dict[str, int]:
    t, p = walks_for_times(length, config.epsilon), most_paths(n_predicates, length, config.max_path_length)
    n = walks_for_paths(p, config.max_num_paths, config.epsilon)
    return {"tht": t, "p_star": p, "path": n, "phase_1": int(0.25 * max(t, n))}


def budgets(grid: DataFrame) -> DataFrame:
    """The same as a table: grid(n, len, eps, m) -> with tht, p_star, path, phase_1 (rounded half to even)."""
    n, length, eps, m = F.col("n"), F.col("len"), F.col("eps"), F.col("m")
    p = F.when(n > 1, 1 + n * (F.pow(n.cast("double"), length) - 1) / (F.greatest(n, F.lit(2)) - 1)).otherwise(1 + length)
    tht = F.bround(F.pow(length - 1.0, F.lit(2)) / (4 * eps * eps), 0)
    path = F.bround(F.least(m + 1, p + 1) * F.log(p) / (eps * eps), 0)
    return grid.select("n", "len", "eps", "m", tht.cast("long").alias("tht"), p.cast("long").alias("p_star"), path.cast("long").alias("path"), F.floor(0.25 * F.greatest(tht, path)).cast("long").alias("phase_1"))


def neighbourhoods(hg: Hypergraph) -> DataFrame:
    """(node, memberships array<(edge_id, predicate, others)>): what a step chooses from. An edge counts once per slot of the node; others are its
    remaining slots (only the first slot of the node goes). As large as a node's membership list, which is what the walk draws from."""
    slots = hg.edges.select("edge_id", "predicate", "args", F.posexplode("args").alias("pos", "node"))
    first = F.array_position("args", F.col("node")).cast("int")
    others = F.concat(F.slice("args", F.lit(1), first - 1), F.slice("args", first + 1, F.lit(1 << 30)))
    entry = F.struct("edge_id", "pos", "predicate", others.alias("others"))
    return slots.groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("memberships"))


def indexed_memberships(hg: Hypergraph) -> DataFrame:
    """(node, k, degree, predicate, others): the k-th membership (from 0) of each node, for walks that look up one membership a step.
    A node's memberships are rows, so a hub is no large array in one row."""
    slots = hg.edges.select("edge_id", "predicate", "args", F.posexplode("args").alias("pos", "node"))
    first = F.array_position("args", F.col("node")).cast("int")
    others = F.concat(F.slice("args", F.lit(1), first - 1), F.slice("args", first + 1, F.lit(1 << 30)))
    order = Window.partitionBy("node").orderBy("edge_id", "pos")
    return slots.select("node", (F.row_number().over(order) - 1).alias("k"), "predicate", others.alias("others"))


def walks(hg: Hypergraph, sources: DataFrame, n_walks: Column | int, length: int, seed: int = 42, first_walk: Column | int = 0) -> DataFrame:
    """(source, walk, step, node, path): sources(source[, n_walks]) walk ``length`` steps; path has the predicates so far.

    Draws are digests of seed|source|walk|step|purpose, so a walk can be redone by itself, on any engine.
    """
    n = F.lit(n_walks) if isinstance(n_walks, int) else n_walks
    lo = F.lit(first_walk) if isinstance(first_walk, int) else first_walk
    table = cut(indexed_memberships(hg))
    degrees = cut(table.groupBy("node").agg(F.count("*").alias("degree")))
    at = sources.filter(n > 0).select("source", F.explode(F.sequence(lo.cast("long"), lo.cast("long") + n.cast("long") - 1)).alias("walk")).select("source", "walk", F.col("source").alias("node"), F.array().cast("array<string>").alias("path"))
    out = None
    for step in range(1, length + 1):
        drawn = at.join(degrees, "node").withColumn("k", draw(str(seed), F.col("source"), F.col("walk"), F.lit(step), F.lit("edge")) % F.col("degree"))
        went = drawn.join(table, ["node", "k"])
        i = (draw(str(seed), F.col("source"), F.col("walk"), F.lit(step), F.lit("node")) % F.size("others")).cast("int")
        at = cut(went.select("source", "walk", F.get("others", i).alias("node"), F.concat("path", F.array("predicate")).alias("path")))
        rows = at.select("source", "walk", F.lit(step).cast("long").alias("step"), "node", "path")
        out = rows if out is None else out.unionByName(rows)
    return out


def first_hits(steps: DataFrame) -> DataFrame:
    """The first visit of each walk to each node (the source itself can be hit)."""
    first = steps.groupBy("source", "walk", "node").agg(F.min_by(F.struct("step", "path"), "step").alias("f"))
    return first.select("source", "walk", "node", F.col("f.step").alias("step"), F.col("f.path").alias("path"))


def hitting_times(hits: DataFrame, n_walks: DataFrame, length: int) -> DataFrame:
    """(source, node, hits, acc, avg_tht): unhit walks count ``length``. n_walks(source, n_walks)."""
    s = hits.groupBy("source", "node").agg(F.count("*").alias("hits"), F.sum("step").alias("acc")).join(n_walks, "source")
    return s.select("source", "node", "hits", "acc", ((F.col("acc") + (F.col("n_walks") - F.col("hits")) * length) / F.col("n_walks")).alias("avg_tht"))


def with_unhit(times: DataFrame, pairs: DataFrame, length: int) -> DataFrame:
    """times for every one of pairs(source, node): a node that no walk of the source hits has no hits and the time ``length``."""
    j = pairs.select("source", "node").join(times, ["source", "node"], "left")
    return j.select("source", "node", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("acc", F.lit(0)).alias("acc"), F.coalesce("avg_tht", F.lit(float(length))).alias("avg_tht"))


def path_counts(hits: DataFrame) -> DataFrame:
    """(source, node, path, cnt); path as text ``P1,P2,``."""
    return hits.groupBy("source", "node", F.concat(F.array_join("path", ","), F.lit(",")).alias("path")).agg(F.count("*").alias("cnt"))


def path_length(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit(","), F.lit("")))


def _by_count():
    return Window.partitionBy("source", "node").orderBy(F.desc("cnt"), "path")


def top_paths(counts: DataFrame, k: int, length: int | None = None) -> DataFrame:
    """The k most frequent paths of each node (of one length if given), ties by path."""
    c = counts if length is None else counts.filter(path_length(F.col("path")) == length)
    return c.withColumn("r", F.row_number().over(_by_count())).filter(F.col("r") <= k)


def nth_path_count(counts: DataFrame, n: int) -> DataFrame:
    """(source, node, nth): count of the n-th most frequent path, or of the least frequent if there are fewer."""
    return top_paths(counts, n).groupBy("source", "node").agg(F.min("cnt").alias("nth"))


def unique_paths(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source").agg(F.count_distinct("path").alias("n_paths"))


def additional_walks(unique: DataFrame, config: WalkConfig, length: int, done: int) -> DataFrame:
    """(source, n_paths, extra): what the second phase adds, given the paths that the first has seen."""
    p = F.col("n_paths").cast("double")
    need = F.bround(F.least(F.lit(config.max_num_paths + 1), F.col("n_paths") + 1) * F.log(p) / (config.epsilon**2), 0)
    return unique.select("source", "n_paths", F.greatest(F.lit(0), F.greatest(need.cast("long"), F.lit(walks_for_times(length, config.epsilon))) - done).cast("long").alias("extra"))


def sample(hg: Hypergraph, sources: DataFrame, config: WalkConfig, length: int, n_predicates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(first hits of both phases, n_walks(source, n_walks)): a first quarter of the budget, then what the paths seen ask for."""
    n = n_predicates if n_predicates is not None else hg.edges.select("predicate").distinct().count()
    one = max(1, budget(config, n, length)["phase_1"])
    first = cut(first_hits(walks(hg, sources, one, length, config.seed)))
    seen = sources.join(unique_paths(path_counts(first)), "source", "left").fillna(1, ["n_paths"])
    extra = cut(additional_walks(seen, config, length, one))
    second = cut(first_hits(walks(hg, extra, F.col("extra"), length, config.seed, first_walk=one)))
    return first.unionByName(second), extra.select("source", (F.col("extra") + one).alias("n_walks"))


def top_probabilities(counts: DataFrame, n_walks: DataFrame, k: int) -> DataFrame:
    """Probability of each of the top k paths."""
    return top_paths(counts, k).join(n_walks, "source").select("source", "node", "path", (F.col("cnt") / F.col("n_walks")).alias("p"))


def cluster_path_counts(counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(source, cluster, path, cnt, size): summed counts of clusters(source, node, cluster); shares divide by walks * size."""
    sizes = clusters.groupBy("source", "cluster").agg(F.count_distinct("node").alias("size"))
    c = counts.join(clusters, ["source", "node"]).groupBy("source", "cluster", "path").agg(F.sum("cnt").alias("cnt"))
    return c.join(sizes, ["source", "cluster"])


def exact_hits(hg: Hypergraph, pairs: DataFrame, length: int, least: float = 0.0) -> DataFrame:
    """(source, target, step, path, p): probability that a walk first hits target at a step, along a path of predicates.

    A dynamic programme over (source, target, node, path) with absorption at the target; pairs(source, target). States under ``least`` are let go.

    Nodes that are no target and move alike (a hub's leaves) are one state, as what follows is the same from each of them; with ``least`` each node is its own.
    """
    pairs = cut(pairs.select("source", "target"))
    memberships = hg.edges.select(F.explode("args").alias("node"), "predicate", "args")
    first = F.array_position("args", F.col("node")).cast("int")
    others = F.concat(F.slice("args", F.lit(1), first - 1), F.slice("args", first + 1, F.lit(1 << 30)))
    moves = cut(
        memberships.select("node", "predicate", F.explode(others).alias("next"), (1.0 / (F.size("args") - 1)).alias("q"))
        .groupBy("node", "predicate", "next").agg(F.sum("q").alias("q"))
        .join(hg.degrees().withColumnRenamed("degree", "d"), "node").select("node", "predicate", "next", (F.col("q") / F.col("d")).alias("q"))
    )
    at = pairs.select("source", "target", F.col("source").alias("node"), F.lit("").alias("path"), F.lit(1.0).alias("p"))
    if least == 0:
        ends = pairs.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        marks = [F.bit_xor(F.xxhash64(F.lit(i), "predicate", "next", "q")) for i in (1, 2)]  # no row of a node repeats, so none cancel
        alike = moves.groupBy("node").agg(F.concat_ws("|", *marks, F.count("*")).alias("mark")).join(ends, "node", "left_anti")
        # one of them stands for all
        states = cut(alike.join(alike.groupBy("mark").agg(F.min("node").alias("state"), F.count("*").alias("n")).filter("n > 1"), "mark").select("node", "state"))
        moves = moves.join(states.filter("node <> state").select("node"), "node", "left_anti").join(states.withColumnRenamed("node", "next"), "next", "left")
        moves = cut(moves.groupBy("node", "predicate", F.coalesce("state", "next").alias("next")).agg(F.sum("q").alias("q")))
    out = None
    for step in range(1, length + 1):
        went = at.join(moves, "node").groupBy("source", "target", F.col("next").alias("node"), F.concat("path", "predicate", F.lit(",")).alias("path")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        went = cut(went.filter(F.col("p") > least))
        hit = went.filter("node = target").select("source", "target", F.lit(step).cast("long").alias("step"), "path", "p")
        out = hit if out is None else out.unionByName(hit)
        at = went.filter("node <> target")
    return out


def exact_times(hits: DataFrame, length: int) -> DataFrame:
    """(source, target, tht): expected truncated hitting time."""
    return hits.groupBy("source", "target").agg((F.sum(F.col("p") * F.col("step")) + (1 - F.sum("p")) * length).alias("tht"))

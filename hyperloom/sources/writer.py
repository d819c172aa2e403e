"""Sinks: community files (.ldb, .uldb, .srcnclusts), atoms as text, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hypergraph import Hypergraph


def check_counts(hg: Hypergraph, communities: DataFrame) -> None:
    """There can't be more communities than nodes."""
    if communities.select("source").distinct().count() > hg.nodes.count():
        raise ValueError("there are more communities than nodes")


def community_atoms(hg: Hypergraph, communities: DataFrame) -> DataFrame:
    """(source, predicate, args): edges whose nodes all lie in the community, and singletons of its nodes, each once."""
    members = communities.select("source", "node").distinct()
    sizes = hg.edges.select("edge_id", F.size(F.array_distinct("args")).alias("n"))
    whole = hg.incidence.select("edge_id", "node").distinct().join(members, "node").groupBy("source", "edge_id").agg(F.count("*").alias("inside")).join(sizes, "edge_id").filter("inside = n")
    multi = whole.select("source", "edge_id").join(hg.edges, "edge_id").select("source", "predicate", "args")
    single = hg.singletons.join(members, "node").select("source", "predicate", F.array("node").alias("args"))
    return multi.unionByName(single).distinct()


def node_names(communities: DataFrame, ids: DataFrame) -> DataFrame:
    """(source, node, node_name, plain_name): CLUST_k for clustered nodes, else NODE_id; and NODE_id for all. A node without an id is an error."""
    j = communities.join(ids, "node", "left").withColumn("node_id", F.when(F.col("node_id").isNull(), F.raise_error(F.concat(F.lit("no id for node "), "node")).cast("long")).otherwise(F.col("node_id")))
    plain = F.concat(F.lit("NODE_"), F.col("node_id").cast("string"))
    return j.select("source", "node", F.when(F.col("cluster_id").isNotNull(), F.concat(F.lit("CLUST_"), F.col("cluster_id").cast("string"))).otherwise(plain).alias("node_name"), plain.alias("plain_name"))


def atom_lines(hg: Hypergraph, communities: DataFrame, ids: DataFrame, plain: bool = False) -> DataFrame:
    """(source, line): rendered atoms over node and cluster names (.ldb), or node names alone (.uldb), each once."""
    names = node_names(communities, ids).select("source", "node", F.col("plain_name" if plain else "node_name").alias("name"))
    a = community_atoms(hg, communities).withColumn("a", F.xxhash64("predicate", "args"))
    slots = a.select("source", "predicate", "args", F.posexplode("args").alias("pos", "node")).join(names, ["source", "node"])
    said = slots.groupBy("source", "predicate", "args").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("s"))
    return said.select("source", F.concat("predicate", F.lit("("), F.array_join(F.transform("s", lambda x: x["name"]), ","), F.lit(")")).alias("line")).distinct()


def community_numbers(communities: DataFrame, ids: DataFrame) -> DataFrame:
    """(source, number): communities counted by the id of their source, from 0."""
    from ..plans.shared import with_ordinal

    s = communities.select(F.col("source").alias("node")).distinct().join(ids, "node")
    return with_ordinal(s, "number", "node_id").select(F.col("node").alias("source"), "number")


def atom_blocks(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, block): header, sorted atoms and footer of each community."""
    g = lines.groupBy("source").agg(F.sort_array(F.collect_list("line")).alias("a")).join(numbers, "source", "right")
    a = F.coalesce("a", F.array().cast("array<string>"))
    head = F.concat(F.lit("#START_DB "), F.col("number").cast("string"), F.lit(" #COM 1 #NUM_ATOMS "), F.size(a).cast("string"), F.lit(" \n"))
    return g.select("number", F.concat(head, F.array_join(F.transform(a, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("#END_DB\n\n")).alias("block"))


def source_blocks(communities: DataFrame, ids: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, block): source, sorted single ids, clusters with sorted ids, and all sorted ids."""
    j = communities.join(ids, "node")
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), "  ")
    clusters = j.filter("cluster_id is not null").groupBy("source", "cluster_id").agg(joined(F.collect_set("node_id")).alias("members"))
    clusters = clusters.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "members"))).alias("c"))
    per = j.groupBy("source").agg(
        F.max(F.when(F.col("role") == "SOURCE", F.col("node_id"))).alias("own"), joined(F.collect_set(F.when(F.col("cluster_id").isNull() & (F.col("role") != "SOURCE"), F.col("node_id")))).alias("singles"),
        joined(F.collect_set("node_id")).alias("all"),
    )
    x = per.join(clusters, "source", "left").join(numbers, "source")
    lines = F.transform("c", lambda r: F.concat(F.lit("CLUST "), r["cluster_id"].cast("string"), F.lit("  "), r["members"], F.lit("\n")))
    body = F.concat(
        F.lit("#START_DB "), F.col("number").cast("string"), F.lit("\nSRC  "), F.col("own").cast("string"), F.lit("\n"), F.col("singles"), F.lit("\n"),
        F.coalesce(F.array_join(lines, ""), F.lit("")), F.lit("NODES  "), F.col("all"), F.lit("\n#END_DB\n\n"),
    )
    return x.select("number", body.alias("block"))


def graph_text(blocks: DataFrame) -> DataFrame:
    """(place, value): the file's header, its blocks by number, its footer. Counting the blocks needs a job."""
    n = blocks.count()
    ends = blocks.sparkSession.createDataFrame([(-1, f"#START_GRAPH  #COMS {n}\n\n"), (n, "#END_GRAPH\n")], "place long, value string")
    return ends.unionByName(blocks.select(F.col("number").cast("long").alias("place"), F.col("block").alias("value")))


def write_graph(blocks: DataFrame, path: str) -> None:
    """Text parts in the order of the file; concatenated by name they are the file."""
    graph_text(blocks).orderBy("place").select(F.regexp_replace("value", r"\n\z", "").alias("value")).write.mode("overwrite").text(path)


def write_files(hg: Hypergraph, communities: DataFrame, name: str) -> None:
    """name.ldb, name.uldb and name.srcnclusts."""
    check_counts(hg, communities)
    ids = hg.node_ids()
    numbers = community_numbers(communities, ids)
    write_graph(atom_blocks(atom_lines(hg, communities, ids), numbers), f"{name}.ldb")
    write_graph(atom_blocks(atom_lines(hg, communities, ids, plain=True), numbers), f"{name}.uldb")
    write_graph(source_blocks(communities, ids, numbers), f"{name}.srcnclusts")


def write_atoms(atoms: DataFrame, path: str) -> None:
    """``predicate(a,b)`` lines."""
    atoms.select(F.concat("predicate", F.lit("("), F.array_join("args", ","), F.lit(")")).alias("value")).write.mode("append").text(path)


def append_log(metrics: DataFrame, path: str) -> None:
    """metrics(method, quantity, key, value) appended as ``key, value`` lines, a folder per method and quantity."""
    metrics.select("method", "quantity", F.concat_ws(", ", "key", F.col("value").cast("string")).alias("value")).write.mode("append").partitionBy("method", "quantity").text(path)

"""All queries over the relational-hypergraph operators, with the SQL that checks them.

Every query builds its atoms from the driver's tables (plans.relational) and runs over them whole. Walks start from every node of the place
hypergraph (nations, regions, suppliers, customers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ClusteringConfig, WalkConfig
from .functions.stats import chi2_sum_upper, t_upper
from .operators import communities as C
from .operators import diagnostics as D
from .operators import etl, graph, grouping, mln, spectral, walks
from .operators.hypergraph import Hypergraph, symmetric
from .plans import relational
from .plans.shared import cut, draw
from .sources import text, writer

QUERIES: dict = {}
ORACLES: dict = {}

SEED, N_WALKS, LENGTH, TOP = 42, 8, 4, 3
#: Groups up to this size are clustered by divergence, larger ones by features.
SPLIT = 8
_CONFIG = WalkConfig(epsilon=0.4, max_num_paths=2, alpha_sym=0.1, max_path_length=LENGTH)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hg(spark: SparkSession, sf: str, orders: bool = True) -> Hypergraph:
    atoms = relational.atoms(spark, sf, orders)
    return Hypergraph(atoms, relational.predicates(spark, atoms))


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


FULL, PLACES = relational.sql_prefix(True), relational.sql_prefix(False)

# ---- sources


def _lines(spark: SparkSession, sf: str, bad: bool = False) -> DataFrame:
    """The atoms as lines of a database, with a comment and, if asked, lines that break the grammar."""
    a = relational.atoms(spark, sf, False).select(F.concat("predicate", F.lit("("), F.array_join("args", ", "), F.lit(")")).alias("value"), F.col("edge_id").alias("line_no"))
    extra = [("// comment", -3), ("   ", -2), ("  // indented comment", -1)] + ([("NoParenthesis", -6), ("Space (a)", -5), ("Empty()", -4)] if bad else [])
    return a.unionByName(spark.createDataFrame(extra, "value string, line_no long"))


@query(PLACES + "select edge_id::bigint as edge_id, predicate, array_to_string(args, '|') as args from atoms")
def atoms_scan(spark, sf):
    rows = text.parse_atoms(_lines(spark, sf))
    return rows.select("edge_id", "predicate", F.array_join("args", "|").alias("args"))


@query(PLACES + "select predicate, len(args)::bigint as arity, count(*)::bigint as n, min(args[1]) as low, max(args[1]) as high from atoms group by 1, 2")
def atom_parse(spark, sf):
    rows = text.parse_atoms(_lines(spark, sf), "PERMISSIVE")
    return rows.groupBy("predicate", F.size("args").cast("long").alias("arity")).agg(F.count("*").alias("n"), F.min(F.col("args")[0]).alias("low"), F.max(F.col("args")[0]).alias("high"))


@query(PLACES + "select 'good' as kind, count(*)::bigint as n from atoms union all select 'bad', 3 union all select 'skipped', 3")
def atom_syntax_audit(spark, sf):
    v = F.col("value")
    return _lines(spark, sf, bad=True).groupBy(F.when(text.is_skipped(v), "skipped").when(text.is_atom(v), "good").otherwise("bad").alias("kind")).agg(F.count("*").alias("n"))


@query("select p_brand as predicate, arg_max(p_type, p_partkey) as arg_types from part group by 1".replace("p_brand", "replace(p_brand, '#', '_')").replace("p_type,", "replace(p_type, ' ', ','),"))
def info_scan(spark, sf):
    p = _t(spark, sf, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("("), F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit(")")).alias("value"), F.col("p_partkey").alias("line_no"))
    return text.parse_info(p).select("predicate", F.array_join("arg_types", ",").alias("arg_types"))


@query("select string_agg(n_name, ',' order by n_nationkey) as query_predicates from nation")
def query_predicates(spark, sf):
    n = _t(spark, sf, "nation").select(F.concat("n_name", F.lit("(person)")).alias("value"), F.col("n_nationkey").cast("long").alias("line_no"))
    return text.query_predicates(n.unionByName(spark.createDataFrame([("// no", -1), ("", -2)], "value string, line_no long")))


@query("""with r as (select 'A' || (event_id % 997) as ground_atom, round(abs(value), 6) as own, event_id from events),
f as (select ground_atom, arg_min(own, event_id) as prob from r group by 1)
select r.ground_atom, count(*)::bigint as n, min(f.prob) as prob from r join f using (ground_atom) group by 1""")
def inference_scan(spark, sf):
    e = _t(spark, sf, "events").select(F.concat(F.lit("A"), (F.col("event_id") % 997).cast("string"), F.lit(" "), F.round(F.abs("value"), 6).cast("string")).alias("value"), F.col("event_id").alias("line_no"))
    return text.parse_inference(e).groupBy("ground_atom").agg(F.count("*").alias("n"), F.min("prob").alias("prob"))


@query("select avg(len(string_split(p_type, ' ')))::double as avg_length, max(len(string_split(p_type, ' ')))::bigint as max_length, count(*)::bigint as n_formulas from part")
def mln_formula_stats(spark, sf):
    p = _t(spark, sf, "part").select(F.concat(F.col("p_retailprice").cast("string"), F.lit("  "), F.replace("p_type", F.lit(" "), F.lit(" v "))).alias("value"))
    notes = p.select(F.concat(F.lit("// "), "value").alias("value"))
    return mln.formula_stats(text.parse_rules(p.unionByName(notes)))


@query("select c_mktsegment as key, count(*)::bigint as n, round(sum(c_acctbal), 4) as total from customer group by 1")
def metric_log_scan(spark, sf):
    c = _t(spark, sf, "customer").select(F.concat_ws(", ", "c_mktsegment", F.col("c_acctbal").cast("string")).alias("value"), F.col("c_custkey").alias("line_no"))
    c = c.unionByName(spark.createDataFrame([("summary, 1.5 +/- 0.2", -1)], "value string, line_no long"))
    return text.parse_log(c).groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- hypergraph algebra


@query(FULL + "select predicate, len(args)::bigint as arity, count(*)::bigint as n, sum(edge_id)::bigint as ids from edges group by 1, 2")
def hyperedges(spark, sf):
    return _hg(spark, sf).edges.groupBy("predicate", F.size("args").cast("long").alias("arity")).agg(F.count("*").alias("n"), F.sum("edge_id").alias("ids"))


@query(FULL + "select node, predicate from singles")
def singletons(spark, sf):
    return _hg(spark, sf).singletons


@query(FULL + "select edge_id::bigint as edge_id, predicate, pos::bigint as pos, node from inc")
def incidence(spark, sf):
    return _hg(spark, sf).incidence.select("edge_id", "predicate", F.col("pos").cast("long").alias("pos"), "node")


@query(FULL + "select node, node_type from nodes")
def node_types(spark, sf):
    return _hg(spark, sf).nodes.select("node", "node_type")


@query(FULL + "select node, (row_number() over (order by first_slot) - 1)::bigint as node_id from nodes")
def node_ids(spark, sf):
    return _hg(spark, sf).node_ids()


@query(FULL + "select distinct node from slots")
def node_set(spark, sf):
    return _hg(spark, sf).slots.select("node").distinct()


@query(FULL + """select (select count(distinct node) from slots)::bigint as n_nodes, ((select count(*) from edges) + (select count(*) from singles))::bigint as n_edges,
(select count(distinct predicate) from edges)::bigint as n_predicates, (select count(distinct t) from (select unnest(arg_types) as t from preds))::bigint as n_types""")
def hypergraph_counts(spark, sf):
    return _hg(spark, sf).counts()


@query(FULL + "select predicate, len(args)::bigint as arity, count(*)::bigint as atoms from atoms group by 1, 2")
def hypergraph_summary(spark, sf):
    return _hg(spark, sf).summary().select("predicate", F.col("arity").cast("long").alias("arity"), "atoms")


@query("select distinct 'C' || c_custkey as node from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')")
def orphan_nodes(spark, sf):
    """Customers that only have a segment atom, in the hypergraph of urgent orders in progress and segments."""
    some = _t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("o"))
    raw = relational.raw_atoms(spark, sf)
    placed = raw.filter("rel = 4").join(some, F.col("args")[1] == F.col("o"), "left_semi")
    a = raw.filter("rel = 6").unionByName(placed).withColumn("edge_id", F.lit(0).cast("long"))
    return Hypergraph(a, relational.predicates(spark, a)).orphans()


@query(FULL + "select src, dst, weight from clique")
def clique_graph(spark, sf):
    return Hypergraph(relational.raw_atoms(spark, sf), None).clique_graph()


@query(FULL + "select src, dst, 1::bigint as weight from clique")
def clique_graph_unweighted(spark, sf):
    return Hypergraph(relational.raw_atoms(spark, sf), None).clique_graph(weighted=False)


@query(FULL + ", d as (select node, count(*) as degree from inc group by 1) select degree::bigint as degree, count(*)::bigint as n, round((select avg(degree) from d), 6) as mean_degree from d group by 1".replace(", d as", ", d as", 1))
def degree_histogram(spark, sf):
    h = Hypergraph(relational.raw_atoms(spark, sf).withColumn("edge_id", F.lit(0).cast("long")), None)
    return D.degree_histogram(h.degrees()).select("degree", "n", _r("mean_degree"))


def _places(spark, sf) -> DataFrame:
    return Hypergraph(relational.raw_atoms(spark, sf, False), None).clique_graph()


_BFS = relational.sql_prefix(False, "reach(node, level) as (select min(least(src, dst)), 0::bigint from clique union select v, level + 1 from reach join sym on u = node where level < 12), lev as (select node, min(level) as level from reach group by 1)")


@query(_BFS + "select node, level from lev")
def bfs_levels(spark, sf):
    g = cut(_places(spark, sf))
    return graph.bfs_levels(g, g.agg(F.min(F.least("src", "dst")).alias("node")))


@query(relational.sql_prefix(False, """reach(node, level) as (select min(least(src, dst)), 0::bigint from clique union select v, level + 1 from reach join sym on u = node where level < 12),
lev as (select node, min(level) as level from reach group by 1), far as (select node from lev order by level desc, node limit 1),
back(node, level) as (select node, 0::bigint from far union select v, level + 1 from back join sym on u = node where level < 12)""")
    + "select (select min(least(src, dst)) from clique) as start, (select node from far) as far, (select max(level) from (select node, min(level) as level from back group by 1)) as diameter")
def two_sweep_diameter(spark, sf):
    return graph.two_sweep(cut(_places(spark, sf)))


@query("""with recursive e as (select 'U' || user_id as a, 'T' || event_type as b from events union select 'O' || l_orderkey, 'L' || l_linenumber || '_' || (l_orderkey % 50) from lineitem),
s as (select a, b from e union select b, a from e), c as (select b, min(a) as a from e group by 1),
hub as (select distinct b as n from e), h2 as (select distinct x.b as p, y.b as q from e x join e y using (a)),
r(n, m) as (select n, n from hub union select r.n, h2.q from r join h2 on r.m = h2.p),
hl as (select n, min(m) as m from r group by 1), mem as (select b as node, m, a from e join hl on hl.n = e.b),
lab as (select hl.m as m, min(least(e.a, e.b)) as component from e join hl on hl.n = e.b group by 1)
select node, min(component) as component from (select e.a as node, lab.component from e join hl on hl.n = e.b join lab on lab.m = hl.m union all select e.b, lab.component from e join hl on hl.n = e.b join lab on lab.m = hl.m) group by 1""")
def connected_components(spark, sf):
    """Components of users with event types, and of orders with line slots shared by orders of the same remainder."""
    e = _t(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("a"), F.concat(F.lit("T"), "event_type").alias("b"))
    l = _t(spark, sf, "lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string"), F.lit("_"), (F.col("l_orderkey") % 50).cast("string")).alias("b"))
    g = e.unionByName(l).distinct().select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return graph.connected_components(g)


def _by_region(spark, sf) -> DataFrame:
    """Clusters of nodes: each nation, supplier and customer with its region."""
    n = _t(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("cluster"))
    parts = [n.select("cluster", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))]
    for table, key, nat, letter in (("supplier", "s_suppkey", "s_nationkey", "S"), ("customer", "c_custkey", "c_nationkey", "C")):
        parts.append(_t(spark, sf, table).join(F.broadcast(n), F.col(nat) == F.col("n_nationkey")).select("cluster", F.concat(F.lit(letter), F.col(key).cast("string")).alias("node")))
    parts.append(_t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("cluster", F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


_CLUSTERS = relational.sql_prefix(True, """rn as (select n_nationkey, 'R' || n_regionkey as cluster from nation),
cl as (select cluster, 'N' || n_nationkey as node from rn union select cluster, 'S' || s_suppkey from supplier join rn on s_nationkey = n_nationkey
 union select cluster, 'C' || c_custkey from customer join rn on c_nationkey = n_nationkey
 union select cluster, 'O' || o_orderkey from orders join customer on o_custkey = c_custkey join rn on c_nationkey = n_nationkey),
maj as (select cluster, i.edge_id, i.predicate, count(distinct node) as inside, count(*) as slots_inside from inc i join cl using (node) group by 1, 2, 3),
major as (select maj.* from maj join edges using (edge_id) where inside > len(args) / 2.0)""")


@query(_CLUSTERS + "select cluster, edge_id::bigint as edge_id, predicate, inside::bigint as inside, slots_inside::bigint as slots_inside from major")
def majority_hyperedges(spark, sf):
    return _hg(spark, sf).majority(_by_region(spark, sf))


@query(_CLUSTERS + "select distinct m.cluster, i.node from major m join inc i using (edge_id) where not exists (select 1 from cl where cl.cluster = m.cluster and cl.node = i.node)")
def border_nodes(spark, sf):
    return _hg(spark, sf).border(_by_region(spark, sf))


@query(_CLUSTERS + "select cluster, count(*)::bigint as n, count(*) filter (len(args) = 1)::bigint as singles from (select cluster, args from major join edges using (edge_id) union all select cluster, args from atoms join cl on len(args) = 1 and cl.node = args[1]) group by 1")
def leaf_hypergraphs(spark, sf):
    return _hg(spark, sf).leaf(_by_region(spark, sf)).groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.size("args") == 1).alias("singles"))


# ---- spectral


@query(PLACES + ", d as (select u, sum(weight) as d from sym group by 1) select i, j, round(sum(value), 6) as value from (select s.u as i, s.v as j, -weight / sqrt(a.d * b.d) as value from sym s join d a on a.u = s.u join d b on b.u = s.v union all select u, u, 1.0 from d) group by 1, 2")
def laplacian_entries(spark, sf):
    return spectral.laplacian(_places(spark, sf)).select("i", "j", _r("value"))


def _score(node):
    return (draw("score", node) % 100000).cast("double")


_SWEEP = relational.sql_prefix(False, """ranks as (select node, score, row_number() over (order by score, node) as idx from (select distinct u as node, (('0x' || substr(md5('score|' || u), 1, 8))::bigint % 100000)::double as score from sym)),
ed as (select least(a.idx, b.idx) as lo, greatest(a.idx, b.idx) as hi, weight from clique join ranks a on a.node = src join ranks b on b.node = dst),
st as (select lo as idx, case when lo = hi then -weight else weight end as dc, weight as dv from ed union all select hi, case when lo = hi then 0 else -weight end, weight from ed),
per as (select idx, sum(dc) as dc, sum(dv) as dv from st group by 1),
sw as (select node, r.idx, sum(coalesce(dc, 0)) over (order by r.idx) as cut, sum(coalesce(dv, 0)) over (order by r.idx) as volume, sum(coalesce(dv, 0)) over () as total, count(*) over () as n from ranks r left join per on per.idx = r.idx)""")


@query(_SWEEP + "select node, idx::bigint as idx, cut::bigint as cut, volume::bigint as volume, round(cut / least(volume, total - volume), 6) as phi from sw where idx < n")
def conductance_sweep(spark, sf):
    g = cut(_places(spark, sf))
    scores = symmetric(g).select(F.col("u").alias("node")).distinct().withColumn("score", _score(F.col("node")))
    return spectral.conductance_sweep(g, scores).select("node", "idx", "cut", "volume", _r("phi"))


@query(_SWEEP + ", b as (select idx from sw where idx < n order by cut / least(volume, total - volume), idx limit 1), side as (select node, case when ranks.idx <= b.idx then 0 else 1 end as side from ranks cross join b) select a.side::int as side, src, dst, weight from clique join side a on a.node = src join side c on c.node = dst where a.side = c.side")
def cheeger_cut(spark, sf):
    """The two induced subgraphs of the best cut along given scores."""
    g = cut(_places(spark, sf))
    scores = cut(symmetric(g).select(F.col("u").alias("node")).distinct().withColumn("score", _score(F.col("node"))))
    sweep = cut(spectral.conductance_sweep(g, scores))
    at = spectral.best_cut(sweep).select(F.col("idx").alias("at"))
    low = sweep.join(F.broadcast(at)).filter("idx <= at").select("node")  # one row
    high = scores.select("node").join(low, "node", "left_anti")
    return graph.induced(g, low).select(F.lit(0).alias("side"), "src", "dst", "weight").unionByName(graph.induced(g, high).select(F.lit(1).alias("side"), "src", "dst", "weight"))


@query(_CLUSTERS + "select a.cluster, src, dst, weight from clique join cl a on a.node = src join cl b on b.node = dst and a.cluster = b.cluster")
def induced_subgraph(spark, sf):
    """The clique graph inside each region."""
    g, c = cut(Hypergraph(relational.raw_atoms(spark, sf), None).clique_graph()), cut(_by_region(spark, sf))
    a, b = c.select(F.col("cluster"), F.col("node").alias("src")), c.select(F.col("cluster").alias("other"), F.col("node").alias("dst"))
    return g.join(a, "src").join(b, "dst").filter("cluster = other").select("cluster", "src", "dst", "weight")


@query()
def lambda2(spark, sf):
    return spectral.second_eigenvalues(_places(spark, sf))


@query()
def hierarchical_clusters(spark, sf):
    return spectral.hierarchical_clusters(_places(spark, sf), ClusteringConfig(3, 0.7))


# ---- walks

_GRID = [(1, 5, 0.1, 3), (4, 5, 0.1, 3), (4, 5, 0.05, 3), (4, 7, 0.1, 3), (1, 7, 0.1, 3), (1, 5, 0.01, 3)]


@query("""with g(n, len, eps, m) as (values (1, 5, 0.1::double, 3), (4, 5, 0.1::double, 3), (4, 5, 0.05::double, 3), (4, 7, 0.1::double, 3), (1, 7, 0.1::double, 3), (1, 5, 0.01::double, 3)),
p as (select *, case when n > 1 then 1 + n * (pow(n, len) - 1) / (n - 1) else 1 + len end as p, round_even(pow(len - 1, 2) / (4 * eps * eps), 0) as tht from g),
q as (select *, round_even(least(m + 1, p + 1) * ln(p) / (eps * eps), 0) as path from p)
select n::int as n, len::int as len, eps, m::int as m, tht::bigint as tht, p::bigint as p_star, path::bigint as path, floor(0.25 * greatest(tht, path))::bigint as phase_1 from q""")
def walk_budget(spark, sf):
    return walks.budgets(spark.createDataFrame(_GRID, "n int, len int, eps double, m int"))


_HASH = "('0x' || substr(md5('{seed}|' || w.source || '|' || w.walk || '|' || (w.step + 1) || '|{what}'), 1, 8))::bigint"
_WALKS = f"""memb as (select node, row_number() over (partition by node order by edge_id, pos) - 1 as k, predicate, list_concat(args[1 : list_position(args, node) - 1], args[list_position(args, node) + 1 :]) as others
 from (select edge_id, predicate, args, unnest(range(0, len(args))) as pos, unnest(args) as node from edges)),
deg as (select node, count(*) as degree from memb group by 1),
w(source, walk, step, node, path) as (select deg.node, r.range, 0::bigint, deg.node, []::varchar[] from deg cross join range({N_WALKS}) r
 union all select w.source, w.walk, w.step + 1, m.others[({_HASH.format(seed=SEED, what='node')} % len(m.others)) + 1], list_append(w.path, m.predicate)
 from w join deg d on d.node = w.node join memb m on m.node = w.node and m.k = {_HASH.format(seed=SEED, what='edge')} % d.degree where w.step < {LENGTH}),
steps as (select * from w where step > 0),
fh as (select source, walk, node, min(step) as step, arg_min(path, step) as path from steps group by 1, 2, 3),
hits as (select * from fh where node <> source),
pc as (select source, node, array_to_string(path, ',') || ',' as path, count(*)::bigint as cnt from hits group by 1, 2, 3),
tht as (select source, node, count(*)::bigint as hits, sum(step)::bigint as acc, (sum(step) + ({N_WALKS} - count(*)) * {LENGTH}) / {N_WALKS}.0 as avg_tht from hits group by 1, 2),
rp as (select *, row_number() over (partition by source, node order by cnt desc, path) as r from pc),
nth as (select source, node, min(cnt) as nth from rp where r <= 2 group by 1, 2)"""
WALKS = relational.sql_prefix(False, _WALKS)


def _steps(spark, sf) -> DataFrame:
    hg = _hg(spark, sf, False)
    return walks.walks(hg, hg.incidence.select(F.col("node").alias("source")).distinct(), N_WALKS, LENGTH, SEED)


def _hits(spark, sf, source_too: bool = False) -> DataFrame:
    h = walks.first_hits(_steps(spark, sf))
    return h if source_too else h.filter("node <> source")


def _n(hits: DataFrame) -> DataFrame:
    return hits.select("source").distinct().withColumn("n_walks", F.lit(N_WALKS).cast("long"))


def _counts(spark, sf) -> DataFrame:
    return walks.path_counts(_hits(spark, sf))


@query(WALKS + "select source, walk::bigint as walk, step::bigint as step, node, array_to_string(path, ',') as path from steps")
def walk_steps(spark, sf):
    return _steps(spark, sf).withColumn("path", F.array_join("path", ","))


@query(WALKS + "select source, walk::bigint as walk, node, step::bigint as step, array_to_string(path, ',') as path from fh")
def first_hits(spark, sf):
    return _hits(spark, sf, True).withColumn("path", F.array_join("path", ","))


@query(WALKS + "select source, node, hits, acc, round(avg_tht, 6) as avg_tht from tht")
def truncated_hitting_times(spark, sf):
    h = cut(_hits(spark, sf))
    return walks.hitting_times(h, _n(h), LENGTH).select("source", "node", "hits", "acc", _r("avg_tht"))


@query(WALKS + f""", pairs as (select 'N' || n_nationkey as source, unnest([node, 'R' || n_regionkey]) as node from nation join (select s_nationkey as k, 'S' || s_suppkey as node from supplier union all select c_nationkey, 'C' || c_custkey from customer) on k = n_nationkey)
select p.source, p.node, coalesce(hits, 0)::bigint as hits, coalesce(acc, 0)::bigint as acc, round(coalesce(avg_tht, {LENGTH}), 6) as avg_tht from (select distinct source, node from pairs) p left join tht using (source, node)""")
def times_of_residents(spark, sf):
    """Truncated hitting times from each nation to everyone in it and its region, those that no walk has hit included."""
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"))
    people = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    people = people.unionByName(_t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node")))
    pairs = people.join(F.broadcast(n), "k").select("source", F.explode(F.array("node", "region")).alias("node")).distinct()  # nations are few
    h = cut(_hits(spark, sf))
    return walks.with_unhit(walks.hitting_times(h, _n(h), LENGTH), pairs, LENGTH).select("source", "node", "hits", "acc", _r("avg_tht"))


@query(WALKS + "select source, node, path, cnt from pc")
def path_counts(spark, sf):
    return _counts(spark, sf)


@query(WALKS + f"select source, node, path, cnt, r::bigint as r from rp where r <= {TOP}")
def top_paths(spark, sf):
    return walks.top_paths(_counts(spark, sf), TOP).withColumn("r", F.col("r").cast("long"))


@query(WALKS + f"select source, node, path, round(cnt / {N_WALKS}.0, 6) as p from rp where r <= {TOP}")
def top_path_probabilities(spark, sf):
    h = cut(_hits(spark, sf))
    return walks.top_probabilities(walks.path_counts(h), _n(h), TOP).select("source", "node", "path", _r("p"))


@query(WALKS + "select source, node, nth from nth")
def nth_path_count(spark, sf):
    return walks.nth_path_count(_counts(spark, sf), 2)


@query(WALKS + "select source, count(distinct array_to_string(path, ','))::bigint as n_paths from fh group by 1")
def unique_paths(spark, sf):
    return walks.unique_paths(walks.path_counts(_hits(spark, sf, True)))


@query(WALKS + f", u as (select source, count(distinct array_to_string(path, ','))::bigint as n_paths from fh group by 1) select source, n_paths, greatest(0, greatest(round_even(least({_CONFIG.max_num_paths + 1}, n_paths + 1) * ln(n_paths) / {_CONFIG.epsilon**2}::double, 0)::bigint, {walks.walks_for_times(LENGTH, _CONFIG.epsilon)}) - {N_WALKS})::bigint as extra from u")
def additional_walks(spark, sf):
    return walks.additional_walks(walks.unique_paths(walks.path_counts(_hits(spark, sf, True))), _CONFIG, LENGTH, N_WALKS)


@query(WALKS + ", cl as (select source, node, substr(node, 1, 1) as cluster from pc group by 1, 2), z as (select source, cluster, count(*)::bigint as size from cl group by 1, 2) select source, cluster, path, sum(cnt)::bigint as cnt, min(size) as size from pc join cl using (source, node) join z using (source, cluster) group by 1, 2, 3")
def cluster_path_counts(spark, sf):
    c = cut(_counts(spark, sf))
    return walks.cluster_path_counts(c, c.select("source", "node", F.substring("node", 1, 1).alias("cluster")).distinct())


#: The same dynamic programme without paths: what is where after each step, absorbed at the target.
_EXACT = relational.sql_prefix(False, """mb as (select node, predicate, list_concat(args[1 : list_position(args, node) - 1], args[list_position(args, node) + 1 :]) as others from (select edge_id, predicate, args, unnest(args) as node from edges)),
mv as (select node, next, sum(q) as q from (select node, unnest(others) as next, 1.0::double / len(others) / count(*) over (partition by node) as q from mb) group by 1, 2),
nn as (select node from nodes where node_type = 'nation'),
s0 as (select a.node as source, b.node as target, a.node as node, 1.0::double as p from nn a join nn b on a.node <> b.node)""" + "".join(
    f", s{i} as (select c.source, c.target, mv.next as node, sum(c.p * mv.q) as p from s{i - 1} c join mv on mv.node = c.node {'where c.node <> c.target' if i > 1 else ''} group by 1, 2, 3)" for i in range(1, LENGTH + 1)
) + ", ht as (" + " union all ".join(f"select source, target, {i} as step, p from s{i} where node = target" for i in range(1, LENGTH + 1)) + ")")


@query(_EXACT + f" select source, target, round(sum(p * step) + (1 - sum(p)) * {LENGTH}, 6) as tht from ht group by 1, 2")
def exact_hitting_times(spark, sf):
    """Expected truncated hitting times between all pairs of nations, by dynamic programming."""
    hg = _hg(spark, sf, False)
    n = cut(hg.nodes.filter("node_type = 'nation'").select("node"))
    pairs = n.select(F.col("node").alias("source")).join(n.select(F.col("node").alias("target")), F.col("source") != F.col("target"))
    return walks.exact_times(walks.exact_hits(hg, pairs, LENGTH), LENGTH).select("source", "target", _r("tht"))


# ---- grouping


@query(WALKS + f"select source, node from nth where nth >= {N_WALKS} / ({N_WALKS} * {_CONFIG.epsilon**2}::double + 1)")
def close_nodes(spark, sf):
    h = cut(_hits(spark, sf))
    return grouping.close_nodes(walks.path_counts(h), _n(h), _CONFIG)


@query(WALKS + "select source, node from tht where avg_tht <= 3.5")
def close_nodes_legacy(spark, sf):
    h = cut(_hits(spark, sf))
    return grouping.close_by_time(walks.hitting_times(h, _n(h), LENGTH), 3.5)


_GROUPS = WALKS + """, ty as (select source, node, avg_tht, node_type from tht join nodes using (node)),
gp as (select *, case when avg_tht - lag(avg_tht) over (partition by source, node_type order by avg_tht, node) >= 0.3 then 1 else 0 end as fresh from ty),
gr as (select *, sum(fresh) over (partition by source, node_type order by avg_tht, node)::bigint as grp from gp),
gs as (select *, count(*) over (partition by source, node_type, grp)::bigint as size from gr)"""


def _typed(spark, sf) -> DataFrame:
    hg = _hg(spark, sf, False)
    h = cut(_hits(spark, sf))
    return walks.hitting_times(h, _n(h), LENGTH).join(hg.nodes.select("node", "node_type"), "node")


@query(_GROUPS + " select source, node_type, node, round(avg_tht, 6) as avg_tht, grp, size, case when size = 1 then 'SINGLE' else 'CLUSTER' end as role from gs")
def distance_clusters(spark, sf):
    return grouping.distance_clusters(_typed(spark, sf), 0.3).withColumn("avg_tht", _r("avg_tht"))


@query(_GROUPS + " select source, node_type, node, grp, case when size = 1 and grp <> max(grp) over (partition by source, node_type) then 'SINGLE' else 'CLUSTER' end as role from gs")
def distance_clusters_legacy(spark, sf):
    return grouping.distance_clusters(_typed(spark, sf), 0.3, last_always_cluster=True).select("source", "node_type", "node", "grp", "role")


#: Quantiles of Student's t in SQL: closed forms for 1 and 2 degrees of freedom, table values (fixed values) for 15, the expansion around the normal
#: quantile (fixed values) for many.
@query("""with g(n) as (values (2), (3), (16), (717), (11550)), l(len) as (values (4), (5), (7)),
a(alpha, z, t15) as (values (0.001::double, 3.090232306167813::double, 3.732834425310894::double), (0.05, 1.6448536269514722, 1.7530503556925547), (0.1, 1.2815515655446004, 1.3406056078504547)),
t as (select n, len, alpha, case n when 2 then tan(pi() * (0.5 - alpha)) when 3 then (1 - 2 * alpha) / sqrt(2 * alpha * (1 - alpha)) when 16 then t15
 else z + (pow(z, 3) + z) / (4 * (n - 1)) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * pow(n - 1, 2)) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(n - 1, 3)) end as t from g cross join l cross join a)
select n::int as n_walks, len::int as len, alpha, round((len - 1) / sqrt(2.0 * n) * t, 6) as theta from t""")
def theta_sym(spark, sf):
    rows = [(n, L, a, float((L - 1) / (2 * n) ** 0.5 * t_upper(a, n - 1))) for n in (2, 3, 16, 717, 11550) for L in (4, 5, 7) for a in (0.001, 0.05, 0.1)]
    return spark.createDataFrame(rows, "n_walks int, len int, alpha double, theta double").withColumn("theta", _r("theta"))


_DIST = """with a as (select n_name as pair, o_orderpriority as key, count(*) as c from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = '{s}' group by 1, 2)
select pair, key, c / sum(c) over (partition by pair) as p from a"""
_PQ = f"with p as ({_DIST.format(s='F')}), q0 as ({_DIST.format(s='O')}), q as (select * from q0 where key <> '1-URGENT' or pair < 'F')"
_KL = """{n} as (select s.pair, coalesce(sum(case when a > 0 and b > 0 then a * ln(a / b) end), 0) as kl from (select x.pair, x.n1, y.n2 from (select pair, count(*) as n1 from {p} group by 1) x join (select pair, count(*) as n2 from {q} group by 1) y using (pair)) s
left join (select p.pair, p.key, case when n2 < n1 then q.p else p.p end as a, case when n2 < n1 then p.p else q.p end as b from {p} p join {q} q on p.pair = q.pair and p.key = q.key join (select x.pair, n1, n2 from (select pair, count(*) as n1 from {p} group by 1) x join (select pair, count(*) as n2 from {q} group by 1) y using (pair)) z on z.pair = p.pair) t on t.pair = s.pair group by 1)"""
_M = "m as (select coalesce(p.pair, q.pair) as pair, coalesce(p.key, q.key) as key, (coalesce(p.p, 0) + coalesce(q.p, 0)) / 2 as p from p full join q on p.pair = q.pair and p.key = q.key)"


def _distributions(spark, sf):
    """Order priorities of each nation's finished and open orders; q lacks a key for some nations."""
    j = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = j.groupBy("o_orderstatus", F.col("n_name").alias("pair"), F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("c"))
    out = []
    for s in ("F", "O"):
        d = c.filter(F.col("o_orderstatus") == s)
        d = d.join(d.groupBy("pair").agg(F.sum("c").alias("t")), "pair").select("pair", "key", (F.col("c") / F.col("t")).alias("p"))
        out.append(cut(d if s == "F" else d.filter("key <> '1-URGENT' or pair < 'F'")))
    return out


@query(_PQ + ", " + _M + " select pair, key, round(p, 6) as m from m")
def average_distribution(spark, sf):
    return grouping.average_distribution(*_distributions(spark, sf)).select("pair", "key", _r("m"))


@query(_PQ + ", " + _KL.format(n="k", p="p", q="q") + " select pair, round(kl, 6) as kl from k")
def kl_divergence(spark, sf):
    return grouping.kl_divergence(*_distributions(spark, sf)).select("pair", _r("kl"))


@query(_PQ + ", " + _M + ", " + _KL.format(n="k1", p="p", q="m") + ", " + _KL.format(n="k2", p="q", q="m") + " select coalesce(k1.pair, k2.pair) as pair, round((coalesce(k1.kl, 0) + coalesce(k2.kl, 0)) / 2, 6) as sk from k1 full join k2 on k1.pair = k2.pair")
def sk_divergence(spark, sf):
    return grouping.sk_divergence(*_distributions(spark, sf)).select("pair", _r("sk"))


@query()
def sk_threshold(spark, sf):
    """Thresholds of the divergence test for each nation's averaged distribution."""
    return grouping.sk_thresholds(grouping.average_distribution(*_distributions(spark, sf)), TOP, 100, 0.05)


_MATRIX = WALKS + f""", cg as (select pc.*, node_type as grp from pc join nodes using (node) where len(path) - len(replace(path, ',', '')) = 2),
ct as (select * from (select *, row_number() over (partition by source, grp, node order by cnt desc, path) as r from cg) where r <= {TOP}),
mm as (select p.source, p.grp, p.path, n.node, coalesce(ct.cnt, 0) as cnt from (select distinct source, grp, path from ct) p join (select distinct source, node_type as grp, node from pc join nodes using (node)) n using (source, grp) left join ct on ct.source = p.source and ct.grp = p.grp and ct.path = p.path and ct.node = n.node),
mc as (select source, grp, path, avg(cnt) as mean, count(*) as v from mm group by 1, 2, 3)"""


def _matrix(spark, sf) -> DataFrame:
    hg = _hg(spark, sf, False)
    c = _counts(spark, sf).join(hg.nodes.select("node", F.col("node_type").alias("grp")), "node")
    return cut(grouping.path_count_matrix(c, TOP, 2))


@query(_MATRIX + " select source, grp, path, node, cnt::bigint as cnt from mm")
def path_count_matrix(spark, sf):
    return _matrix(spark, sf)


@query(_MATRIX + f" select source, grp, node, ({N_WALKS} - sum(cnt))::bigint as cnt from mm group by 1, 2, 3")
def null_counts(spark, sf):
    m = _matrix(spark, sf)
    return grouping.null_counts(m, _n(m))


@query(_MATRIX + " select source, grp, path, round(mean, 6) as mean from mc")
def mean_counts(spark, sf):
    return grouping.mean_counts(_matrix(spark, sf)).select("source", "grp", "path", _r("mean"))


@query(_MATRIX + f" select a.source, a.grp, a.path as i, b.path as j, round({N_WALKS} * (1 - 1.0 / a.v) * ((case when a.path = b.path then a.mean / {N_WALKS} else 0 end) - a.mean * b.mean / {N_WALKS**2}), 6) + 0.0 as cov from mc a join mc b on a.source = b.source and a.grp = b.grp")
def count_covariance(spark, sf):
    m = _matrix(spark, sf)
    return grouping.covariance(m, _n(m)).withColumn("cov", F.round("cov", 6) + 0.0)


@query(_MATRIX + " select mm.source, mm.grp, round(sum(pow(mean - cnt, 2)), 6) as q from mm join mc using (source, grp, path) group by 1, 2")
def q_statistic(spark, sf):
    return grouping.q_statistic(_matrix(spark, sf)).select("source", "grp", _r("q"))


@query(_MATRIX + " select source, grp, path, node, round((cnt - mean) / mean, 6) + 0.0 as z from mm join mc using (source, grp, path)")
def standardised_counts(spark, sf):
    return grouping.standardised(_matrix(spark, sf)).withColumn("z", F.round("z", 6) + 0.0)


@query(_MATRIX + " select source, substr(node, 1, 1) as cluster, path, sum(cnt)::bigint as cnt from mm group by 1, 2, 3 having sum(cnt) > 0")
def counts_per_cluster(spark, sf):
    return _matrix(spark, sf).groupBy("source", F.substring("node", 1, 1).alias("cluster"), "path").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0")


#: Chi-squared quantiles of table works (fixed values), and the closed form of two degrees of freedom with weights 2 and 1.
@query("""select n_weights::int as n_weights, alpha, q from (values (1, 0.01::double, 6.634897::double), (1, 0.05, 3.841459), (1, 0.1, 2.705543), (2, 0.01, 9.210340), (2, 0.05, 5.991465), (2, 0.1, 4.605170),
(5, 0.01, 15.086272), (5, 0.05, 11.070498), (5, 0.1, 9.236357)) t(n_weights, alpha, q)
union all select -2, alpha, round(-4 * ln(1 - sqrt(1 - alpha)), 6) from (values (0.01::double), (0.05), (0.1)) a(alpha)""")
def critical_values(spark, sf):
    """n_weights weights of 1 and a degree of freedom each; -2 stands for the weights 2 and 1 with two degrees of freedom each."""
    rows = [(p, a, float(chi2_sum_upper(a, [1.0] * p, [1.0] * p))) for p in (1, 2, 5) for a in (0.01, 0.05, 0.1)]
    rows += [(-2, a, float(chi2_sum_upper(a, [2.0, 1.0], [2, 2]))) for a in (0.01, 0.05, 0.1)]
    return spark.createDataFrame(rows, "n_weights int, alpha double, q double").withColumn("q", _r("q"))


def _per_group(spark, sf, columns: str, f):
    """f(counts of the members) for each (source, node type); members are what N_WALKS walks have hit."""
    hg = _hg(spark, sf, False)
    rows = _counts(spark, sf).join(hg.nodes.select("node", "node_type"), "node")
    return grouping.each_group(rows, ["source", "node_type"], f, columns)


@query()
def path_symmetry_test(spark, sf):
    test = grouping.by_position(lambda c: (grouping.is_symmetric(c, N_WALKS, TOP, LENGTH, 0.1),))
    return _per_group(spark, sf, "n long, symmetric boolean", lambda c: [(len(c), *test(c))])


@query()
def pca_features(spark, sf):
    first = grouping.by_position(lambda c: tuple(float(x[0]) for x in grouping.features(c, TOP, LENGTH, 2)))
    return _per_group(spark, sf, "node string, f0 double", lambda c: list(zip(sorted(c), first(c))))


@query()
def sk_clusters(spark, sf):
    parts = grouping.parts_by_position(lambda c: grouping.merge_by_divergence(c, N_WALKS, TOP, 0.1))
    return _per_group(spark, sf, "part long, node string", lambda c: [(i, n) for i, g in enumerate(parts(c) if len(c) <= SPLIT else []) for n in g])


@query()
def birch_clusters(spark, sf):
    parts = grouping.parts_by_position(lambda c: grouping.split_by_features(c, N_WALKS, _CONFIG, LENGTH))
    return _per_group(spark, sf, "part long, node string", lambda c: [(i, n) for i, g in enumerate(parts(c) if len(c) > SPLIT else []) for n in g])


@query(_GROUPS + " select source, node_type, grp, node, case when size = 1 then 'SINGLE' else 'CLUSTER' end as role from gs")
def label_groups(spark, sf):
    g = grouping.distance_clusters(_typed(spark, sf), 0.3).withColumn("part", F.lit(0).cast("long")).drop("role")
    return grouping.label_groups(g).select("source", "node_type", "grp", "node", "role")


# ---- communities and their files

#: A fixed division that SQL can follow: suppliers and customers of one nation form its community, customers in clusters by segment.
_COMM = relational.sql_prefix(False, """seg as (select 'C' || c_custkey as node, 'N' || c_nationkey as source, (dense_rank() over (order by c_mktsegment) - 1)::bigint as cluster_id from customer),
comm as (select 'N' || n_nationkey as source, 'N' || n_nationkey as node, 'SOURCE' as role, null::bigint as cluster_id from nation
 union all select 'N' || s_nationkey, 'S' || s_suppkey, 'SINGLE', null from supplier union all select source, node, 'CLUSTER', cluster_id from seg),
ids as (select node, (row_number() over (order by first_slot) - 1)::bigint as node_id from nodes),
nm as (select c.source, c.node, case when cluster_id is not null then 'CLUST_' || cluster_id else 'NODE_' || node_id end as name, 'NODE_' || node_id as plain from comm c join ids using (node)),
ca as (select distinct source, predicate, args from (select m.source, e.predicate, e.args, count(distinct i.node) as k, len(list_distinct(e.args)) as n from edges e join inc i using (edge_id) join comm m on m.node = i.node group by 1, 2, 3, e.edge_id) where k = n
 union select m.source, s.predicate, [s.node] from singles s join comm m on m.node = s.node)""")


def _communities(spark, sf) -> DataFrame:
    c = _t(spark, sf, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("source"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"), "c_mktsegment")
    segments = _t(spark, sf, "customer").select("c_mktsegment").distinct()  # a handful
    lower = segments.alias("a").join(segments.alias("b"), F.col("b.c_mktsegment") < F.col("a.c_mktsegment"), "left").groupBy("a.c_mktsegment").agg(F.count("b.c_mktsegment").alias("cluster_id"))
    n = _t(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source"))
    s = _t(spark, sf, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    none = F.lit(None).cast("long").alias("cluster_id")
    return (
        n.select("source", F.col("source").alias("node"), F.lit("SOURCE").alias("role"), none)
        .unionByName(s.select("source", "node", F.lit("SINGLE").alias("role"), none))
        .unionByName(c.join(F.broadcast(lower), "c_mktsegment").select("source", "node", F.lit("CLUSTER").alias("role"), "cluster_id"))
    )


@query(_COMM + "select source, predicate, array_to_string(args, ',') as args from ca")
def community_atoms(spark, sf):
    return writer.community_atoms(_hg(spark, sf, False), cut(_communities(spark, sf))).withColumn("args", F.array_join("args", ","))


_RENDER = "select distinct source, predicate || '(' || string_agg({c}, ',' order by pos) || ')' as line from (select source, predicate, args, unnest(range(0, len(args))) as pos, unnest(args) as node from ca) join nm using (source, node) group by source, predicate, args"


@query(_COMM + _RENDER.format(c="name"))
def ldb_atoms(spark, sf):
    hg = _hg(spark, sf, False)
    return writer.atom_lines(hg, cut(_communities(spark, sf)), cut(hg.node_ids()))


@query(_COMM + _RENDER.format(c="plain"))
def uldb_atoms(spark, sf):
    hg = _hg(spark, sf, False)
    return writer.atom_lines(hg, cut(_communities(spark, sf)), cut(hg.node_ids()), plain=True)


@query(_COMM + f""", ln as ({_RENDER.format(c='name')}), nu as (select source, row_number() over (order by node_id) - 1 as number from ids join (select distinct source from comm) s on s.source = ids.node)
select number::bigint as place, '#START_DB ' || number || ' #COM 1 #NUM_ATOMS ' || count(line) || ' ' || chr(10) || coalesce(string_agg(line || chr(10), '' order by line), '') || '#END_DB' || chr(10) || chr(10) as value from nu left join ln using (source) group by number
union all select -1, '#START_GRAPH  #COMS ' || (select count(*) from nu) || chr(10) || chr(10) union all select (select count(*) from nu), '#END_GRAPH' || chr(10)""")
def ldb_file(spark, sf):
    hg, c = _hg(spark, sf, False), cut(_communities(spark, sf))
    ids = cut(hg.node_ids())
    return writer.graph_text(writer.atom_blocks(writer.atom_lines(hg, c, ids), writer.community_numbers(c, ids)))


@query(_COMM + """, nu as (select source, row_number() over (order by node_id) - 1 as number from ids join (select distinct source from comm) s on s.source = ids.node),
cj as (select c.*, node_id from comm c join ids using (node)), cu as (select source, string_agg('CLUST ' || cluster_id || '  ' || m || chr(10), '' order by cluster_id) as cl from (select source, cluster_id, string_agg(node_id::varchar, '  ' order by node_id) as m from cj where cluster_id is not null group by 1, 2) group by 1)
select number::bigint as number, '#START_DB ' || number || chr(10) || 'SRC  ' || max(node_id) filter (role = 'SOURCE') || chr(10) || coalesce(string_agg(node_id::varchar, '  ' order by node_id) filter (role = 'SINGLE'), '') || chr(10) || coalesce(max(cl), '') || 'NODES  ' || string_agg(node_id::varchar, '  ' order by node_id) || chr(10) || '#END_DB' || chr(10) || chr(10) as block from cj join nu using (source) left join cu using (source) group by number""")
def srcnclusts_lines(spark, sf):
    hg, c = _hg(spark, sf, False), cut(_communities(spark, sf))
    ids = cut(hg.node_ids())
    return writer.source_blocks(c, ids, writer.community_numbers(c, ids)).withColumn("number", F.col("number").cast("long"))


@query(_COMM + "select source, count(*) filter (role <> 'CLUSTER')::bigint as n_singles, count(distinct cluster_id)::bigint as n_clusters, count(*) filter (role = 'CLUSTER')::bigint as n_clustered, count(distinct node)::bigint as n_nodes from comm group by 1")
def community_stats(spark, sf):
    return C.community_stats(_communities(spark, sf))


@query()
def communities(spark, sf):
    """The whole pipeline: adaptive walks from every node, close nodes, gap groups, symmetry tests, clusters."""
    return C.communities(_hg(spark, sf, False), _CONFIG, LENGTH)


@query()
def communities_legacy(spark, sf):
    """The same under the legacy filter by hitting time."""
    return C.communities(_hg(spark, sf, False), WalkConfig(epsilon=0.4, max_num_paths=2, alpha_sym=0.1, max_path_length=LENGTH, theta_hit=3.5, theta_js=1.0), LENGTH)


@query()
def clustered_communities(spark, sf):
    """From clusters to their own hypergraphs, their diameters, walks of that length and the communities inside: the regions as clusters."""
    return C.clustered_communities(_hg(spark, sf, False), cut(_by_region(spark, sf).filter("node not like 'O%'")), _CONFIG)


# ---- diagnostics

_COST = "greatest((4 * (0.577 + ln(case when n <= 1 then 1 else 1 + n * (pow(n, len) - 1) / greatest(n - 1, 1) end)) - 1) / 0.0025, pow(len - 1, 2) / 0.01) * nodes"
_GRAPHS = "g as (select n_name as name, (n_nationkey % 4 + 1)::int as n, (n_regionkey + 3)::int as len, (select count(*) from customer where c_nationkey = n_nationkey) as nodes from nation)"


def _graphs(spark, sf) -> DataFrame:
    c = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("nodes"))
    n = _t(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 + 1).alias("n"), (F.col("n_regionkey") + 3).alias("len"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query(f"with {_GRAPHS} select name, (case when n <= 1 then 1 else 1 + n * (pow(n, len) - 1) / greatest(n - 1, 1) end)::double as p_star, round({_COST}, 4) as cost from g")
def cost_model(spark, sf):
    return D.cost_model(_graphs(spark, sf))


@query(f"with {_GRAPHS}, w as (select 4 as n, 7 as len, (select count(*) from customer) as nodes) select round_even((select {_COST} from w) / (select sum({_COST}) from g), 2) as speedup")
def estimated_speedup(spark, sf):
    whole = _t(spark, sf, "customer").agg(F.count("*").alias("nodes")).select(F.lit(4).alias("n"), F.lit(7).alias("len"), "nodes")
    return D.estimated_speedup(whole, _graphs(spark, sf))


@query()
def clustering_grid(spark, sf):
    """Every smallest size from 3 to 9 with every bound of lambda2 from 0.1 to 1.9."""
    g = cut(_places(spark, sf))
    return D.clustering_grid(g, *D.grid_settings(symmetric(g).select("u").distinct().count()))


_RANKS = WALKS + """, ls as (select *, len(path) - len(replace(path, ',', '')) as len from pc), rf as (select *, row_number() over (partition by source, node, len order by cnt desc, path) as rnk, count(*) over (partition by source, node, len) as k, cnt / sum(cnt) over (partition by source, node, len) as f from ls)"""


def _by_length(spark, sf) -> DataFrame:
    return _counts(spark, sf).withColumn("len", walks.path_length(F.col("path")).cast("long"))


@query(_RANKS + ", h as (select *, sum(1.0::double / rnk) over (partition by source, node, len) as h from rf), p as (select source, node, len, sum(pow(f - 1 / (rnk * h), 2)) as rss, max(k) as k from h group by 1, 2, 3) select len::bigint as len, count(*)::bigint as n_groups, round(avg(k), 6) as mean_paths, round(avg(rss), 6) as rss from p group by 1")
def zipf_deviation(spark, sf):
    return D.zipf_deviation(_by_length(spark, sf)).select("len", "n_groups", _r("mean_paths"), _r("rss"))


@query(_RANKS + ", g as (select len, count(*) as g from (select distinct source, node, len from rf) group by 1) select len::bigint as len, rnk::bigint as rnk, round(sum(f) / min(g), 6) as p from rf join g using (len) group by 1, 2")
def mean_rank_probability(spark, sf):
    return D.mean_rank_probability(_by_length(spark, sf)).select("len", "rnk", _r("p"))


@query("with l as (select event_type as param, user_id as node, avg(value) as m, stddev_pop(value) as s from events where value is not null and not isnan(value) group by 1, 2) select param, round(avg(m), 6) as global_mean, round(stddev_pop(m), 6) as global_std, round(avg(s), 6) as avg_local_std from l group by 1")
def sweep_stats(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_type").alias("param"), F.col("user_id").alias("node"), F.col("event_id").alias("repeat"), "value")
    return D.sweep_stats(e).select("param", *[_r(c) for c in ("global_mean", "global_std", "avg_local_std")])


@query("with c as (select user_id as node, avg(value) as goal from events group by 1), j as (select event_type as threshold, avg(pow(value - goal, 2)) as mse from events join c on node = user_id group by 1) select arg_min(threshold, mse) as threshold, round(min(mse), 6) as mse from j")
def min_mse_threshold(spark, sf):
    e = _t(spark, sf, "events")
    goal = e.groupBy(F.col("user_id").alias("node")).agg(F.avg("value").alias("value"))
    return D.min_mse_threshold(e.select(F.col("event_type").alias("threshold"), F.col("user_id").alias("node"), "value"), goal).select("threshold", _r("mse"))


# ---- ETL


@query("select w || '(P' || p_partkey || ')' as atom from (select unnest(string_split(p_type, ' ')) as w, p_partkey from part)")
def etl_explode_atoms(spark, sf):
    m = _t(spark, sf, "part").select(F.col("p_partkey").alias("MovieID"), F.replace("p_type", F.lit(" "), F.lit("|")).alias("MovieGenres"))
    return etl.movie_atoms(m, None).select(F.regexp_replace("atom", r"\(M", "(P").alias("atom"))


_USERS = """select s || '(U' || c_custkey || ')' as atom from (select c_custkey, unnest([case c_nationkey % 3 when 0 then 'Male' when 1 then 'Female' end,
case when c_nationkey in (1, 18) then 'Youthful' when c_nationkey in (5, 10) then 'MiddleAged' when c_nationkey = 24 then 'Old' end]) as s from customer) where s is not null"""


def _users(spark, sf) -> DataFrame:
    """Customers as users: gender and age codes from the nation key; other codes give no atom."""
    k = F.col("c_nationkey")
    age = F.when(k.isin(1, 18), k).when(k == 5, 35).when(k == 10, 50).when(k == 24, 56).otherwise(k + 1000)
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("UserID"), F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("X").alias("Gender"), age.alias("Age"))


@query(_USERS)
def etl_bucket_atoms(spark, sf):
    return etl.user_atoms(_users(spark, sf), None)


_RATED = "select case when l_quantity >= 40 then 'Positive' when l_quantity >= 30 then 'Indifferent' else 'Negative' end || '(U' || l_suppkey || ',M' || l_partkey || ')' as atom from lineitem"


def _ratings(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("UserID"), F.col("l_partkey").alias("MovieID"), F.floor(F.col("l_quantity") / 10).cast("int").alias("Rating"))


@query(_RATED)
def etl_rating_atoms(spark, sf):
    return etl.rating_atoms(_ratings(spark, sf), None)


@query(f"select 0 as section, count(*)::bigint as n from (select unnest(string_split(p_type, ' ')) as w from part) union all select 1, count(*) from ({_USERS}) union all select 2, count(*) from ({_RATED})")
def etl_database(spark, sf):
    movies = _t(spark, sf, "part").select(F.col("p_partkey").alias("MovieID"), F.replace("p_type", F.lit(" "), F.lit("|")).alias("MovieGenres"))
    tables = {"movies": movies, "users": _users(spark, sf), "ratings": _ratings(spark, sf)}
    return etl.rating_database(tables, None).groupBy("section").agg(F.count("*").alias("n"))


# ---- evaluation


@query("select a.n_name as test, coalesce(string_agg(b.n_name, ',' order by b.n_name), '') as train from nation a left join nation b on a.n_name <> b.n_name group by 1")
def leave_one_out(spark, sf):
    return mln.leave_one_out(_t(spark, sf, "nation").select(F.col("n_name").alias("name")))


@query("select database, method, predicate, 'NOT' || database || case method when 'baseline' then '_rwl' else '_hl' end as model from (select n_name as database from nation order by 1 limit 7) cross join (values ('baseline'), ('hyperloom')) m(method) cross join (select distinct event_type as predicate from events)")
def experiment_grid(spark, sf):
    """The first seven databases by name, as an experiment of seven tests has it, with every method and query predicate."""
    methods = spark.createDataFrame([("baseline",), ("hyperloom",)], "method string")
    g = mln.experiment_grid(_t(spark, sf, "nation").select(F.col("n_name").alias("name")), methods, _t(spark, sf, "events").select(F.col("event_type").alias("predicate")), first=7)
    return g.withColumn("model", mln.learnt_name(F.col("database"), F.col("method")))


@query("""with e as (select event_type as database, 'A' || (user_id % 40) as atom, (event_id % 89 + 5) / 100.0::double as prob, user_id % 2 = 0 as positive, event_id from events),
p as (select database, positive, first_value(prob) over (partition by database, positive, atom order by event_id) as p from e)
select database, round(ln(avg(case when positive then p else 1 - p end)), 6) as cll, round(avg(ln(case when positive then p else 1 - p end)), 6) as mean_ll, count(*)::bigint as n from p group by 1""")
def cll(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_type").alias("database"), F.concat(F.lit("A"), (F.col("user_id") % 40).cast("string")).alias("ground_atom"), ((F.col("event_id") % 89 + 5) / 100).alias("prob"), (F.col("user_id") % 2 == 0).alias("positive"), F.col("event_id").alias("line_no"))
    return mln.cll(e, ["database"]).select("database", _r("cll"), _r("mean_ll"), "n")


@query("with f as (select user_id, arg_min(value, event_id) as v from events group by 1) select round_even(avg(v), 4) as mean, round_even(stddev_pop(v), 4) as std, count(*)::bigint as n from f")
def timing_summary(spark, sf):
    return mln.summary(_t(spark, sf, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("line_no")))


@query("with f as (select o_custkey, arg_min(o_totalprice, o_orderkey) as v from orders group by 1) select round_even(avg(v), 4) as mean, round_even(stddev_pop(v), 4) as std, count(*)::bigint as n from f")
def cll_summary(spark, sf):
    return mln.summary(_t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("line_no")))


@query("select round(sum(p_retailprice * p_size) / sum(p_size), 6) as avg_length, round(stddev_pop(p_retailprice), 6) as std_length, round(avg(p_size), 6) as avg_formulas from part")
def mln_summary(spark, sf):
    p = _t(spark, sf, "part").select(F.concat(F.lit("average length "), F.col("p_retailprice").cast("string"), F.lit(", formulas: "), F.col("p_size").cast("string")).alias("said"))
    v = p.select(mln.numbers_in(F.col("said")).alias("v")).select(F.col("v")[0].alias("avg_length"), F.col("v")[1].alias("n_formulas"))
    return mln.mln_summary(v).select(_r("avg_length"), _r("std_length"), _r("avg_formulas"))


@query("select m as method, q as quantity, m || '_' || q as log from (values ('baseline'), ('hyperloom')) a(m) cross join (values ('time'), ('CLL'), ('formulas')) b(q)")
def quantity_fan_out(spark, sf):
    return mln.fan_out(spark.createDataFrame([("baseline",), ("hyperloom",)], "method string"), ["time", "CLL", "formulas"])

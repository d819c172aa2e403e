"""Ground atoms of the driver's tables: ids get a letter for their kind, as in ``Placed(C7,O12)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import with_ordinal

#: Types of each predicate's arguments (predicates with a suffix by their stem).
TYPES = {
    "In": ["nation", "region"], "Based": ["supplier", "nation"], "Lives": ["customer", "nation"], "Placed": ["customer", "order"],
    "LineOf": ["order", "part", "supplier"], "Segment": ["customer"], "Status": ["order"],
}


def _atom(df: DataFrame, rel: int, predicate, *args: tuple[str, str]) -> DataFrame:
    name = F.lit(predicate) if isinstance(predicate, str) else predicate
    return df.select(F.lit(rel).alias("rel"), name.alias("predicate"), F.array(*[F.concat(F.lit(letter), F.col(c).cast("string")) for letter, c in args]).alias("args"))


def _suffixed(stem: str, c: str):
    return F.concat(F.lit(stem + "_"), F.regexp_replace(c, "[^A-Za-z0-9]", "_"))


def raw_atoms(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """(rel, predicate, args): who lives, is based and lies where; with ``orders`` who placed what and what it holds."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    parts = [
        _atom(t("nation"), 1, "In", ("N", "n_nationkey"), ("R", "n_regionkey")), _atom(t("supplier"), 2, "Based", ("S", "s_suppkey"), ("N", "s_nationkey")),
        _atom(t("customer"), 3, "Lives", ("C", "c_custkey"), ("N", "c_nationkey")), _atom(t("customer"), 6, _suffixed("Segment", "c_mktsegment"), ("C", "c_custkey")),
    ]
    if orders:
        parts += [
            _atom(t("orders"), 4, "Placed", ("C", "o_custkey"), ("O", "o_orderkey")), _atom(t("lineitem"), 5, "LineOf", ("O", "l_orderkey"), ("P", "l_partkey"), ("S", "l_suppkey")),
            _atom(t("orders"), 7, _suffixed("Status", "o_orderstatus"), ("O", "o_orderkey")),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def atoms(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """(edge_id, predicate, args); edge_id is the atom's place in the order of relation, predicate and arguments."""
    keys = ["rel", "predicate", *(F.get("args", F.lit(i)) for i in range(3))]
    return with_ordinal(raw_atoms(spark, sf_dir, orders), "edge_id", *keys).select("edge_id", "predicate", "args")


def predicates(spark: SparkSession, atoms: DataFrame) -> DataFrame:
    """(predicate, arg_types) of the predicates that occur; as many rows as there are predicates."""
    stem = F.split(F.col("predicate"), "_")[0]
    kinds = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return atoms.select("predicate").distinct().withColumn("arg_types", kinds[stem])


_RAW = """
 select 1 as rel, 'In' as predicate, ['N' || n_nationkey, 'R' || n_regionkey] as args from nation
 union all select 2, 'Based', ['S' || s_suppkey, 'N' || s_nationkey] from supplier
 union all select 3, 'Lives', ['C' || c_custkey, 'N' || c_nationkey] from customer
 union all select 6, 'Segment_' || regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '_', 'g'), ['C' || c_custkey] from customer
"""
_ORDERS = """
 union all select 4, 'Placed', ['C' || o_custkey, 'O' || o_orderkey] from orders
 union all select 5, 'LineOf', ['O' || l_orderkey, 'P' || l_partkey, 'S' || l_suppkey] from lineitem
 union all select 7, 'Status_' || regexp_replace(o_orderstatus, '[^A-Za-z0-9]', '_', 'g'), ['O' || o_orderkey] from orders
"""


def sql_prefix(orders: bool = True, more: str = "") -> str:
    """The same hypergraph as common table expressions: atoms, edges, singles, inc, preds, types, nodes (and ``more``)."""
    kinds = " union all ".join(f"select '{k}' as stem, {v} as arg_types" for k, v in TYPES.items())
    return f"""with recursive raw as ({_RAW}{_ORDERS if orders else ''}),
atoms as (select row_number() over (order by rel, predicate, args[1], args[2], args[3]) - 1 as edge_id, predicate, args from raw),
edges as (select * from atoms where len(args) > 1),
singles as (select distinct args[1] as node, predicate from atoms where len(args) = 1),
inc as (select edge_id, predicate, unnest(range(0, len(args)))::int as pos, unnest(args) as node from edges),
kinds as ({kinds}),
preds as (select p.predicate, k.arg_types from (select distinct predicate from atoms) p join kinds k on k.stem = split_part(p.predicate, '_', 1)),
slots as (select edge_id, predicate, unnest(range(0, len(args)))::int as pos, unnest(args) as node from atoms),
nodes as (select s.node, last(p.arg_types[s.pos + 1] order by s.edge_id, s.pos) as node_type, first(row(s.edge_id, s.pos) order by s.edge_id, s.pos) as first_slot from slots s join preds p using (predicate) group by s.node),
clique as (select least(a.node, b.node) as src, greatest(a.node, b.node) as dst, count(*)::bigint as weight from inc a join inc b on a.edge_id = b.edge_id and a.pos < b.pos group by 1, 2),
sym as (select src as u, dst as v, weight from clique union all select dst, src, weight from clique where src <> dst){', ' + more if more else ''}
"""

"""Benchmark decontamination as a prefix-filtered set join, with DataFrame operations only.

A window is ``size`` consecutive words of an item (a shorter item is one window). A document holds a window if and only if it
holds all of the window's shingles in order, so one necessary shingle per window is enough to find it: the prefix. Shingles are ordered
by rarity over the documents, and the rarest of each window is joined with the documents' shingles. The
offset of that shingle in the window fixes the only place where the window can stand (positional bound); places before
the first or past the last word are cut off (length bound); what is left is verified word by word.

Documents are told apart by a digest of their text, so that copies share one result and repeated or null ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; windows with fewer words have one shingle of all their words.
SHINGLE = 3
#: The table of shingles is broadcast up to this many rows (some 100 MB); beyond, the join shuffles.
MOST_BROADCAST = 1_000_000
#: Tasks that the rows of one text are dealt to where results come back to them.
SALTS = 16


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window) of every item; one row per distinct window of an item."""
    ws = benchmark.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - size, F.lit(0)))
    return ws.withColumn("at", F.explode(starts)).select("item_id", F.slice("ws", F.col("at") + 1, F.lit(size)).alias("window")).distinct()


def _shingle_rows(ws: Column, k: int) -> Column:
    """Array of structs g0 .. g(k-1): the k words from each position on."""
    return F.arrays_zip(*[F.slice(ws, i + 1, F.greatest(F.size(ws) - (k - 1), F.lit(0))).alias(f"g{i}") for i in range(k)])


def _named(k: int) -> list[str]:
    return [f"g{i}" for i in range(k)]


def _exploded(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """One row per shingle of k words of column ws, with its position ``pos``."""
    rows = df.select(*keep, F.posexplode(_shingle_rows(F.col("ws"), k)).alias("pos", "s"))
    return rows.select(*keep, "pos", *[F.col("s").getField(n).alias(n) for n in _named(k)])


def occurrences(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(key, start, n, window_id): every place of a text (by digest ``key``) where an item's window stands."""
    windows = cut(
        item_windows(benchmark, size).select("window").distinct().withColumn("n", F.size("window")).withColumn("window_id", F.xxhash64("window")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    )
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # at most SHINGLE values
    docs = documents.select(_key(F.col("text")).alias("key"), words(F.col("text")).alias("ws"))
    found = None
    for k in sorted(lengths):
        g = _named(k)
        own = windows.filter(F.col("k") == k).withColumn("ws", F.col("window"))
        shingles = cut(_exploded(own, k, "window_id").withColumnRenamed("pos", "offset"))
        few = shingles.count() <= MOST_BROADCAST
        hint = (lambda df: F.broadcast(df)) if few else (lambda df: df)
        # read twice below: without the cut, documents would be gone through once more
        rare = cut(_exploded(docs, k).join(hint(shingles.select(*g).distinct()), g).groupBy(*g).agg(F.count("*").alias("seen")))
        rarest = Window.partitionBy("window_id").orderBy("seen", "offset")
        prefix = shingles.join(rare, g).withColumn("r", F.row_number().over(rarest)).filter("r = 1").drop("r", "seen")
        # A window with a shingle that no document has can't occur; the inner join keeps it only by its other shingles.
        whole = shingles.groupBy("window_id").agg(F.count("*").alias("all"))
        there = shingles.join(rare.select(*g), g).groupBy("window_id").agg(F.count("*").alias("some"))
        alive = whole.join(there, "window_id").filter(F.col("all") == F.col("some")).select("window_id")
        probe = cut(prefix.join(alive, "window_id").join(windows.select("window_id", "window", "n"), "window_id"))
        start = F.col("pos") - F.col("offset")
        if few:
            at = _exploded(docs, k, "key", "ws").join(F.broadcast(probe), g)
        else:  # only shingles and places are dealt out; the words of texts with a candidate come to it afterwards
            at = _exploded(docs, k, "key").join(probe, g).filter(start >= 0).select("key", "pos", "offset", "n", "window", "window_id").distinct()
            at = at.join(docs.dropDuplicates(["key"]), "key")
        at = at.filter((start >= 0) & (start + F.col("n") <= F.size("ws")))
        at = at.filter(F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window")).select("key", start.alias("start"), "n", "window_id")
        found = at if found is None else found.unionByName(at)
    if found is None:
        return documents.sparkSession.createDataFrame([], "key string, start int, n int, window_id long")
    return found.distinct()


def _per_text(documents: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(key, n_hit, n_items, item_ids) of every text, by digest, in which a window stands."""
    hits = cut(occurrences(documents, benchmark, size))
    spans = hits.groupBy("key", "start").agg(F.max("n").alias("n")).withColumn("end", F.col("start") + F.col("n"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    owners = item_windows(benchmark, size).select("item_id", F.xxhash64("window").alias("window_id"))
    items = hits.select("key", "window_id").distinct().join(owners, "window_id").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    # an item without an id counts, but has no name to list
    items = items.groupBy("key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("item_ids"))
    return covered.join(items, "key", "left")


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and item_ids, of every document.

    Null and empty texts have no words and are clean; items without words have no window; an empty benchmark finds nothing; items of a null item_id are one
    item, counted but not listed. Rows that repeat return a row each. Other columns of either table are not read.
    """
    # The results of a text are few rows, so the rows of its copies are dealt to several tasks.
    salted = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    docs = documents.select("doc_id", _key(F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"), salted.alias("salt"))
    told = _per_text(documents, benchmark, size).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return docs.join(told, ["key", "salt"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), ids.alias("item_ids"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10, most_hit: float = 0.0) -> DataFrame:
    """Documents of whose words no more than the share ``most_hit`` lies in item windows. Keeps the columns of documents.

    Rows are judged by their own text, so a clean row stays even if its doc_id is null or repeats that of a contaminated one.
    """
    sizes = documents.select(_key(F.col("text")).alias("key"), F.size(words(F.col("text"))).alias("n_words"))
    bad = sizes.join(_per_text(documents, benchmark, size), "key").filter(F.col("n_hit") > most_hit * F.col("n_words"))
    bad = cut(bad.select("key").distinct())
    few = bad.count() <= MOST_BROADCAST
    return documents.join(F.broadcast(bad) if few else bad, _key(documents.text) == bad.key, "left_anti")


SQL = r"""
with b as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from benchmark where text is not null
), i as (
  select distinct item_id, ws[s + 1 : s + 10] as win from (select item_id, ws, unnest(range(0, greatest(len(ws) - 10, 0) + 1)) as s from b where len(ws) > 0)
), lens as (
  select distinct len(win) as n from i
), d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from documents
), dw as (
  select doc_id, s, n, ws[s + 1 : s + n] as win from (select doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) as s from d cross join lens)
), h as (
  select doc_id, s, dw.n, item_id from dw join i on dw.win = i.win
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by doc_id
), its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id
)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""

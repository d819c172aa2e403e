"""Mixing sources to target weights along a training run.

Every source has a weight schedule over training time t in [0, 1]: base weight times
``1 + slope * (2 t - 1)``; slopes go from -1/2 to 1/2 with the weight's distance from the mean of the weights, so heavy sources come late. Its integral over the run is the source's target; the integral up to t is
its cumulative token demand. Documents lie one after another (in an order drawn from a digest of
doc_id and text) on the axis of demand, again and again while the target asks for more than the source holds.
A document's training position is where the inverse of the demand curve puts its first word; each further epoch that takes words of it has a
position of its own.

Targets: sources by code point, null last, get the weights 3, 1, 2, 3, ... and share
``budget_share`` of all words. A target stops at ``most_epochs`` times its source's size; the excess is shared
again by weight. That fixed point is computed in closed form: in ascending order of size / weight, the first
sources stop and the others get the same level per weight.

No task sees a whole source: rows are summed by (source, bucket of the digest) first, prefix sums run over
buckets, and only a bucket is sorted by itself. There are as many buckets as keep them at about ``BUCKET_ROWS`` rows; positions don't depend on it. Rows
without a doc_id, or of one that repeats, fall into different buckets by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of sources in order, repeating (the contract's fixed values).
WEIGHTS = (3, 1, 2)
#: Hex digits of the digest that name a bucket, at least, and the rows of one that more digits are taken beyond.
BUCKET_DIGITS, BUCKET_ROWS = 3, 8192


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> the same with weight, target and slope; one row per source.

    Needs a total order of the sources, so the table of sources (not of documents) is ordered in one task.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", pick.cast("long"))
    middle = sum(weights) / len(weights)
    reach = max(abs(x - middle) for x in weights) or 1
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("_cap", F.col("source_size") * most_epochs)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_want", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
        .withColumn("_level", (F.col("_want") - F.col("_capped")) / F.col("_weight_left"))
        .withColumn("_stays", F.col("weight") * F.col("_level") <= F.col("_cap"))
        .withColumn("_at", F.min(F.when(F.col("_stays"), F.struct(F.row_number().over(fill).alias("n"), F.col("_level").alias("level")))).over(everything))
        .withColumn("target", F.when(F.col("_at").isNull() | (F.row_number().over(fill) < F.col("_at.n")), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_at.level")))
        .withColumn("slope", (F.col("weight") - F.lit(float(middle))) / F.lit(float(2 * reach)))
    )
    return w.select("source", "source_size", "weight", "target", "slope")


def position(offset: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's cumulative demand reaches ``offset`` words: the inverse of target * (t + slope * (t*t - t))."""
    x = F.when(target > 0, offset / target).otherwise(F.lit(0.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x)
    return F.when(slope == 0, x).otherwise(2 * x / ((1 - slope) + root))


def _source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _digest() -> Column:
    return F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text")))


def _placed(docs: DataFrame, keep: list[str], weights: tuple[int, ...], budget_share: float, most_epochs: int) -> DataFrame:
    """The columns ``keep`` of docs with size, source_size, target, slope and, on the axis of demand, _first (the document's first word in the first
    epoch) and _goal (the words that the mix takes of the source)."""
    digits = max(BUCKET_DIGITS, -(-(max(1, docs.count() // BUCKET_ROWS) - 1).bit_length() // 4))  # counts of files; one source may hold nearly all rows
    sized = docs.select(*keep).withColumn("size", n_words(F.col("text"))).withColumn("_digest", _digest())
    sized = sized.withColumn("_bucket", F.substring("_digest", 1, digits)).withColumn("_key", _source_key())
    buckets = docs.select("source", "doc_id", "text").select("source", n_words(F.col("text")).alias("size"), F.substring(_digest(), 1, digits).alias("bucket"))
    buckets = buckets.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget_share, most_epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").select(
        _source_key().alias("_key"), F.col("bucket").alias("_bucket"), "bucket_start", "source_size", "target", "slope"
    )
    # The window and the join deal rows by the same two columns, so texts move once for both.
    within = Window.partitionBy("_key", "_bucket").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, ["_key", "_bucket"])
    return placed.withColumn("_first", F.col("bucket_start") + F.col("_offset")).withColumn("_goal", F.floor("target"))


def _taken(epoch: int) -> Column:
    """Words that the mix takes of a placed document in one epoch."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("_goal") - _start(epoch))).cast("long")


def _start(epoch: int) -> Column:
    return F.col("_first") + epoch * F.col("source_size")


def _position(epoch: int) -> Column:
    return position(_start(epoch).cast("double"), F.col("target"), F.col("slope"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """docs with size, source_size, target, taken and position (of its first word; null if none is taken).

    taken: words the mix takes of the document over all epochs, at most ``most_epochs`` times its size. Null texts have
    size 0 and take nothing. Null sources form one source, ordered last. Rows that repeat are separate
    documents of the same place in the order; a clash of names is settled in favour of the new columns.
    """
    made = ["size", "source_size", "target", "taken", "position"]
    keep = [c for c in docs.columns if c not in made]
    placed = _placed(docs, keep, weights, budget_share, most_epochs)
    taken = sum((_taken(e) for e in range(most_epochs)), F.lit(0))
    return placed.withColumn("taken", taken.cast("long")).withColumn("position", F.when(F.col("taken") > 0, _position(0))).select(*keep, *made)


def training_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """The mix range-sorted by training position: what the run reads first stands in the first files.

    A document has a row for each epoch in which the mix takes words of it: epoch (from 0), taken (words of this epoch; the first ones of the
    text where they are fewer than size) and position (of its first word in this epoch), besides the columns that mix adds.
    """
    made = ["size", "source_size", "target", "epoch", "taken", "position"]
    keep = [c for c in docs.columns if c not in made]
    passes = F.array(*[F.struct(F.lit(e).alias("epoch"), _taken(e).alias("taken"), _position(e).alias("position")) for e in range(most_epochs)])
    placed = _placed(docs, keep, weights, budget_share, most_epochs).withColumn("_pass", F.explode(F.filter(passes, lambda x: x["taken"] > 0)))
    return placed.select(*keep, "size", "source_size", "target", "_pass.epoch", "_pass.taken", "_pass.position").orderBy("position", "doc_id")


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(concat_ws('|', doc_id::varchar, text)) as digest, text from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s
), r as (
  select *, row_number() over (order by source_size / weight, source nulls last) as n from w
), f as (
  select *, coalesce(sum(2 * source_size) over (order by n rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
         (sum(weight) over () - coalesce(sum(weight) over (order by n rows between unbounded preceding and 1 preceding), 0))::bigint as weight_left,
         (sum(source_size) over ())::bigint * 1.5::double as want from r
), l as (
  select *, (want - capped) / weight_left as lev from f
), a as (
  select min(n) as n0, arg_min(lev, n) as lev0 from l where weight * lev <= 2 * source_size
), t as (
  select source, source_size, (weight - 2) * 0.5::double as slope, case when a.n0 is null or n < a.n0 then (2 * source_size)::double else weight * a.lev0 end as target from l cross join a
), p as (
  select d.*, coalesce(sum(size) over (partition by source order by digest rows between unbounded preceding and 1 preceding), 0)::bigint as first from d
)
select p.doc_id, p.size, t.source_size, t.target,
       (greatest(0, least(p.size, floor(t.target) - p.first)) + greatest(0, least(p.size, floor(t.target) - p.first - t.source_size)))::bigint as taken,
       case when floor(t.target) > p.first and p.size > 0 then round(case when slope = 0 then p.first / t.target else 2 * (p.first / t.target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (p.first / t.target))) end, 9) end as position
from p join t on p.source is not distinct from t.source
"""

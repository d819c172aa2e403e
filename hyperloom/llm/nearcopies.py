"""Near copies by exact Jaccard similarity of word shingles: SimHash and a prefix-filtered self-join, verified links, connected components.

SimHash comes first: the sets' fingerprints are linked at ``TAU`` bits as op 1 links its own, and each linked pair is a candidate. Fingerprints of texts with a similarity of 4/5 are some
10 bits apart, so that most such pairs lie outside; an exact join finds them, and all candidates are verified on both whole sets. Two texts whose sets of shingles have a similarity of at least 4/5 share one of their n - ceil(4n/5) + 1 first shingles in any order that
all texts agree on. The order here is by rarity (counts of shingles in buckets), then by hash, so that common lines come last. Texts
that share such a key and whose sizes allow it are candidates; each is verified on both whole sets.

First the sets of a key are compared with the key's ``CENTERS`` first ones only, and the links found are joined to components. Then, in the keys whose sets
still lie in different components, for each two components the pair that has the best chance is compared, and links are joined again. At last all other pairs
across components are compared. A pair that is left out is in one component already, so the components are those of all pairs. Of keys that the same sets
share, one is enough. Before sets are moved, a pair has to pass a bound: counts of a set's shingles in ``CELLS`` cells (a
histogram) limit how many it can have in common with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, cut, release
from .simhash import components, fingerprints_of, link, shingle_hashes

#: Similarity of near copies as a fraction.
PART, WHOLE = 4, 5
#: Bits that fingerprints linked by SimHash differ in at most.
TAU = 4
#: Rows and bytes of this module's batches.
BATCH = 4096, 1 << 22
#: Buckets of shingles whose counts give the order by rarity (a power of two).
BUCKETS = 1 << 18
#: Bits that tell which texts are needed (a power of two).
BITMAP = 1 << 25
#: Sets of a key that all its sets are compared with at first.
CENTERS = 1
#: Cells of a set's histogram, and the count at which a cell is full and sets no bound.
CELLS, FULL = 256, 255
#: Sets of one key that one task compares with each other; larger keys are dealt to more tasks by pairs of blocks.
BLOCK = 4096
#: Links that one task joins to components in memory; more are joined in rounds on all executors.
DIRECT = 1 << 18


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def _name(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42)


def histogram(s: np.ndarray) -> bytes:
    """Counts of a set's members in each cell."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS), FULL).astype(np.uint8).tobytes()


def _row(docs: DataFrame) -> Column:
    """A digest of all columns."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))


def survey(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (row, doc_id, text): (row, doc_id, node, n, cells, fp), where node names the set of the text's n shingles, cells is its histogram and fp its fingerprint;
    and, with a null row, (node, n): how many shingles of a task's sets fall in bucket ``node``."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            sets = [shingle_set(t, k) for t in column(b, "text")]
            for s in sets:
                np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            nodes = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            fp = fingerprints_of(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([histogram(s) for s in sets], pa.binary()), pa.array(fp)], names=names)
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(at), pa.array(total[at]), pa.nulls(len(at), pa.binary()), none], names=names)

    names = ["row", "doc_id", "node", "n", "cells", "fp"]
    return rows.mapInArrow(run, "row long, doc_id long, node long, n long, cells binary, fp long")


def rarity(surveyed: DataFrame) -> np.ndarray:
    """How many shingles of all texts' sets fall in each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    found = surveyed.filter("row is null").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    out[found["node"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(shared, k: int):
    """The keys of each text, once in a task for each set."""

    def run(batches):
        counts, seen = shared.value, set()
        for b in batches:
            texts = column(b, "text")
            for i in range(0, len(texts), 256):
                keys, nodes, sizes, firsts = [], [], [], []
                for t in texts[i : i + 256]:
                    s = shingle_set(t, k)
                    node = _name(s)
                    if node in seen or not len(s):
                        continue
                    seen.add(node)
                    first = len(s) - -(-PART * len(s) // WHOLE) + 1
                    order = np.lexsort((s, counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                    keys.append(s[order[:first]])
                    nodes.append(node), sizes.append(len(s)), firsts.append(first)
                if keys:
                    node = np.repeat(np.array(nodes, np.uint64).view(np.int64), firsts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int64), firsts))], names=["key", "node", "n"])

    return run


def _stars():
    """Rows sorted by (key, node): the candidates (a, b) of each set with the first sets of its key, and (node, null, key, n) for all rows of keys in
    which other pairs are left."""
    names = ["a", "b", "key", "n"]

    def settle(key, node, n, first, goes_on):
        """Rows of whole keys; only the first key may have begun before (``first`` are its centers) and only the last may go on."""
        new = np.r_[True, key[1:] != key[:-1]]
        run_id, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.bincount(run_id)
        more = size > CENTERS + 1
        if goes_on:
            more[-1] = True
        if first:
            more[0] = True
        many = more[run_id]
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[many]), pa.nulls(int(many.sum()), pa.int64()), pa.array(key[many]), pa.array(n[many])], names=names)
        at = np.arange(len(key))
        for c in range(CENTERS):
            if first:  # the first key's centers are known
                center, size_c = np.full(len(key), first[c][0]), np.full(len(key), first[c][1])
                ok = run_id == 0
            else:
                center, size_c, ok = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            own = ~ok & (at > heads[run_id] + c)
            center[own], size_c[own] = node[heads[run_id[own]] + c], n[heads[run_id[own]] + c]
            ok |= own
            ok &= (WHOLE * np.minimum(n, size_c) >= PART * np.maximum(n, size_c)) & (node != center)
            if ok.any():
                pairs = np.unique(np.stack([np.maximum(node[ok], center[ok]), np.minimum(node[ok], center[ok])], 1), axis=0)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], names=names)

    def run(batches):
        held, first, last = None, None, None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(now[0]):
                continue
            # equal sets of several tasks stand side by side
            fresh = np.r_[(now[0][0], now[1][0]) != last, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])]
            last = now[0][-1], now[1][-1]
            now = [x[fresh] for x in now]
            if held is not None:
                if first and (not len(now[0]) or now[0][0] != held):  # the long key has ended
                    first = None if len(now[0]) else first
                if isinstance(held, list):
                    now = [np.concatenate(x) for x in zip(held, now)]
            key, node, n = now
            if not len(key):
                continue
            before = np.flatnonzero(key != key[-1])
            start = before[-1] + 1 if len(before) else 0
            if first and start == 0:  # all of it belongs to the long key
                yield from settle(key, node, n, first, True)
                held = key[-1]
                continue
            if start:
                yield from settle(key[:start], node[:start], n[:start], first, False)
                first = None
            if len(key) - start > BLOCK:
                first = [(node[start + c], n[start + c]) for c in range(CENTERS)]
                yield from settle(key[start:], node[start:], n[start:], None, True)
                held = key[-1]
            else:
                held = [x[start:] for x in (key, node, n)]
        if isinstance(held, list) and len(held[0]):
            yield from settle(*held, first, False)

    return run


def passes(n_a: np.ndarray, n_b: np.ndarray, most_common: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be near copies if they have at most so many members in common."""
    return (PART + WHOLE) * most_common >= PART * (n_a + n_b)


def _most_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound of common members from histograms (.., CELLS); none where a cell is full."""
    bound = np.minimum(a, b).sum(-1, dtype=np.int64)
    full = (a == FULL).any(-1) | (b == FULL).any(-1)
    return np.where(full, np.iinfo(np.int64).max // 16, bound)


def _cells(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, name)), np.uint8).reshape(-1, CELLS)


def _bounded(batches):
    """The pairs (a, b) that histograms allow."""
    for b in batches:
        ok = passes(*(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")), _most_common(_cells(b, "cells_a"), _cells(b, "cells_b")))
        yield b.select(["a", "b"]).filter(pa.array(ok))


def _chosen(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, text) of the rows with a wanted digest, and a few others: the low bits of wanted digests go to the executors as a bitmap of BITMAP bits."""
    low = F.col("row").bitwiseAND(F.lit(BITMAP - 1))
    bits = wanted.select(low.alias("low")).groupBy(F.shiftright("low", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("word"))
    near = rows.select("row", "text").withColumn("low", low).withColumn("at", F.shiftright("low", 6)).join(F.broadcast(bits), "at")  # at most BITMAP / 64 rows
    return near.filter(F.expr("(shiftrightunsigned(word, cast(low & 63 as int)) & 1L) = 1L")).select("row", "text")


def bounded(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that histograms allow; names has a row of each node."""
    named = lambda x: names.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))
    return pairs.distinct().join(named("a"), "a").join(named("b"), "b").mapInArrow(_bounded, "a long, b long")


def _shortened(s: np.ndarray, width: int) -> np.ndarray:
    """The leading ``width`` (2 or 8) bytes of a set's members. Members that become equal get a number each, so that two sets have as many members in common
    now as before, or more."""
    if width == 8:
        return s
    v = (s >> np.uint64(48)).astype(np.uint32)
    at = np.arange(len(v))
    begins = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], at, 0)) if len(v) else at
    return (v << np.uint32(16)) | np.minimum(at - begins, 65535).astype(np.uint32)


def compared(pairs: DataFrame, rows: DataFrame, names: DataFrame, k: int, width: int) -> DataFrame:
    """The pairs (a, b) of nodes that the leading bytes of their whole sets allow; with all 8 bytes, the pairs that have the similarity."""
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(names.select("node", "row"), "node"))

    def sets(batches):
        seen = set()  # a row that repeats is read once in a task
        for b in batches:
            fresh = [i for i, x in enumerate(b.column(0).to_pylist()) if not (x in seen or seen.add(x))]
            b = b.take(pa.array(fresh, pa.int64()))
            own = [(shingle_set(t, k) >> np.uint64(64 - 8 * width)).astype(f"<u{width}").tobytes() for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    def run(batches):
        for batch in batches:
            kept = []
            for both in zip(batch.column(2), batch.column(3)):
                x, y = (_shortened(np.frombuffer(v.as_buffer(), f"<u{width}").astype(np.uint64) << np.uint64(64 - 8 * width), width) for v in both)
                all_ = np.concatenate([x, y])
                all_.sort()
                kept.append(bool(passes(len(x), len(y), int((all_[1:] == all_[:-1]).sum()))))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    # both joins read the exchange that makes nodes distinct
    own = _chosen(rows, needed).join(needed, "row").select("node", "text").mapInArrow(sets, "node long, own binary").dropDuplicates(["node"])
    both = pairs.join(own.toDF("a", "set_a"), "a").join(own.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    links = cut(both.mapInArrow(run, "a long, b long"))
    del own, both
    release(rows.sparkSession)
    return links


def verified(pairs: DataFrame, rows: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have the similarity: a quarter of each set's bytes tells most others apart, so that few whole sets move."""
    return compared(compared(pairs, rows, names, k, 2), rows, names, k, 8)


def _across(best: bool):
    """Rows sorted by (center, i, j, key): pairs across components of one key, of sets in block i and in block j, that sizes and histograms allow; with ``best``,
    for each two components the one of highest bound. Keys of one center mostly hold the same sets: each pair comes out once for all of them."""

    def candidates(i, j, at, node, component, n, cells):
        """Arrays (higher node, lower node, lower component, higher component, chance)."""
        if i != j:
            x, y = np.flatnonzero(at == i), np.flatnonzero(at == j)
        else:
            x = y = np.arange(len(node))
        for a in range(0, len(x), 64):
            for b in range(0, len(y), 1024):
                p, q = x[a : a + 64], y[b : b + 1024]
                ok = (component[p][:, None] != component[q][None]) & (node[p][:, None] > node[q][None] if i == j else True)
                ok &= WHOLE * np.minimum(n[p][:, None], n[q][None]) >= PART * np.maximum(n[p][:, None], n[q][None])
                u, v = np.nonzero(ok)
                for c in range(0, len(u), 16384):
                    g, h = p[u[c : c + 16384]], q[v[c : c + 16384]]
                    common = _most_common(cells[g], cells[h])
                    good = passes(n[g], n[h], common)
                    if good.any():
                        g, h = g[good], h[good]
                        yield (
                            np.maximum(node[g], node[h]), np.minimum(node[g], node[h]), np.minimum(component[g], component[h]), np.maximum(component[g], component[h]),
                            common[good] / (n[g] + n[h]),
                        )

    def settled(found: list) -> list:
        """One entry without repeats."""
        a, b, low, high, chance = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((b, a, -chance, high, low)) if best else np.lexsort((b, a))
        one, two = (low[by], high[by]) if best else (a[by], b[by])
        first = by[np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]]
        return [tuple(c[first] for c in (a, b, low, high, chance))]

    def out(found: list):
        if found:
            a, b, *_ = settled(found)[0]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, found, kept = [], [], 0  # parts of the current key, candidates of the current center and blocks

        def close() -> list:
            at, node, component, n, cells = (np.concatenate([x[c] for x in held]) for c in range(4, 9))
            return list(candidates(held[0][1][0], held[0][2][0], at, node, component, n, cells))

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)] + [_cells(batch, "cells")]
            if not len(now[0]):
                continue
            new = np.r_[True, np.any([now[c][1:] != now[c][:-1] for c in range(4)], axis=0)]
            heads = np.flatnonzero(new)
            for s, e in zip(heads, np.r_[heads[1:], len(now[0])]):
                part = [x[s:e] for x in now]
                if held and any(held[0][c][0] != part[c][0] for c in range(4)):
                    fresh = close()
                    found += fresh
                    kept += sum(len(x[0]) for x in fresh)
                    if any(held[0][c][0] != part[c][0] for c in range(3)):
                        yield from out(found)
                        found, kept = [], 0
                    elif kept > 1 << 17:
                        found = settled(found)
                        kept = 0
                    held.clear()
                held.append(part)
        if held:
            yield from out(found + close())

    return run


def fingerprint_pairs(names: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes (node, fp) that SimHash links: nodes of one fingerprint with the smallest of them, and the smallest ones of linked fingerprints."""
    first = cut(names.groupBy("fp").agg(F.min("node").alias("first")))
    same = names.join(first, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    of = lambda x, y: first.select(F.col("fp").alias(x), F.col("first").alias(y))
    near = link(first, TAU).join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    bound_batches(names.sparkSession, *BATCH)  # link() has its own
    return same.unionByName(near)


def near_copies(rows: DataFrame, surveyed: DataFrame, k: int = 5) -> DataFrame:
    """(node, component) of the sets that have a near copy, but for the smallest of a component. rows: (row, text); surveyed: what survey() gives of them."""
    shared = rows.sparkSession.sparkContext.broadcast(rarity(surveyed))
    names = cut(surveyed.filter("row is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("fp").alias("fp")))
    alike = cut(fingerprint_pairs(names.select("node", "fp")))
    keys = rows.select("text").mapInArrow(_prefixes(shared, k), "key long, node long, n long")
    found = cut(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars(), "a long, b long, key long, n long"))
    del keys
    release(rows.sparkSession)
    # few sets share a key with another: only their histograms go on
    some = found.select("a", "b").unionByName(alike)
    names = cut(names.drop("fp").join(some.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct(), "node"))
    links = verified(cut(bounded(some.filter("b is not null"), names)), rows, names, k)
    members = found.filter("b is null").select("key", F.col("a").alias("node"), "n")
    marks = [F.count("*").alias("size"), F.min("node").alias("center"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")]
    one = members.groupBy("key").agg(*marks).groupBy("size", "center", "x1", "x2").agg(F.min("key").alias("key"))
    members = cut(members.join(one.select("key", "size", "center"), "key"))
    for best in (True, False):
        joined = components(links, most_direct=DIRECT)
        named = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spread = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
        left = named.join(spread, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK)).join(names.select("node", "cells"), "node")
        left = left.withColumn("at", F.expr("pmod(node, blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        left = left.select("center", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "key", "at", "node", "component", "n", "cells")
        apart = cut(left.repartition("center", "i", "j").sortWithinPartitions("center", "i", "j", "key").mapInArrow(_across(best), "a long, b long").distinct())
        if apart.isEmpty():
            return joined
        links = cut(links.unionByName(verified(apart, rows, names, k)).distinct())
    return components(links, most_direct=DIRECT)


def deduplicate(docs: DataFrame, k: int = 5) -> DataFrame:
    """Documents without near copies: of each component the row with the smallest doc_id stays, of several the one with the smallest digest of
    its columns; rows without a doc_id stay. Texts without words are copies of each other. Keeps the columns of docs."""
    bound_batches(docs.sparkSession, *BATCH)
    rows = docs.select(_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = cut(survey(rows, k))
    found = near_copies(rows, told, k)
    rows = told.filter("doc_id is not null").select("row", "doc_id", "node")
    # equal sets come together before components are looked up, so that a set of many rows is one row
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    kept = first.join(found, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row"))
    named = docs.withColumn("_row", _row(docs)).withColumn("_id", F.col("doc_id").cast("long"))
    one = named.filter("doc_id is not null").join(kept, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"])
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))

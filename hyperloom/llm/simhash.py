"""SimHash near-duplicates: fingerprints, links at a Hamming distance, connected components.

Pairs within distance ``tau`` are found by the general pigeonhole principle. The 64 bits are
dealt into partitions that keep correlated bits together; a dynamic programme gives every
partition its own threshold T (sum of T+1 over partitions = tau+1, T = -1 skips one) at the least
estimated number of keys and candidates. A partition with threshold T is probed with all its values
within distance ceil(T/2): two fingerprints that differ there in T bits share a value. Candidates
that share a key are verified on all 64 bits.

A key that more than ``most_per_key`` fingerprints share is searched breadth-first: each member once takes its unvisited neighbours within tau out
of the key, so a dense group costs little more than its outliers, and only the links of a spanning forest come out. That takes place in memory and so up
to ``most_direct`` fingerprints; those of a larger key are linked through the values within distance tau/2 of each (fingerprints around one value lie within
tau of each other, and any two within tau share such a value), which is linear and spread over all tasks. Keys that a share of the fingerprints
shows to be that large are not dealt to one task in the first place. All ways are exact; nothing is dropped.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, cut, pieces

BITS = 64
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, k: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles; fewer words: of the whole sequence; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII white space and case only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(k)))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """One unsigned 64-bit fingerprint per array of hashes: a bit is set if over half of them have it."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, ends = np.concatenate(hashes), np.cumsum(sizes)
    starts = ends - sizes
    # Eight bits at a time: byte lanes count up to 255 hashes without overflow.
    blocks = np.concatenate([np.arange(starts[i], ends[i], 255) for i in full])
    first = np.concatenate([[0], np.cumsum(-(-sizes[full] // 255))[:-1]])
    ones = np.zeros((len(full), BITS), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _LANES, blocks)
        counts = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[:, bit::8] = np.add.reduceat(counts, first, axis=0)
    bits = (2 * ones > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(texts: list, k: int = 4) -> np.ndarray:
    """The fingerprint of each text's shingles, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in pieces(texts):
        out[a:b] = fingerprints_of([shingle_hashes(t, k) for t in texts[a:b]])
    return out


def with_fingerprint(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp signed long) of every document; null and empty texts have fingerprint 0."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = fingerprints(column(b, "text"), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- plan: partitions of bits and thresholds


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 matrix: how many fingerprints have bits i and j set. Summed on executors; 4096 rows reach the driver."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * BITS + j), pa.array(total[i, j])], names=["cell", "n"])

    out = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of about equal width; a partition grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for g in range(m):
        width = len(left) // (m - g)
        seed = max(sorted(left), key=lambda b: abs(p[b] - 0.5))  # the most skewed bits stay together
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(groups: list[list[int]], both: np.ndarray, n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds of least cost (keys emitted plus estimated candidates, of which twenty cost as much as a key) by dynamic programming."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    tables = []
    for g in groups:
        dist = np.array([1.0])
        for b in g:  # how many bits of the partition two fingerprints differ in
            dist = np.convolve(dist, [1 - differ[b], differ[b]])
        within, cost = np.cumsum(dist), {-1: 0.0}
        for t in range(tau + 1):
            radius = ceil(t / 2)
            cost[t] = n * sum(comb(len(g), r) for r in range(radius + 1)) + 0.05 * n * n / 2 * within[min(2 * radius, len(g))]
        tables.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in tables:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, extra in cost.items():
                u = used + t + 1
                if u <= tau + 1 and (u not in step or c + extra < step[u][0]):
                    step[u] = (c + extra, [*ts, t])
        best = step
    return best.get(tau + 1, (float("inf"), []))


def plan_partitions(fps: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition; their number is the one of least cost."""
    both, n = bit_statistics(fps), fps.count()
    best = min(((*allocate(g := group_bits(both, n, m), both, n, tau), g) for m in range(1, tau + 2)), key=lambda x: x[0])
    return [(g, t) for g, t in zip(best[2], best[1]) if t >= 0]


# ---- probe and verify


def ball(bits: list[int], radius: int) -> np.ndarray:
    """XOR masks of at most ``radius`` of the given bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return np.array(masks, np.uint64)


def _keys(parts: list[tuple[list[int], int]]):
    """(number, mask, flips) of each partition: a fingerprint's keys are its masked bits, flipped within the radius."""
    return [(i, np.uint64(sum(1 << b for b in bits)), ball(bits, ceil(t / 2))) for i, (bits, t) in enumerate(parts)]


def _emit(parts: list[tuple[list[int], int]], hot: dict[int, np.ndarray] | None = None):
    """(part, key, fp) of each fingerprint, without the keys that are known to be hot."""
    made = _keys(parts)

    def run(batches):
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for a in range(0, len(every), 256):
                fp = every[a : a + 256]
                for i, mask, flips in made:
                    key, own = ((fp & mask)[:, None] ^ flips[None, :]).ravel(), np.repeat(fp, len(flips))
                    if hot and i in hot:
                        cool = ~np.isin(key, hot[i])
                        key, own = key[cool], own[cool]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int8)), pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], names=["part", "key", "fp"])

    return run


def _in_hot(parts: list[tuple[list[int], int]], hot: dict[int, np.ndarray]):
    """The fingerprints that have a hot key."""
    made = [x for x in _keys(parts) if x[0] in hot]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found = np.zeros(len(fp), bool)
            for i, mask, flips in made:
                for flip in flips:
                    found |= np.isin((fp & mask) ^ flip, hot[i])
            yield _edges(fp[found].view(np.int64), None)

    return run


def hot_keys(fps: DataFrame, parts: list[tuple[list[int], int]], most: int, share: int) -> dict[int, np.ndarray]:
    """Keys of more than ``most`` fingerprints as far as one fingerprint in ``share`` shows; at most keys / most of them. Only the plan depends on it."""
    some = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).mapInArrow(_emit(parts), _KEY)
    rows = some.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") * share > most).collect()
    return {i: np.array([r.key for r in rows if r.part == i], np.int64).view(np.uint64) for i in {r.part for r in rows}}


_KEY, _EDGE = "part byte, key long, fp long", "a long, b long"


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], names=["a", "b"])


def forest(fp: np.ndarray, tau: int, most_cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within tau, one fewer than members in each component, that join all of the distinct values which lie within tau."""
    left, a, b, width = fp, [], [], 1

    def near(some):
        return np.bitwise_count(some[:, None] ^ left[None, :]) <= tau

    while len(left) > 1:
        # values without a neighbour go in blocks, as long as there are no others
        block = left[: max(1, min(width, most_cells // len(left)))]
        alone = near(block).sum(1) == 1
        if alone.all():
            left, width = left[len(block) :], min(256, 2 * width)
            continue
        seed, width = int(alone.argmin()), 1
        front = left[seed : seed + 1]
        left = left[seed + 1 :]
        while len(front) and len(left):
            block = front[: max(1, min(64, most_cells // len(left)))]
            front = front[len(block) :]
            close = near(block)
            hit = close.any(0)
            if hit.any():
                a.append(left[hit])
                b.append(block[close[:, hit].argmax(0)])
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _verify(tau: int, most: int, most_direct: int):
    """Rows sorted by (part, key): links (a, b) between the fingerprints of one key, or (fp, null) for those of a key with over ``most_direct``."""

    def settle(part, key, fp):
        n = len(key)
        new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        run_id = np.cumsum(new) - 1
        size = np.bincount(run_id)
        many = size[run_id] > most
        at = np.flatnonzero(~many & (size[run_id] > 1))
        for d in range(1, most):
            at = at[at + d < n]
            at = at[run_id[at + d] == run_id[at]]
            if not len(at):
                break
            ok = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= tau]
            if len(ok):
                yield _edges(fp[ok].view(np.int64), fp[ok + d].view(np.int64))
        heads = np.flatnonzero(new)
        for r in np.flatnonzero(size > most):
            a, b = forest(fp[heads[r] : heads[r] + size[r]], tau)
            yield _edges(a.view(np.int64), b.view(np.int64))

    def run(batches):
        held, hot_key = None, None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now[2] = now[2].astype(np.int64).view(np.uint64)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            part, key, fp = now
            if hot_key is not None:  # the rest of a key that was already found to be too large
                more = (part == hot_key[0]) & (key == hot_key[1])
                if more.any():
                    yield _edges(fp[more].view(np.int64), None)
                    part, key, fp = (x[~more] for x in (part, key, fp))
            if not len(key):
                held = None
                continue
            hot_key = None
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            start = last[-1] + 1 if len(last) else 0
            if len(key) - start > most_direct:
                hot_key = (part[-1], key[-1])
                yield _edges(fp[start:].view(np.int64), None)
                held = None
            else:
                held = [x[start:] for x in (part, key, fp)]
            if start:
                yield from settle(part[:start], key[:start], fp[:start])
        if held is not None and len(held[1]):
            yield from settle(*held)

    return run


def link(fps: DataFrame, tau: int = 4, most_per_key: int = 32, most_direct: int = 1 << 18, share: int = 1024) -> DataFrame:
    """Links (a > b) between distinct fingerprints (a column fp) within distance tau.

    Every pair within tau is joined by a link or, in crowded keys, by a chain of links that all hold.
    """
    spark = fps.sparkSession
    bound_batches(spark, 16384)
    fps = fps.select("fp")
    parts = plan_partitions(fps, tau)
    hot = hot_keys(fps, parts, most_direct, share)
    keys = fps.mapInArrow(_emit(parts, hot), _KEY).repartition("part", "key").sortWithinPartitions("part", "key")
    found = keys.mapInArrow(_verify(tau, most_per_key, most_direct), _EDGE)
    if hot:
        found = found.unionByName(fps.mapInArrow(_in_hot(parts, hot), _EDGE))
    found = cut(found.distinct())
    links = found.filter("b is not null")
    large = found.filter("b is null").select(F.col("a").alias("fp"))
    if not large.isEmpty():
        around = large.mapInArrow(_emit([(list(range(BITS)), tau)]), _KEY).select("key", "fp")
        centre = around.groupBy("key").agg(F.min("fp").alias("b"))
        links = links.unionByName(around.join(centre, "key").select(F.col("fp").alias("a"), "b").filter("a <> b"))
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of links (u, v), and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[one] != root[two]).any():
        one, two = one[apart], two[apart]
        x, y = root[one], root[two]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def _lowest(batches):
    """All links (u, v), in one task: (node, component) of the nodes that are not the smallest of theirs."""
    held = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches]
    if held:
        node, component = lowest(*(np.concatenate(x) for x in zip(*held)))
        linked = node != component
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(component[linked])], names=["node", "component"])


def components(links: DataFrame, most_rounds: int = 60, most_direct: int = 0) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for nodes that have one.

    Alternates large-star and small-star steps on the executors until nothing changes; each round is
    cut into the shared checkpoint folder. At most ``most_direct`` distinct links are joined by one task in memory instead: a round
    costs a dozen stages, however few its links are.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if most_direct and edges.count() <= most_direct:
        return cut(edges.coalesce(1).mapInArrow(_lowest, "node long, component long"))
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = cut(small.select(F.col("v").alias("x"), "m").union(small.select("u", "m")).filter("x <> m").distinct().toDF("u", "v"))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, k: int = 4, tau: int = 4, most_per_key: int = 32) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every document.

    Null and empty texts share fingerprint zero and are linked like any other. Repeated rows each
    return a row. A component has the smallest non-null doc_id reachable (null if it has none); rows without a doc_id link others all the same.
    Columns of docs other than doc_id and text are not read. An empty table gives an empty result.
    """
    fps = cut(with_fingerprint(docs, k))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(link(reps, tau, most_per_key))  # nodes are fingerprints; a component's own one is no node
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    lowest = found.join(reps, found.node == reps.fp).groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = found.join(lowest, "component").select("node", "component_id")
    named = reps.join(linked, reps.fp == linked.node, "left").select(F.col("fp").alias("fp_"), F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(named, fps.fp == named.fp_).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

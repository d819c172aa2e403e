"""Grouping of nodes by distance and by paths: gaps, divergences, count matrices, symmetry tests, feature clustering."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WalkConfig
from ..functions.stats import chi2_sum_upper
from .walks import nth_path_count, path_length

# ---- distance


def close_nodes(counts: DataFrame, n_walks: DataFrame, config: WalkConfig) -> DataFrame:
    """(source, node) whose max_num_paths-th path is frequent enough: count >= N / (N eps^2 + 1)."""
    n = F.col("n_walks")
    return nth_path_count(counts, config.max_num_paths).join(n_walks, "source").filter(F.col("nth") >= n / (n * config.epsilon**2 + 1)).select("source", "node")


def close_by_time(times: DataFrame, theta_hit: float) -> DataFrame:
    """Legacy mode: nodes at an average truncated hitting time of at most theta_hit."""
    return times.filter(F.col("avg_tht") <= theta_hit).select("source", "node")


def distance_clusters(times: DataFrame, theta: Column | float, last_always_cluster: bool = False) -> DataFrame:
    """(source, node_type, node, avg_tht, grp, size, role): a group ends where the gap to the next node is theta or more; groups of one are SINGLE.

    The legacy variant (last_always_cluster) makes a cluster of the last group whatever its size.
    """
    order = Window.partitionBy("source", "node_type").orderBy("avg_tht", "node")
    gap = F.col("avg_tht") - F.lag("avg_tht").over(order)
    g = times.withColumn("_new", F.when(gap >= theta, 1).otherwise(0))
    g = g.withColumn("grp", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    g = g.withColumn("size", F.count("*").over(Window.partitionBy("source", "node_type", "grp")))
    last = F.col("grp") == F.max("grp").over(Window.partitionBy("source", "node_type"))
    single = (F.col("size") == 1) & ~(last & F.lit(last_always_cluster))
    return g.select("source", "node_type", "node", "avg_tht", "grp", "size", F.when(single, "SINGLE").otherwise("CLUSTER").alias("role"))


# ---- divergences of distributions (dist, key, p), pairwise by (a, b)


def average_distribution(p: DataFrame, q: DataFrame) -> DataFrame:
    """(pair, key, m): half the sum of two distributions (pair, key, p), keys of either."""
    j = p.alias("x").join(q.alias("y"), (F.col("x.pair") == F.col("y.pair")) & (F.col("x.key") == F.col("y.key")), "full_outer")
    return j.select(F.coalesce("x.pair", "y.pair").alias("pair"), F.coalesce("x.key", "y.key").alias("key"), ((F.coalesce("x.p", F.lit(0.0)) + F.coalesce("y.p", F.lit(0.0))) / 2).alias("m"))


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """(pair, kl): sum of p ln(p / q) over keys of both with p > 0; the two change places where q has fewer keys."""
    sizes = p.groupBy("pair").agg(F.count("*").alias("np")).join(q.groupBy("pair").agg(F.count("*").alias("nq")), "pair")
    j = p.select("pair", "key", "p").join(q.select("pair", "key", F.col("p").alias("q")), ["pair", "key"]).join(sizes, "pair")
    swap = F.col("nq") < F.col("np")
    a, b = F.when(swap, F.col("q")).otherwise(F.col("p")), F.when(swap, F.col("p")).otherwise(F.col("q"))
    term = F.when((a > 0) & (b > 0), a * F.log(F.when((a > 0) & (b > 0), a / b)))
    return sizes.select("pair").join(j.groupBy("pair").agg(F.sum(term).alias("kl")), "pair", "left").select("pair", F.coalesce("kl", F.lit(0.0)).alias("kl"))


def sk_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """(pair, sk): half of KL(p, m) + KL(q, m) against the average m."""
    m = average_distribution(p, q).withColumnRenamed("m", "p")
    a, b = kl_divergence(p, m).withColumnRenamed("kl", "a"), kl_divergence(q, m).withColumnRenamed("kl", "b")
    return a.join(b, "pair", "full_outer").select("pair", ((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / 2).alias("sk"))


def _kl(p: dict, q: dict) -> float:
    if len(q) < len(p):
        p, q = q, p
    return sum(v * np.log(v / q[k]) for k, v in p.items() if v > 0 and q.get(k, 0) > 0)


def sk_of(p: dict, q: dict) -> tuple[float, dict]:
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {**p, **q}}
    return (_kl(p, m) + _kl(q, m)) / 2, m


def sk_threshold(m: dict, top: int, n_walks: int, alpha: float) -> float:
    """Upper alpha-quantile of the divergence of two samples of one distribution: weights (1 - m_i) / N of chi-squared variables, for the top m_i."""
    w = tuple(max(0.0, 1 - x) for x in sorted(m.values(), reverse=True)[: min(len(m), top)])
    return _unit_quantile(w, alpha) / n_walks


def sk_thresholds(average: DataFrame, top: int, n_walks: int, alpha: float) -> DataFrame:
    """(pair, threshold) of average distributions (pair, key, m); only the top shares of a pair are gathered."""
    best = average.withColumn("r", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("m"), "key"))).filter(F.col("r") <= top)

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"pair": pdf.pair, "threshold": [float(sk_threshold(dict(enumerate(m)), top, n_walks, alpha)) for m in pdf.m]})

    return best.groupBy("pair").agg(F.sort_array(F.collect_list("m"), asc=False).alias("m")).mapInPandas(run, "pair string, threshold double")


@lru_cache(maxsize=100_000)
def _unit_quantile(weights: tuple[float, ...], alpha: float) -> float:
    return chi2_sum_upper(alpha, np.array(weights), np.ones(len(weights)))


@lru_cache(maxsize=50_000)
def _divergence_below(a: tuple, b: tuple, n_walks: int, top: int, alpha: float, fixed: float | None) -> float:
    """The divergence of two groups, given as shares (path, p), if it is under its threshold, else infinity."""
    d, m = sk_of(dict(a), dict(b))
    # no quantile lies beyond the mean over alpha
    far = fixed is None and d * alpha >= sum(max(0.0, 1 - x) for x in m.values()) / n_walks
    return np.inf if far or d >= (fixed if fixed is not None else sk_threshold(m, top, n_walks, alpha)) else d


def merge_by_divergence(counts: dict[str, dict], n_walks: int, top: int, alpha: float, fixed: float | None = None) -> list[list[str]]:
    """Merge the pair of least divergence below its threshold again and again; the first pair wins ties. Shares divide by walks times cluster size.

    Divergences stand in a table of which a merge changes one row; they depend on shares only, so nodes of equal shares share them.
    """
    groups = [([n], dict(c)) for n, c in sorted(counts.items())]

    def shares(g) -> tuple:
        best = sorted(g[1].items(), key=lambda x: (-x[1], x[0]))[:top]
        return tuple((k, v / (n_walks * len(g[0]))) for k, v in best)

    own = [shares(g) for g in groups]
    table = np.full((len(groups), len(groups)), np.inf)
    alive = list(range(len(groups)))
    for i in alive:
        for j in alive[i + 1 :]:
            table[i, j] = _divergence_below(own[i], own[j], n_walks, top, alpha, fixed)
    while len(alive) > 1:
        i, j = divmod(int(table.argmin()), len(groups))
        if table[i, j] == np.inf:
            break
        merged = dict(groups[i][1])
        for k, v in groups[j][1].items():
            merged[k] = merged.get(k, 0) + v
        groups[i] = (groups[i][0] + groups[j][0], merged)
        alive.remove(j)
        table[j], table[:, j] = np.inf, np.inf
        own[i] = shares(groups[i])
        for h in alive:
            if h != i:
                x, y = min(h, i), max(h, i)
                table[x, y] = _divergence_below(own[x], own[y], n_walks, top, alpha, fixed)
    return [groups[i][0] for i in alive]


# ---- count matrices


def path_count_matrix(counts: DataFrame, k: int, length: int) -> DataFrame:
    """(source, grp, path, node, cnt): paths of one length in any member's own top k, for all members of the group; a path outside a
    member's own top k counts 0. counts has a column grp."""
    c = counts.filter(path_length(F.col("path")) == length)
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("source", "grp", "node").orderBy(F.desc("cnt"), "path"))).filter(F.col("r") <= k).drop("r")
    paths, members = top.select("source", "grp", "path").distinct(), counts.select("source", "grp", "node").distinct()
    dense = paths.join(members, ["source", "grp"])  # within a group; a group's paths are at most k times its members
    return dense.join(top.select("source", "grp", "path", "node", "cnt"), ["source", "grp", "path", "node"], "left").select("source", "grp", "path", "node", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def null_counts(matrix: DataFrame, n_walks: DataFrame) -> DataFrame:
    """(source, grp, node, cnt): walks that took none of the matrix's paths."""
    return matrix.groupBy("source", "grp", "node").agg(F.sum("cnt").alias("s")).join(n_walks, "source").select("source", "grp", "node", (F.col("n_walks") - F.col("s")).alias("cnt"))


def mean_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("source", "grp", "path").agg(F.avg("cnt").alias("mean"), F.count("*").alias("v"))


def covariance(matrix: DataFrame, n_walks: DataFrame) -> DataFrame:
    """(source, grp, i, j, cov): N (1 - 1/V) (diag(c/N) - c c' / N^2) of the mean counts c."""
    m = mean_counts(matrix).join(n_walks, "source")
    a = m.select("source", "grp", F.col("path").alias("i"), F.col("mean").alias("a"), "v", "n_walks")
    b = m.select("source", "grp", F.col("path").alias("j"), F.col("mean").alias("b"))
    n, v = F.col("n_walks"), F.col("v")
    return a.join(b, ["source", "grp"]).select("source", "grp", "i", "j", (n * (1 - 1 / v) * (F.when(F.col("i") == F.col("j"), F.col("a") / n).otherwise(F.lit(0.0)) - F.col("a") * F.col("b") / (n * n))).alias("cov"))


def q_statistic(matrix: DataFrame) -> DataFrame:
    """(source, grp, q): sum of squared deviations of counts from their path's mean."""
    j = matrix.join(mean_counts(matrix), ["source", "grp", "path"])
    return j.groupBy("source", "grp").agg(F.sum(F.pow(F.col("mean") - F.col("cnt"), 2)).alias("q"))


def standardised(matrix: DataFrame) -> DataFrame:
    """(x - mean) / mean per path; paths of mean 0 give 0."""
    w = Window.partitionBy("source", "grp", "path")
    return matrix.select("source", "grp", "path", "node", F.when(F.avg("cnt").over(w) > 0, (F.col("cnt") - F.avg("cnt").over(w)) / F.avg("cnt").over(w)).otherwise(F.lit(0.0)).alias("z"))


def critical_value(c: np.ndarray, n_walks: int, alpha: float) -> float:
    """Upper alpha-quantile of Q for a paths x nodes matrix, its null row included. The order of paths doesn't matter, so equal sums share it."""
    p, v = c.shape
    if v < 2 or p == 0:
        return 0.0
    return _critical(tuple(sorted(c.sum(1).tolist())), v, n_walks, alpha)


@lru_cache(maxsize=100_000)
def _critical(sums: tuple[float, ...], v: int, n_walks: int, alpha: float) -> float:
    mean = np.array(sums) / v
    cov = n_walks * (1 - 1 / v) * (np.diag(mean / n_walks) - np.outer(mean, mean) / n_walks**2)
    lam = np.linalg.eigvalsh(cov)
    return chi2_sum_upper(alpha, np.maximum(lam, 0), np.full(len(lam), v))


def matrix_of(counts: dict[str, dict], k: int, length: int) -> np.ndarray | None:
    """Paths x nodes (sorted); None if no path has this length."""
    top = {n: sorted(((p, x) for p, x in c.items() if p.count(",") == length), key=lambda x: (-x[1], x[0]))[:k] for n, c in counts.items()}
    paths, nodes = sorted({p for t in top.values() for p, _ in t}), sorted(counts)
    if not paths:
        return None
    own = {n: dict(t) for n, t in top.items()}
    return np.array([[own[n].get(p, 0) for n in nodes] for p in paths], float)


def is_symmetric(counts: dict[str, dict], n_walks: int, k: int, length: int, alpha: float) -> bool:
    """The longest length that has paths decides; one node always is symmetric."""
    if len(counts) < 2:
        return True
    for step in range(length, 0, -1):
        c = matrix_of(counts, k, step)
        if c is not None:
            full = np.vstack([c, n_walks - c.sum(0)])
            q = ((full - full.mean(1, keepdims=True)) ** 2).sum()
            return bool(q <= critical_value(full, n_walks, alpha))
    return True


#: What is kept of groups of at most so many nodes: results of counts that differ in the names of their nodes only.
KEPT_NODES, KEPT = 32, 10_000


class by_position:
    """f(counts, *more) -> a tuple over the nodes in order, worked out once for all groups of a process whose nodes, in order, have equal counts."""

    def __init__(self, f):
        self.f, self.kept = f, {}

    def __getstate__(self):
        return {"f": self.f, "kept": {}}

    def __call__(self, counts: dict[str, dict], *more) -> tuple:
        rows = tuple(tuple(sorted(counts[n].items())) for n in sorted(counts))
        if (rows, more) not in self.kept:
            found = self.f({i: dict(r) for i, r in enumerate(rows)}, *more)
            if len(rows) > KEPT_NODES:
                return found
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[rows, more] = found
        return self.kept[rows, more]


def parts_by_position(f):
    """The same for f(counts, *more) -> a list of lists of nodes."""
    at = by_position(f)

    def run(counts: dict[str, dict], *more) -> list[list[str]]:
        nodes = sorted(counts)
        return [[nodes[i] for i in part] for part in at(counts, *more)]

    return run


def all_symmetric(tests) -> bool:
    """The quality of a clustering: every cluster passes its test."""
    return all(tests)


def pca(x: np.ndarray, dim: int) -> np.ndarray:
    """Rows reduced to dim columns by SVD, if they have more; the sign of each is that of its largest entry."""
    if x.shape[1] <= dim:
        return x
    y = x - x.mean(0)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    out = u[:, :dim] * s[:dim]
    return out * np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])] + 1e-300)


#: A subcluster takes a row if its radius stays within THRESHOLD; a node of the tree has at most BRANCHING entries; a tree of more than MOST_LEAVES
#: subclusters is built again with twice the threshold, so that what follows stays bounded.
THRESHOLD, BRANCHING, MOST_LEAVES = 0.05, 50, 2000


class _Entry:
    """A clustering feature: how many rows, their sum and the sum of their squares; below it a node, or the rows."""

    __slots__ = ("n", "total", "square", "child", "rows")

    def __init__(self, n=0, total=0.0, square=0.0, child=None, rows=None):
        self.n, self.total, self.square, self.child, self.rows = n, total, square, child, rows

    @property
    def centre(self):
        return self.total / self.n

    def add(self, other) -> None:
        self.n, self.total, self.square = self.n + other.n, self.total + other.total, self.square + other.square

    def radius_with(self, other) -> float:
        n, total, square = self.n + other.n, self.total + other.total, self.square + other.square
        return float(np.sqrt(max(0.0, square / n - (total / n) @ (total / n))))


def _nearest(entries: list, centre: np.ndarray) -> int:
    return int(((np.array([e.centre for e in entries]) - centre) ** 2).sum(1).argmin())


def _insert(entries: list, new: _Entry, threshold: float) -> list | None:
    """Insert into a node; the two entries that replace it if it has to split."""
    if entries and entries[0].child is not None:
        at = entries[_nearest(entries, new.centre)]
        halves = _insert(at.child, new, threshold)
        if halves is None:
            at.add(new)
            return None
        entries.remove(at)
        entries += halves
    else:
        if entries and (at := entries[_nearest(entries, new.centre)]).radius_with(new) <= threshold:
            at.add(new)
            at.rows += new.rows
            return None
        entries.append(new)
    if len(entries) <= BRANCHING:
        return None
    c = np.array([e.centre for e in entries])
    apart = ((c[:, None] - c[None]) ** 2).sum(-1)
    i, j = np.unravel_index(apart.argmax(), apart.shape)
    sides = apart[i] < apart[j]
    sides[i] = True
    out = []
    for side in (True, False):
        part = [e for e, s in zip(entries, sides) if s == side]
        whole = _Entry(0, np.zeros_like(part[0].total), 0.0, part)
        for e in part:
            whole.add(e)
        out.append(whole)
    return out


def subclusters(x: np.ndarray, threshold: float = THRESHOLD, most: int = MOST_LEAVES) -> list[list[int]]:
    """Rows of each subcluster of a clustering-feature tree."""
    while True:
        root: list = []
        for i, r in enumerate(x):
            halves = _insert(root, _Entry(1, r, float(r @ r), None, [i]), threshold)
            if halves:
                root = halves
        leaves, todo = [], list(root)
        while todo:
            e = todo.pop()
            if e.child is None:
                leaves.append(e.rows)
            else:
                todo += e.child
        if len(leaves) <= most:
            return sorted(leaves)
        threshold *= 2


def ward_tree(centres: np.ndarray) -> list[tuple[int, int]]:
    """Merges of least growth of variance, in order: merge t joins two of the clusters 0 .. m - 1 (rows) or m + an earlier merge. Nearest-neighbour chains, so
    quadratic in the rows."""
    m = len(centres)
    d = ((centres[:, None] - centres[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    n, alive, chain, found = np.ones(m), np.ones(m, bool), [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        height = d[a, b]
        new = ((n + n[a]) * d[a] + (n + n[b]) * d[b] - n * height) / (n + n[a] + n[b])
        new[~alive] = np.inf
        new[[a, b]] = np.inf
        alive[b] = False
        n[a] += n[b]
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        found.append((float(height), a, b))
    # chains find merges out of order: sort by height, then name clusters by their merges
    found.sort(key=lambda x: round(x[0], 12))
    name, out = list(range(m)), []
    own = list(range(m))

    def root(i: int) -> int:
        while own[i] != i:
            i = own[i]
        return i

    for t, (_, a, b) in enumerate(found):
        ra, rb = root(a), root(b)
        out.append((name[ra], name[rb]))
        own[max(ra, rb)] = min(ra, rb)
        name[min(ra, rb)] = m + t
    return out


def birch_levels(x: np.ndarray, threshold: float = THRESHOLD):
    """For k = 2, 3, ... the clusters (lists of rows) that Birch with k global clusters gives, as {name: rows}; names last as long as a cluster does."""
    leaves = subclusters(x, threshold)
    tree = ward_tree(np.array([x[rows].mean(0) for rows in leaves]))
    m = len(leaves)
    rows = {i: r for i, r in enumerate(leaves)}
    for t, (a, b) in enumerate(tree):
        rows[m + t] = rows[a] + rows[b]
    first = {c: min(r) for c, r in rows.items()}
    now = {m + len(tree) - 1} if tree else {0}
    for t in range(len(tree) - 1, -1, -1):
        now = now - {m + t} | set(tree[t])
        yield {c: rows[c] for c in sorted(now, key=first.get)}
    while True:  # no more subclusters to tell apart
        yield {c: rows[c] for c in sorted(now, key=first.get)}


def ward(x: np.ndarray, k: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Labels of k clusters: Birch's tree of subclusters, then Ward's merges of their centres."""
    labels = np.zeros(len(x), int)
    if k >= 2:
        for _, clusters in zip(range(k - 1), birch_levels(x, threshold)):
            for at, members in enumerate(clusters.values()):
                labels[members] = at
    return labels


def features(counts: dict[str, dict], k: int, length: int, dim: int) -> np.ndarray:
    """Nodes x dim: standardised counts of all lengths, reduced."""
    blocks = [m for m in (matrix_of(counts, k, s) for s in range(1, length + 1)) if m is not None]
    if not blocks:
        return np.zeros((len(counts), 1))
    c = np.vstack(blocks)
    mean = c.mean(1, keepdims=True)
    return pca(np.divide(c - mean, mean, out=np.zeros_like(c), where=mean > 0).T, dim)


def split_by_features(counts: dict[str, dict], n_walks: int, config: WalkConfig, length: int) -> list[list[str]]:
    """The smallest number of clusters from 2 to V - 1 that all pass the symmetry test, else the last labels tried."""
    nodes = sorted(counts)
    x, found = features(counts, config.max_num_paths, length, config.pca_dim), {i: [i] for i in range(len(nodes))}
    known: dict[int, bool] = {}  # a cluster that outlives a split is tested once

    def passes(c: int, members: list[int]) -> bool:
        if c not in known:
            known[c] = is_symmetric({nodes[i]: counts[nodes[i]] for i in members}, n_walks, config.max_num_paths, length, config.alpha_sym)
        return known[c]

    last = None
    for _, found in zip(range(2, len(nodes)), birch_levels(x)):
        if list(found) == last or all_symmetric(passes(c, members) for c, members in found.items()):
            break
        last = list(found)
    return [[nodes[i] for i in sorted(members)] for members in found.values()]


def split_group(counts: dict[str, dict], n_walks: int, config: WalkConfig, length: int) -> list[list[str]]:
    """Path-symmetric clusters of one distance group: the group itself if it passes, else by divergence (small) or features (large)."""
    if len(counts) == 1 or is_symmetric(counts, n_walks, config.max_num_paths, length, config.alpha_sym):
        return [sorted(counts)]
    if len(counts) <= config.clustering_method_threshold:
        return merge_by_divergence(counts, n_walks, config.max_num_paths, config.alpha_sym, config.theta_js)
    return split_by_features(counts, n_walks, config, length)


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
#: Rows of a batch of results.
BATCH = 10_000


def each_group(rows: DataFrame, keys: list[str], f, schema: str, extra: list[str] | None = None) -> DataFrame:
    """(*keys, *schema) of f(counts, *extra) -> rows for each group of rows(*keys, node, path, cnt, *extra), counts being {node: {path: cnt}}.

    Groups are runs of sorted rows, cut from the stream of a task, as most are a few rows and a call of its own for each would cost far more than its work.
    A null path gives its node no counts; extra columns are equal within a group.
    """
    extra = extra or []
    k, kinds = len(keys), [c.split() for c in schema.split(", ")]
    given = rows.select(*keys, "node", "path", F.col("cnt").cast("long").alias("cnt"), *extra)
    fields = [(c, _ARROW[given.schema[c].dataType.simpleString().replace("bigint", "long")]) for c in keys] + [(c, _ARROW[t]) for c, t in kinds]
    out = pa.schema(fields)

    def batch(found: list):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found), fields)], schema=out)

    def run(batches):
        now, more, counts, found = None, (), {}, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:k] != now:
                    if counts:
                        found += [(*now, *r) for r in f(counts, *more)]
                        if len(found) >= BATCH:
                            yield batch(found)
                            found = []
                    now, more, counts = row[:k], row[k + 3 :], {}
                per = counts.setdefault(row[k], {})
                if row[k + 1] is not None:
                    per[row[k + 1]] = row[k + 2]
        if counts:
            found += [(*now, *r) for r in f(counts, *more)]
        if found:
            yield batch(found)

    return given.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in keys) + ", " + schema)


def path_clusters(groups: DataFrame, counts: DataFrame, n_walks: DataFrame, config: WalkConfig, length: int) -> DataFrame:
    """(source, node_type, grp, part, node): groups(source, node_type, grp, node) split by paths. A group is split where its own rows are."""
    rows = groups.select("source", "node_type", "grp", "node").join(counts, ["source", "node"], "left").join(n_walks, "source")
    split = parts_by_position(lambda c, n: split_group(c, n, config, length))

    def run(per: dict[str, dict], n: int):
        return [(i, node) for i, g in enumerate(split(per, n)) for node in g]

    return each_group(rows, ["source", "node_type", "grp"], run, "part long, node string", ["n_walks"])


def label_groups(parts: DataFrame) -> DataFrame:
    """parts with role: SINGLE for groups of one, else CLUSTER."""
    n = F.count("*").over(Window.partitionBy("source", "node_type", "grp", "part"))
    return parts.withColumn("role", F.when(n == 1, "SINGLE").otherwise("CLUSTER"))

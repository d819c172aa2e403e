"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

Counts of every token of every training document are made on the executors. The ``HEAD`` most frequent words are split by rank into
classes of ``CLASS`` words; P(word) = P(class | state) * P(word | class, state). Words up to rank
``KNOWN`` form one class and all further words, with one symbol for unseen ones, another; in these two a word has its smoothed share of the class's
counts. The end of a document is a class by itself. So the probabilities of all tokens sum to one.

The state is a GRU's. It is trained by truncated backpropagation through time (windows of
``SPAN`` tokens, state carried on) on executors. The training documents are dealt into ``ROUNDS`` parts by a digest, and each part into copies of about
``TOKENS_PER_COPY`` tokens (at most ``MOST_COPIES``, which then take more). In a round each copy of the weights reads its documents as a stream, ``CHUNK`` tokens in memory,
and the copies are averaged by tokens. So every training document is learnt from once, at any size of the input. Scoring carries the state through whole documents, many side by side.

Only ``KNOWN`` counts are sent to executors. Counts of all other words are met by a join on the word: each
document sends its rare words there and gets the sum of their log counts back.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, cut, pieces, release
from .langid import remainder

HEAD, CLASS, KNOWN, HIDDEN = 2048, 64, 65536, 16
SPAN, LANES, ROUNDS, CHUNK = 24, 512, 2, 1_000_000
TOKENS_PER_COPY, MOST_COPIES = 2_000_000, 4096
#: Distinct words that a counting task holds before it passes them on.
MOST_HELD = 300_000
#: Weights that travel together.
BLOCK = 2048
#: Words that a part of a band of equal counts holds, about.
EACH = 4096
#: The end of a document among the words; no word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words (runs without ASCII white space, A-Z in lower case) of a text, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c) over all rows of docs; the end counts once a document."""
    bound_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for t in column(b, "text"):
                held.update(tokens(t))
                held[END] += 1
                if len(held) > MOST_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Ranks, classes and log shares of the known words, the end and the rest.

    Ids: 0 .. HEAD-1 are words with their own output weights, then the known words without; ``end`` and ``rest`` are the last two.
    """

    def __init__(self, top: list[tuple[bytes, int]], n: int, v: int, end_count: int):
        known = [(w, c) for w, c in top if w != END]
        self.id = {w: i for i, (w, _) in enumerate(known)}
        self.n, self.v, self.head = n, v, min(HEAD, len(known))
        self.end, self.rest = len(known), len(known) + 1
        c = np.array([x for _, x in known], np.float64)
        self.count = np.r_[c, end_count, 0.0]
        self.total = n + 0.1 * (v + 1)
        self.base = np.log10((self.count + 0.1) / self.total)  # of the rest: not used, its counts come from the join
        self.groups = -(-self.head // CLASS) if self.head else 0
        self.middle, self.other, self.stop = self.groups, self.groups + 1, self.groups + 2
        self.cls = np.r_[np.arange(self.head) // CLASS, np.full(len(known) - self.head, self.middle), self.stop, self.other].astype(np.int64)
        mass = c + 0.1
        self.middle_mass = mass[self.head :].sum()
        # all other types, seen in training or not: the end is known even if no document was counted
        self.other_mass = max(n - c.sum() - end_count, 0) + 0.1 * (v + 1 - len(known) - (end_count > 0))
        self.within = np.zeros(len(known) + 2)
        self.within[self.head : len(known)] = np.log10(mass[self.head :] / self.middle_mass) if len(known) > self.head else 0
        #: Rows of the input table: each head word, then middle, rest and end (which also starts a document).
        self.row = np.r_[np.arange(self.head), np.full(len(known) - self.head, self.head), self.head + 2, self.head + 1].astype(np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.id.get, words, repeat(self.rest)), np.int64, len(words))


def initial_weights(voc: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k, c = HIDDEN, voc.groups + 3
    mass = np.zeros(c)
    np.add.at(mass, voc.cls[: voc.end], voc.count[: voc.end] + 0.1)
    mass[voc.other], mass[voc.stop] = voc.other_mass, voc.count[voc.end] + 0.1
    bias = np.full(max(1, voc.groups) * CLASS, -30.0)
    bias[: voc.head] = np.log(voc.count[: voc.head] + 0.1)
    w = {
        "x": rng.normal(0, 0.3, (voc.head + 3, 3 * k)), "u": rng.normal(0, 0.25, (k, 3 * k)), "b": np.zeros(3 * k),
        "co": rng.normal(0, 0.05, (k, c)), "cb": np.log(np.maximum(mass, 1e-12) / mass.sum()), "wo": rng.normal(0, 0.05, (max(1, voc.groups) * CLASS, k)), "wb": bias,
    }
    return {n: a.astype(np.float32) for n, a in w.items()}


def _sigmoid(a, negative: bool = False):
    """In place; ``negative``: of minus a."""
    if not negative:
        np.negative(a, out=a)
    with np.errstate(over="ignore"):  # far below zero it is zero
        np.exp(a, out=a)
    a += np.float32(1)
    return np.reciprocal(a, out=a)


def _capped(a):
    """Members of at most 60, so that sums of exponentials stay finite."""
    return np.minimum(a, 60, out=a) if a.max(initial=0) > 60 else a


def _softmax(a):
    """Shares of each row, in place. Rows are shifted by their largest member if any member is too large or too small for exp."""
    if a.max() > 60 or a.min() < -60:
        a -= a.max(1, keepdims=True)
    np.exp(a, out=a)
    a /= np.matmul(a, np.ones((a.shape[1], 1), a.dtype))  # cheaper than sums of short rows
    return a


def _by_class(voc: Vocabulary, ids: np.ndarray):
    """(class, places of its tokens) for the classes of words with their own weights."""
    own = np.flatnonzero(ids < voc.head)
    cls = voc.cls[ids[own]]
    order = own[np.argsort(cls.astype(np.int16), kind="stable")]
    bounds = np.r_[0, np.cumsum(np.bincount(cls, minlength=voc.groups))]
    for g in range(voc.groups):
        if bounds[g] < bounds[g + 1]:
            yield g, order[bounds[g] : bounds[g + 1]]


def log10_probability(w: dict, voc: Vocabulary, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log10 P(id | state) of each token, the rest's share of its class left out. states is (unit, token)."""
    y = np.matmul(w["co"].T, states)
    y += w["cb"][:, None]
    _capped(y)
    picked = y[voc.cls[ids], np.arange(len(ids))].astype(np.float64)
    np.exp(y, out=y)
    out = picked - np.log(y.sum(0).astype(np.float64))
    for g, at in _by_class(voc, ids):
        s = slice(g * CLASS, (g + 1) * CLASS)
        y = np.matmul(w["wo"][s], states.take(at, axis=1))
        y += w["wb"][s][:, None]
        _capped(y)
        picked = y[ids[at] - g * CLASS, np.arange(len(at))].astype(np.float64)
        np.exp(y, out=y)
        out[at] += picked - np.log(y.sum(0).astype(np.float64))
    out /= np.log(10)
    out += voc.within[ids]
    return out


def scoring_weights(w: dict) -> dict:
    """Weights as the scorer multiplies them: biases in the input table, signs of gates turned (a sigmoid takes the exponential of minus its input)."""
    sign = np.r_[np.full(2 * HIDDEN, -1), np.ones(HIDDEN)].astype(np.float32)
    u = w["u"] * sign
    return w | {"xb": np.ascontiguousarray((w["x"] + w["b"]) * sign), "uzr": np.ascontiguousarray(u[:, : 2 * HIDDEN].T), "uc": np.ascontiguousarray(u[:, 2 * HIDDEN :].T)}


def score_documents(w: dict, voc: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Sum of log10 probabilities of the tokens (ids, the end included) of each document, side by side, longest first."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    sizes = np.array([len(docs[i]) for i in order])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.empty(0, np.int64)
    rows = voc.row[flat]
    sums, k, start_row = np.zeros(len(docs)), HIDDEN, voc.head + 2
    places = np.arange(len(docs))
    h = np.zeros((k, len(docs)), np.float32)
    longest = int(sizes.max(initial=0))
    live = len(docs)
    for a in range(0, longest, SPAN):  # a window; the state goes on into the next
        states, at, lanes = [], [], []
        for t in range(a, min(a + SPAN, longest)):
            while sizes[live - 1] <= t:
                live -= 1
            if h.shape[1] > live:
                h = np.ascontiguousarray(h[:, :live])
            x = np.ascontiguousarray(w["xb"].take(rows[starts[:live] + t - 1] if t else np.full(live, start_row), axis=0).T)
            g = np.matmul(w["uzr"], h)
            g += x[: 2 * k]
            _sigmoid(g, negative=True)
            c = np.matmul(w["uc"], g[k:] * h)
            c += x[2 * k :]
            np.tanh(c, out=c)
            c -= h
            c *= g[:k]
            c += h
            h = c
            states.append(h)
            at.append(starts[:live] + t)
            lanes.append(places[:live])
        states, at, lanes = np.concatenate(states, 1), np.concatenate(at), np.concatenate(lanes)
        for x in range(0, len(at), 16384):
            p = log10_probability(w, voc, states[:, x : x + 16384], flat[at[x : x + 16384]])
            sums += np.bincount(lanes[x : x + 16384], p, len(docs))
    total = np.empty(len(docs))
    total[order] = sums
    return total


class Trainer:
    """A copy of the weights under truncated backpropagation through time with Adam. ``expected``: tokens that will be fed, which the rate falls over."""

    def __init__(self, w: dict, voc: Vocabulary, expected: float, rate: float = 0.02):
        self.w = {n: a.copy() for n, a in w.items()}
        self.m, self.v = ({n: np.zeros_like(a) for n, a in w.items()} for _ in range(2))
        self.voc, self.rate, self.expected, self.fed, self.steps = voc, rate, max(1.0, expected), 0, 0

    def feed(self, stream: np.ndarray) -> None:
        """Learn from a stream of token ids (documents end with the end), cut into lanes that run side by side."""
        w, voc, k = self.w, self.voc, HIDDEN
        lanes = max(1, min(LANES, len(stream) // (4 * SPAN)))
        length = -(-len(stream) // lanes)
        ids = np.full(lanes * length, voc.end)
        ids[: len(stream)] = stream
        ids = np.ascontiguousarray(ids.reshape(lanes, length).T)
        rows, fresh = np.empty_like(ids), np.ones(ids.shape, bool)
        fresh[1:] = ids[:-1] == voc.end
        rows[0], rows[1:] = voc.head + 2, np.where(fresh[1:], voc.head + 2, voc.row[ids[:-1]])
        h = np.zeros((lanes, k), np.float32)
        for a in range(0, length, SPAN):
            block, row, new = ids[a : a + SPAN], rows[a : a + SPAN], fresh[a : a + SPAN]
            steps = len(block)
            x = w["x"].take(row, axis=0)
            x += w["b"]
            states, kept = np.empty((steps, lanes, k), np.float32), []
            uzr, uc = w["u"][:, : 2 * k], w["u"][:, 2 * k :]
            for t in range(steps):
                h = np.where(new[t][:, None], np.float32(0), h)
                g = h @ uzr
                g += x[t, :, : 2 * k]
                _sigmoid(g)
                rh = g[:, k:] * h
                c = rh @ uc
                c += x[t, :, 2 * k :]
                np.tanh(c, out=c)
                kept.append((h, g, rh, c))
                h = h + g[:, :k] * (c - h)
                states[t] = h
            grad, ds = self._output(states.reshape(-1, k), block.ravel())
            ds = ds.reshape(steps, lanes, k)
            das, dh = np.empty((steps, lanes, 3 * k), np.float32), np.zeros((lanes, k), np.float32)
            for t in range(steps - 1, -1, -1):
                h0, g, rh, c = kept[t]
                z, r, da = g[:, :k], g[:, k:], das[t]
                dh += ds[t]
                dc = dh * z
                dc *= 1 - c * c
                drh = dc @ uc.T
                dzr = np.concatenate([dh * (c - h0), drh * h0], 1)
                dzr *= g
                dzr *= 1 - g
                da[:, : 2 * k], da[:, 2 * k :] = dzr, dc
                dh = dh * (1 - z)
                dh += drh * r
                dh += dzr @ uzr.T
                dh[new[t]] = 0
            flat = das.reshape(-1, 3 * k)
            past, past_r = np.concatenate([x[0] for x in kept]), np.concatenate([x[2] for x in kept])
            grad["u"] = np.concatenate([past.T @ flat[:, : 2 * k], past_r.T @ flat[:, 2 * k :]], 1)
            grad["b"] = flat.sum(0)
            grad["x"] = np.zeros_like(w["x"])
            by = np.argsort(row.ravel().astype(np.uint16 if voc.head < 60_000 else np.int64), kind="stable")
            hit = row.ravel()[by]
            heads = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]])
            grad["x"][hit[heads]] = np.add.reduceat(flat.take(by, axis=0), heads, axis=0)
            self._step(grad, self.rate * min(1.0, 2 * (1 - self.fed / self.expected) + 0.05))
            self.fed += block.size

    def _output(self, s: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the class-factored softmax and of the states."""
        w, voc, n = self.w, self.voc, len(y)
        p = s @ w["co"]
        p += w["cb"]
        _softmax(p)
        p[np.arange(n), voc.cls[y]] -= 1
        p /= n
        grad = {"co": s.T @ p, "cb": p.sum(0), "wo": np.zeros_like(w["wo"]), "wb": np.zeros_like(w["wb"])}
        ds = p @ w["co"].T
        for g, at in _by_class(voc, y):
            part, own = slice(g * CLASS, (g + 1) * CLASS), s.take(at, axis=0)
            q = own @ w["wo"][part].T
            q += w["wb"][part]
            _softmax(q)
            q[np.arange(len(at)), y[at] - g * CLASS] -= 1
            q /= n
            ds[at] += q @ w["wo"][part]
            grad["wo"][part], grad["wb"][part] = q.T @ own, q.sum(0)
        return grad, ds

    def _step(self, grad: dict, rate: float) -> None:
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())))
        if not np.isfinite(norm):
            return
        self.steps += 1
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        rate = np.float32(rate / (1 - 0.9**self.steps))
        slow = np.float32(1 / (1 - 0.99**self.steps))
        for name, g in grad.items():
            g *= scale
            m, v = self.m[name], self.v[name]
            m += np.float32(0.1) * (g - m)
            g *= g
            g -= v
            g *= np.float32(0.01)
            v += g
            np.multiply(v, slow, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= rate
            self.w[name] -= g


_NAMES = ("x", "u", "b", "co", "cb", "wo", "wb")


def pack(w: dict) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in _NAMES])


def unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for n in _NAMES:
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


class Model:
    def __init__(self, voc: Vocabulary, weights: dict):
        self.voc, self.weights = voc, weights


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words (all, if there are fewer) by falling count, then by XXH64 of the word.

    Counts are sorted into a few thousand bands first and whole bands taken from the top. Of the band that no longer fits, whole parts are taken: by
    count and leading bits of the word's digest, of some ``EACH`` words, so no task sends, and the driver holds, much more than the answer.
    """
    band = F.floor(F.log2("c") * 64)  # 64 bands per doubling of the count
    room, lowest, partial = most, None, None
    for r in counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        if r["count"] > room:
            partial = r
            break
        room -= r["count"]
        lowest = r.band
    chosen = F.lit(False) if lowest is None else band >= lowest
    if partial is not None and room:
        bits = max(0, (partial["count"] // EACH).bit_length())
        digest = F.expr(f"shiftrightunsigned(xxhash64(word), {64 - bits})") if bits else F.lit(0).cast("long")
        inside = counts.filter(band == partial.band)
        last = None
        for r in inside.groupBy("c", digest.alias("part")).count().orderBy(F.desc("c"), "part").collect():
            last = r
            room -= r["count"]
            if room <= 0:
                break
        chosen = chosen | ((band == partial.band) & ((F.col("c") > last.c) | ((F.col("c") == last.c) & (digest <= last.part))))
    found = counts.filter(chosen).select("word", "c", F.xxhash64("word").alias("digest")).toArrow()
    unsigned = found["digest"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.lexsort((unsigned, -found["c"].to_numpy()))[:most]
    words, c = found["word"].to_pylist(), found["c"].to_pylist()
    return [(words[i], c[i]) for i in by]


def copies(n_tokens: int) -> int:
    """Copies of the weights that a round trains."""
    return max(1, min(MOST_COPIES, round(n_tokens / ROUNDS / TOKENS_PER_COPY)))


def dealt(docs: DataFrame, n_tokens: int, part: int) -> DataFrame:
    """The texts of one of the parts, dealt to a partition for each copy of the weights. Parts and partitions go by a digest of row contents, and rows that
    repeat, or lack a doc_id, by their place in the input as well."""
    digest = F.xxhash64("doc_id", "text")
    own = docs.filter(F.pmod(digest, F.lit(ROUNDS)) == part)
    return own.repartition(copies(n_tokens), F.xxhash64(digest, F.pmod(F.monotonically_increasing_id(), F.lit(64)))).select("text")


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """Vocabulary and weights from training documents and their counts."""
    spark = docs.sparkSession
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    top = most_frequent(counts, KNOWN)
    voc = Vocabulary(top, n, v, ends)
    weights = initial_weights(voc)
    if not n:
        return Model(voc, weights)
    shared_voc, expected = spark.sparkContext.broadcast(voc), n / ROUNDS / copies(n)
    for part in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches):
            trainer, held, size, total = None, [], 0, 0
            for b in batches:
                for t in column(b, "text"):
                    if trainer is None:
                        trainer = Trainer(shared.value, shared_voc.value, expected)
                    own = trainer.voc
                    held.append(np.append(own.ids(tokens(t)), own.end))
                    size += len(held[-1])
                    if size >= CHUNK:
                        trainer.feed(np.concatenate(held))
                        total, held, size = total + size, [], 0
            if held:
                trainer.feed(np.concatenate(held))
                total += size
            if trainer:
                flat = (np.r_[pack(trainer.w), 1.0] * total).astype(np.float32)
                parts = [flat[x : x + BLOCK].tobytes() for x in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "values"])

        def summed(batches):
            sums: dict = {}
            for b in batches:
                for block, values in zip(b.column(0).to_pylist(), b.column(1)):
                    own = np.frombuffer(values.as_buffer(), np.float32)
                    sums[block] = sums[block] + own if block in sums else own.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "values"])

        made = dealt(docs, n, part).mapInArrow(run, "block int, values binary").repartition("block").mapInArrow(summed, "block int, values binary")
        rows = sorted(made.collect(), key=lambda r: r.block)  # the model, and the tokens
        if rows:
            flat = np.concatenate([np.frombuffer(r["values"], np.float64) for r in rows])
            weights = unpack(flat[:-1] / flat[-1], weights)
        del made
        release(spark)
    return Model(voc, weights)


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    spark = docs.sparkSession
    bound_batches(spark, 8192)  # many documents side by side; batches stay bounded by their bytes
    shared = spark.sparkContext.broadcast(Model(model.voc, scoring_weights(model.weights)))

    def run(batches):
        own = shared.value
        voc = own.voc
        for b in batches:
            keys, texts = b.column(0).to_pylist(), column(b, "text")
            for i, j in pieces(texts, 16_000_000):
                ids, rare = [], []
                for t in texts[i:j]:
                    words = tokens(t)
                    d = np.append(voc.ids(words), voc.end)
                    ids.append(d)
                    rare.append([words[p] for p in np.flatnonzero(d == voc.rest)])
                base = [float(voc.base[d[d != voc.rest]].sum()) for d in ids]
                lm = score_documents(own.weights, voc, ids)
                n = [len(d) for d in ids]
                known = [len(d) - len(r) - (voc.count[voc.end] == 0) for d, r in zip(ids, rare)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:j], pa.int64()), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(lm), pa.array(rare, pa.list_(pa.binary()))],
                    names=["row", "doc_id", "n", "known", "base", "lm", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = rows.mapInArrow(run, "row long, doc_id long, n long, known long, base double, lm double, rare array<binary>")
    # The document's own figures travel on its first row; a document without rare words joins nothing (no word holds a blank).
    each = told.select("row", "doc_id", "n", "known", "base", "lm", F.posexplode_outer("rare").alias("pos", "word"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    nothing = F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary")
    each = each.select("row", F.when(first, F.struct("doc_id", "n", "known", "base", "lm")).alias("own"), F.coalesce("word", nothing).alias("word"), F.col("word").isNotNull().alias("is_word"))
    joined = each.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    parts = joined.groupBy("row").agg(
        F.max("own").alias("own"), F.sum(F.when(F.col("is_word") & (c > 0), 1).otherwise(0)).alias("known"), F.sum(F.when(F.col("is_word"), F.log10(c + F.lit(0.1))).otherwise(0.0)).alias("logs"), F.sum(F.col("is_word").cast("long")).alias("rare"),
    )
    voc = model.voc
    log_total, log_other = float(np.log10(voc.total)), float(np.log10(voc.other_mass))
    return parts.select(
        F.col("own.doc_id").alias("doc_id"), F.col("own.n").alias("n_tokens"), (F.col("own.known") + F.col("known")).cast("long").alias("n_known"), F.lit(int(voc.n)).cast("long").alias("train_tokens"),
        (F.col("own.base") + F.col("logs") - F.col("rare") * F.lit(log_total)).alias("base_score"), (F.col("own.lm") + F.col("logs") - F.col("rare") * F.lit(log_other)).alias("score"),
    )


def language_model(docs: DataFrame, modulus: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; learnt from the rows that aren't held out.

    Null and empty texts have one token, the end. Repeated rows are documents of their own. Without training documents all words are unseen.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = rows.filter(remainder(F.col("doc_id"), modulus) != held)
    counts = cut(token_counts(learn))
    model = train(learn, counts)
    out = score(rows, counts, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

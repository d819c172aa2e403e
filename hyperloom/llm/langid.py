"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Each direction is a light gated unit: z = clip(a_z, LEAST_GATE, 1), c = clip(a_c, -1, 1), h' = h + z (c - h), with
a = table[byte] + h U. Both directions' states at a position give that position's language probabilities; a document's
probabilities are their mean over all positions. Texts are read whole. The windows of ``WINDOW`` bytes of a text run side by side in numpy: each
starts from the state that ``WARM`` bytes before it lead to, and where the state that the window before really ends in differs from that by more than ``CLOSE``,
the window runs again from that state, until none differs. So states are carried through whole documents, in both directions.

The network is trained here by backpropagation through time on a bounded sample: at most
``per_language`` documents of each language (fewer where there are many languages: ``MOST_ROWS`` in all), lowest digest of doc_id first, and of each document at most ``SPANS`` spans
of ``WINDOW`` bytes. Every language that occurs can be answered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, column, cut, pieces

WINDOW, HIDDEN, BLOCK = 64, 8, 4096
WARM, CLOSE = 32, 5e-3
#: Gates open at least so far, and no unit takes more than so much from the states (sum of absolute weights), so that what lies hundreds of bytes back fades
#: and few windows run again.
LEAST_GATE, MOST_FED_BACK = 0.25, 0.6
PER_LANGUAGE, MOST_ROWS, SPANS, STEPS = 300, 19_200, 16, 260
_LETTER = re.compile(r"[^\W\d_]")


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WINDOW bytes, the text each belongs to, and how many bytes of each row count."""
    n = np.array([len(t) for t in texts])
    rows = -(-n // WINDOW)
    flat = b"".join(t.ljust(r * WINDOW, b"\0") for t, r in zip(texts, rows))
    x = np.frombuffer(flat, np.uint8).reshape(-1, WINDOW)
    of = np.repeat(np.arange(len(texts)), rows)
    held = np.full(len(x), WINDOW)
    last = np.cumsum(rows)[rows > 0] - 1
    held[last] = n[rows > 0] - (rows[rows > 0] - 1) * WINDOW
    return x, of, held


def _shifted(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Rows (row, position) whose first ``held`` bytes stand at their right end."""
    at = np.arange(x.shape[1])[None] - (x.shape[1] - held)[:, None]
    return np.take_along_axis(x, np.maximum(at, 0), 1)


def _states(x: np.ndarray, table: np.ndarray, u: np.ndarray, back: bool, first: np.ndarray | None = None) -> np.ndarray:
    """States (position, unit, row) of one direction; x is (position, row), first the states (unit, row) before. Rows lie side by side, so that numpy's loops are long."""
    steps, n = x.shape
    k = u.shape[0]
    out, ut = np.empty((steps, k, n), np.float32), np.ascontiguousarray(u.T)
    h, a, m = np.zeros((k, n), np.float32) if first is None else first, np.empty((n, 2 * k), np.float32), np.empty((2 * k, n), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        np.take(table, x[t], axis=0, out=a, mode="clip")
        np.matmul(ut, h, out=m)
        m += a.T
        z, c = m[:k], m[k:]
        np.maximum(z, LEAST_GATE, out=z)
        np.minimum(z, 1, out=z)
        np.maximum(c, -1, out=c)
        np.minimum(c, 1, out=c)
        c -= h
        c *= z
        np.add(c, h, out=out[t])
        h = out[t]
    return out


class ByteNetwork:
    """Weights, training and scoring of the network. ``languages`` are the values it can answer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        c = len(languages)
        self.languages = languages
        self.w = {}
        for d in ("f", "b"):
            table = rng.normal(0, 0.5, (256, 2 * HIDDEN))
            table[:, :HIDDEN] = table[:, :HIDDEN] * 0.3 + 0.4
            self.w[f"table_{d}"], self.w[f"u_{d}"], self.w[f"o_{d}"] = table, rng.normal(0, 0.2, (HIDDEN, 2 * HIDDEN)), rng.normal(0, 0.3, (HIDDEN, c))
        self.w["bias"] = np.zeros(c)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _sums(self, x: np.ndarray, held: np.ndarray, before: dict) -> tuple[np.ndarray, dict]:
        """Sums of the language probabilities over each row's own positions, and the states in which rows end, from the states before them; x is (row, position)."""
        w, turned = self.w, np.ascontiguousarray(x.T)
        ahead = _states(turned, w["table_f"], w["u_f"], False, before["f"])
        # a text's last row is read backwards from its last byte: such rows stand at the right end for that
        short, lanes = np.flatnonzero(held < WINDOW), np.arange(len(held))
        right = turned
        if len(short):
            right = turned.copy()
            right[:, short] = _shifted(x[short], held[short]).T
        behind = _states(right, w["table_b"], w["u_b"], True, before["b"])
        ends = {"f": ahead[-1], "b": behind[WINDOW - held, :, lanes].T}
        if len(short):
            at = np.minimum(np.arange(WINDOW)[:, None] + (WINDOW - held[short])[None], WINDOW - 1)
            behind[:, :, short] = np.take_along_axis(behind[:, :, short], at[:, None, :], 0)
        y = np.matmul(np.ascontiguousarray(w["o_f"].T), ahead)
        y += np.matmul(np.ascontiguousarray(w["o_b"].T), behind)
        y += w["bias"][:, None]
        np.clip(y, -30, 30, out=y)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        if len(short):
            y[:, :, short] *= (np.arange(WINDOW)[:, None] < held[short][None])[:, None, :]
        return y.sum(0).T.astype(np.float64), ends

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (empty: zeros)."""
        x, of, held = _windows(texts)
        rows, sums = len(x), np.zeros((len(x), len(self.languages)))
        goes_on = np.zeros(rows + 1, bool)  # row r continues the text of row r - 1
        goes_on[1:rows] = of[1:] == of[:-1]
        before = {d: np.zeros((HIDDEN, rows), np.float32) for d in "fb"}
        after = {d: np.zeros((HIDDEN, rows), np.float32) for d in "fb"}
        for a in range(0, rows, BLOCK):
            at = np.arange(a, min(a + BLOCK, rows))
            mine, whole = at[goes_on[at]], at[goes_on[at + 1]]
            if len(mine):
                before["f"][:, mine] = _states(np.ascontiguousarray(x[mine - 1, -WARM:].T), self.w["table_f"], self.w["u_f"], False)[-1]
            if len(whole):
                n = np.minimum(held[whole + 1], WARM)
                states = _states(np.ascontiguousarray(_shifted(x[whole + 1, :WARM], n).T), self.w["table_b"], self.w["u_b"], True)
                before["b"][:, whole] = states[WARM - n, :, np.arange(len(whole))].T
        todo = np.arange(rows)
        while len(todo):
            for a in range(0, len(todo), BLOCK):
                at = todo[a : a + BLOCK]
                sums[at], ends = self._sums(x[at], held[at], {d: np.ascontiguousarray(before[d][:, at]) for d in "fb"})
                for d in "fb":
                    after[d][:, at] = ends[d]
            # the first row of a text has no state before it, the last none behind
            off = np.zeros(rows, bool)
            for d, here, there in (("f", np.flatnonzero(goes_on[:rows]), -1), ("b", np.flatnonzero(goes_on[1:]), 1)):
                real = after[d][:, here + there]
                apart = np.abs(real - before[d][:, here]).max(0, initial=0) > CLOSE
                before[d][:, here[apart]] = real[:, apart]
                off[here[apart]] = True
            todo = np.flatnonzero(off)
        total = np.zeros((len(texts), len(self.languages)))
        if rows:
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[heads]] = np.add.reduceat(sums, heads, axis=0)
        n = np.array([max(1, len(t)) for t in texts])
        return total / n[:, None]

    def fit(self, texts: list[list[bytes]], labels: list[int], steps: int = STEPS, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Backpropagation through time over random spans of texts, languages drawn alike; Adam."""
        rng = np.random.default_rng(seed)
        by: list[list] = [[] for _ in self.languages]
        for t, y in zip(texts, labels):
            by[y].append(t)
        usable = [i for i, ts in enumerate(by) if ts]
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            x, y = np.zeros((batch, WINDOW), np.uint8), np.empty(batch, np.int64)
            for r in range(batch):
                y[r] = usable[rng.integers(len(usable))]
                t = by[y[r]][rng.integers(len(by[y[r]]))]
                s = np.frombuffer(t[rng.integers(len(t))], np.uint8)
                x[r, : len(s)] = s
            grad = self._gradient(np.ascontiguousarray(x.T), y)
            lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values()))
            if not np.isfinite(norm):
                continue
            grad = {k: g * min(1.0, 1.0 / max(norm, 1e-9)) for k, g in grad.items()}
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
            for k in ("u_f", "u_b"):
                self.w[k] *= np.minimum(1, MOST_FED_BACK / np.maximum(np.abs(self.w[k]).sum(0), 1e-9)).astype(np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        w, (steps, n) = self.w, x.shape
        states = {d: np.ascontiguousarray(_states(x, w[f"table_{d}"], w[f"u_{d}"], d == "b").transpose(0, 2, 1)) for d in "fb"}
        p = states["f"] @ w["o_f"] + states["b"] @ w["o_b"] + w["bias"]
        p = np.exp(p - p.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(n), y] -= 1
        p /= steps * n
        grad = {"bias": p.sum((0, 1))}
        for d in "fb":
            h, u, back = states[d], w[f"u_{d}"], d == "b"
            grad[f"o_{d}"] = h.reshape(-1, HIDDEN).T @ p.reshape(-1, p.shape[-1])
            into = p @ w[f"o_{d}"].T
            du, da_all, dh = np.zeros_like(u), np.empty((steps, n, 2 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if back else range(steps - 1, -1, -1):
                past = t + 1 if back else t - 1
                h0 = h[past] if 0 <= past < steps else np.zeros((n, HIDDEN), np.float32)
                a = w[f"table_{d}"][x[t]] + h0 @ u
                z, c = np.clip(a[:, :HIDDEN], LEAST_GATE, 1), np.clip(a[:, HIDDEN:], -1, 1)
                dh = dh + into[t]
                da = da_all[t]
                da[:, :HIDDEN] = dh * (c - h0) * ((a[:, :HIDDEN] > LEAST_GATE) & (a[:, :HIDDEN] < 1))
                da[:, HIDDEN:] = dh * z * (np.abs(a[:, HIDDEN:]) < 1)
                du += h0.T @ da
                dh = dh * (1 - z) + da @ u.T
            grad[f"u_{d}"] = du
            flat, idx = da_all.reshape(-1, 2 * HIDDEN), x.ravel()
            grad[f"table_{d}"] = np.stack([np.bincount(idx, flat[:, j], 256) for j in range(2 * HIDDEN)], 1).astype(np.float32)
        return grad


def remainder(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def spans(text: str) -> list[bytes]:
    """At most SPANS spans of WINDOW bytes of a text, evenly spread; a short text is cut into all of them."""
    raw = text.encode("utf-8", "surrogatepass")
    n = -(-len(raw) // WINDOW)
    if n <= SPANS:
        return [raw[i * WINDOW : (i + 1) * WINDOW] for i in range(n)]
    return [raw[a : a + WINDOW] for a in np.linspace(0, len(raw) - WINDOW, SPANS).astype(np.int64)]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, steps: int = STEPS) -> ByteNetwork | None:
    """A network fit on the bounded sample of labelled rows; None where no row has a label and a text. More than ``most_rows`` languages are an error."""
    bound_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("lang is not null and text is not null and length(text) > 0")
    # Ids that repeat or are missing are told apart by their texts.
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    # Bands of the digest, 16 per doubling: rows are counted by band first, so that only a language's lowest bands are ranked.
    band = F.floor(F.log2(F.conv(F.substring(digest, 1, 15), 16, 10).cast("double") + 1) * 16)
    sizes = cut(known.groupBy("lang", band.alias("band")).agg(F.count("*").alias("n")))
    languages = sorted(r.lang for r in sizes.select("lang").distinct().limit(most_rows + 1).collect())
    if not languages:
        return None
    if len(languages) > most_rows:
        raise ValueError(f"more than {most_rows} languages")
    each = min(per_language, most_rows // len(languages))
    before = Window.partitionBy("lang").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < each)
    highest = needed.groupBy("lang").agg(F.max("band").alias("highest"))  # a row for each language, at most most_rows
    order = Window.partitionBy("lang").orderBy("digest", "doc_id")
    low = known.withColumn("digest", digest).withColumn("band", band).join(F.broadcast(highest), "lang").filter("band <= highest")

    def cut_out(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([spans(t) for t in column(b, "text")], pa.list_(pa.binary()))], names=["lang", "digest", "doc_id", "spans"])

    parts = low.select("lang", "digest", "doc_id", "text").mapInArrow(cut_out, "lang string, digest string, doc_id long, spans array<binary>")
    sample = parts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each)
    rows = sorted(sample.select("lang", "r", "spans").collect(), key=lambda r: (r.lang, r.r))  # some kilobytes a row
    net = ByteNetwork(languages)
    at = {x: i for i, x in enumerate(languages)}
    net.fit([[bytes(t) for t in r.spans] for r in rows], [at[r.lang] for r in rows], steps)
    return net


def predict(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """docs with lang_pred and score (mean probability of lang_pred). Null texts and texts without a letter, or
    no network: ``und`` and 0. Only the text is read for it; docs' own columns of these names give way."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        own = shared.value
        for b in batches:
            texts = column(b, "text")
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for i, j in pieces(texts):
                at = [k for k in range(i, j) if own and texts[k] and _LETTER.search(texts[k])]
                if not at:
                    continue
                p = own.pooled([texts[k].encode("utf-8", "surrogatepass") for k in at])
                best = p.argmax(1)
                for k, y, s in zip(at, best, p.max(1)):
                    lang[k], score[k] = own.languages[y], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(run, schema)


def identify(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on rows outside the held-out remainder, answered for every row.

    Rows that repeat return a row each. An empty table gives an empty result.
    """
    out = F.col("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", remainder(F.col("doc_id"), modulus) == held)
    net = train(rows.filter(~out))
    return predict(rows.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")


def accept(docs: DataFrame, least_score: float = 0.0, modulus: int = 4, held: int = 2) -> DataFrame:
    """Documents whose language is found (not ``und``) at a mean probability of at least ``least_score``.

    Null texts and texts without a letter go. Mean probabilities over positions are low for much clean text, so no more is asked by default.
    """
    net = train(docs.filter(remainder(F.col("doc_id"), modulus) != held))
    names = docs.columns
    return predict(docs, net).filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select(*names)

"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are a lexicon of insults, words and word beginnings that labelled toxic rows use far more often than others (or far less often), and
patterns (shouting, rows of exclamation marks, several hits). The label model takes each voter's firing rate given
the hidden class as its accuracy. Labels only start it: from there expectation maximisation goes on over labelled and unlabelled rows alike, in which a row's own label, where
there is one, is one more voter of estimated accuracy, so that votes can overrule it;
voters that agree beyond what the class explains share their weight (estimated correlations). A logistic model of vote counts is then trained on the
posteriors. Both are fit on a bounded sample: at most ``SAMPLE`` labelled rows and ``UNLABELLED`` rows without a label, lowest digest of doc_id first.
Texts stay on the executors; terms' counts and rows of votes reach the driver. Scores see the text alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, cut
from .langid import remainder

SAMPLE, UNLABELLED, MOST_VOTERS, MOST_AGAINST, LEAST_SEEN, LEAST_RATIO = 6000, 6000, 160, 40, 6, 3.0
#: What the accuracy of labels is taken for at first, and at most.
GOLD = 0.95
#: Voters whose votes, given the class, correlate beyond this say the same thing and share one weight.
SAME_VOICE = 0.4
#: Insults to begin with (fixed values); labelled rows add their own.
LEXICON = "idiot moron stupid dumb imbecile fool pathetic worthless scum trash garbage loser clown disgusting vile filthy hate".split()
_WORD = re.compile(r"\w+")
_PREFIXES = (3, 4, 5, 6)
_BANG = re.compile(r"!{3,}")


def _terms(word: str):
    yield word
    for n in _PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


class Voters:
    """Lexicon entries (a word, or a beginning that ends in ``*``) and patterns, and their counts in a text."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.index = {t: i for i, t in enumerate(terms)}
        self.heads = {t.rstrip("*")[:3] for t in terms}
        self.names = [*terms, "hits>=2", "hits>=4", "shouting", "!!!"]

    def counts(self, text: str | None) -> np.ndarray:
        """Hits of each entry, pattern flags, and last the number of words."""
        out = np.zeros(len(self.names) + 1, np.float32)
        if not text:
            return out
        words = _WORD.findall(text.lower())
        heads, index = self.heads, self.index
        for w in [w for w in words if w[:3] in heads]:
            for t in _terms(w):
                i = index.get(t)
                if i is not None:
                    out[i] += 1
        n = len(self.terms)
        distinct = int((out[:n] > 0).sum())
        out[n], out[n + 1] = distinct >= 2, distinct >= 4
        out[n + 2] = text.isupper()
        out[n + 3] = _BANG.search(text) is not None
        out[n + 4] = len(words)
        return out


def find_voters(rows: DataFrame) -> list[str]:
    """Of rows (text, toxic): the lexicon, then the terms with the largest log ratio of toxic to other rows that have them, then those with the least."""

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for t, y in zip(column(b, "text"), column(b, "toxic")):
                seen.update((x, y) for x in {x for w in set(_WORD.findall((t or "").lower())) for x in _terms(w)})
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "toxic", "n"])

    of = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    c1, c0 = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    terms = rows.select("text", "toxic").mapInArrow(run, "term string, toxic int, n long").groupBy("term").agg(c1.alias("c1"), c0.alias("c0"))
    ratio = F.log((F.col("c1") + 0.5) / F.lit(of.get(1, 0) + 1)) - F.log((F.col("c0") + 0.5) / F.lit(of.get(0, 0) + 1))
    terms = cut(terms.withColumn("ratio", ratio).filter(F.greatest("c1", "c0") >= LEAST_SEEN))
    for_ = terms.filter((F.col("c1") >= LEAST_SEEN) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc(F.round(F.col("ratio") * F.sqrt("c1"), 9)), "term").limit(MOST_VOTERS)
    against = terms.filter(F.col("ratio") <= -LEAST_RATIO).orderBy(F.round(F.col("ratio") * F.sqrt("c0"), 9), "term").limit(MOST_AGAINST)
    return list(dict.fromkeys([*LEXICON, *(r.term for r in for_.collect())]))[:MOST_VOTERS] + [r.term for r in against.collect()]


class LabelModel:
    """P(class | votes) of voters with estimated accuracies and pairwise correlations."""

    def fit(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> np.ndarray:
        """votes: rows x voters, 0/1; labels: 0, 1 or NaN. Returns the posterior of each row."""
        v, known = votes.astype(np.float64), ~np.isnan(labels)
        q, self.gold = np.where(known, labels, 0.0), np.array([GOLD, GOLD])
        self._estimate(v[known], q[known])
        q = np.where(known, q, self.posterior(v))
        for _ in range(rounds):
            self._estimate(v, q)
            x = self.log_odds(v)
            # the row's own label votes as well, as well as labels have agreed with the hidden class
            right = [(q[known & (labels == 1)]).sum(), (1 - q[known & (labels == 0)]).sum()]
            of = [q[known].sum(), (1 - q[known]).sum()]
            self.gold = np.clip([(r + 19 * GOLD) / (n + 19) for r, n in zip(right, of)], 0.5, GOLD)
            one, none = np.log(self.gold[0] / (1 - self.gold[1])), np.log((1 - self.gold[0]) / self.gold[1])
            q = _logistic(x + np.where(known, np.where(labels == 1, one, none), 0.0))
        return q

    def _estimate(self, v: np.ndarray, q: np.ndarray) -> None:
        n1, n0 = q.sum(), (1 - q).sum()
        self.prior = (n1 + 1) / (n1 + n0 + 2)
        none = ~v.any(1)
        self.quiet = (q[none].sum() + 0.5) / (none.sum() + 1)
        # a row's worth of smoothing in all
        self.on = (v.T @ q + 0.1) / (n1 + 1)
        self.off = (v.T @ (1 - q) + 0.1) / (n0 + 1)
        rest = v - (np.outer(q, self.on) + np.outer(1 - q, self.off))
        cov = rest.T @ rest / len(v)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(np.abs(cov / np.outer(d, d)), 0, 1)
        np.fill_diagonal(corr, 0)
        self.correlation = corr
        self.share = 1 / (1 + np.where(corr > SAME_VOICE, corr, 0).sum(1))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """A silent voter abstains; ``quiet`` is the share of the class among rows where all abstain."""
        return np.log(self.quiet / (1 - self.quiet)) + votes @ ((np.log(self.on) - np.log(self.off)) * self.share)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _logistic(self.log_odds(votes))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Classifier:
    """Voters with the weights of a logistic model of their counts."""

    def __init__(self, voters: Voters, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    @staticmethod
    def features(counts: np.ndarray) -> np.ndarray:
        """log(1 + hits) of each voter, of all entries together, and per root of the length."""
        hits, n = counts[:, :-1], counts[:, -1:]
        total = hits[:, :-4].sum(1, keepdims=True)
        return np.hstack([np.log1p(hits), np.log1p(total), total / np.sqrt(n + 1)])

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(counts) @ self.weights + self.bias, -30, 30)))


def fit(voters: Voters, counts: np.ndarray, labels: np.ndarray, steps: int = 400) -> Classifier:
    """counts of each sampled row, labels of 0, 1 or NaN."""
    model = LabelModel()
    soft = model.fit((counts[:, :-1] > 0).astype(np.float64), labels)
    x = Classifier.features(counts).astype(np.float64)
    w, b = np.zeros(x.shape[1]), float(np.log(model.prior / (1 - model.prior)))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for s in range(1, steps + 1):
        p = _logistic(x @ w + b)
        gw, gb = x.T @ (p - soft) / len(x) + 1e-4 * w, float((p - soft).mean())
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.05 * (mw / (1 - 0.9**s)) / (np.sqrt(vw / (1 - 0.99**s)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**s)) / (np.sqrt(vb / (1 - 0.99**s)) + 1e-8)
    return Classifier(voters, w, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> Classifier | None:
    """The classifier of the bounded samples; None where there are no labels or only those of one class."""
    bound_batches(docs.sparkSession)
    one = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    known = labels.filter("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = known.orderBy(one, "toxic").limit(sample)
    others = rows.filter("doc_id is not null").select("doc_id").distinct().join(known, "doc_id", "left_anti").orderBy(one).limit(unlabelled).select("doc_id", F.lit(None).cast("int").alias("toxic"))
    # A doc_id that repeats takes part once.
    some = rows.join(F.broadcast(first.unionByName(others)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    some = cut(some.repartition(32, "doc_id"))
    if some.filter("toxic is not null").select("toxic").distinct().count() < 2:
        return None
    voters = Voters(find_voters(some.filter("toxic is not null")))

    def run(batches):
        for b in batches:
            made = [voters.counts(t).tolist() for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.float32()))], names=["doc_id", "toxic", "counts"])

    got = some.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, counts array<float>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    counts = got["counts"].combine_chunks().flatten().to_numpy().reshape(len(got), -1)
    return fit(voters, counts, got["toxic"].to_numpy(zero_copy_only=False).astype(np.float64))


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, score, predicted) of every document; without a model every score is 0."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in batches:
            texts = column(b, "text")
            if own is None or not texts:
                s = np.zeros(len(texts))
            else:
                s = own.score(np.stack([own.voters.counts(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, trained on labels outside the held-out remainder.

    Null and empty texts get the score of no votes; repeated rows a row each; labels that contradict each other are all used, a doc_id that repeats is learnt from once (its smallest text).
    """
    mine = remainder(F.col("doc_id"), modulus) != held
    model = train(docs.filter(mine), labels.filter(mine))
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", "predicted")

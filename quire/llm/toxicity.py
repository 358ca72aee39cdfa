"""Toxicity: non-negative positive-unlabelled learning of a linear classifier.

The training data are confirmed toxic texts (P) and unlabelled ones (U), a bounded sample of each. U holds toxic texts, too, in
the share of the class prior; the risk estimator corrects for them and keeps the estimated risk on negatives from falling
below nothing: risk = prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)). Loss: logistic, so scores are probabilities. The prior
is the share of toxic ones among the training folds' labels, so labels should be a fair sample of the documents.

Features: whether a text has a word, or a word that begins with certain 4 or 5 characters. Those are chosen whose share of P
is well above their share of U, which the sample's counts in Spark tell. Every whole text is then scored where it lies, with
sets of words: no shuffle. Neither labels nor lang, source or doc_id enter a score; doc_id only tells the folds apart.

Edge cases: null and empty texts get the score of a text without any feature; a null doc_id is never held out; a doc_id that
has several labels counts as toxic if one says so; without confirmed examples every score is 0. Repeated rows give equal scores;
an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import release, written

MAX_POSITIVE = 3000  # confirmed texts that the fit sees at most
MAX_UNLABELLED = 8000  # unlabelled texts that it sees at most
MAX_FEATURES = 2000
MIN_POSITIVE, MIN_SHARE = 3, 0.005  # confirmed texts that have a feature, at least: so many, and this share
MIN_LIFT = 4.0  # its share of P over its share of U, at least
THRESHOLD = 0.3
SEEN_WORDS = 200_000  # words a worker remembers as looked up
EDGES = " \t.,;:!?|()[]{}<>\"'%*&#$"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_features(word: str) -> list[str]:
    core = word.strip(EDGES)
    return [f"is {core}", *(f"begins {core[:k]}" for k in (4, 5) if len(core) > k)] if core else []


def text_features(text: str | None) -> set[str]:
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


def sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(text, positive: boolean) of different texts, and the class prior that the labels of the training folds show."""
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isNotNull())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()

    def some(ids: DataFrame, of: int, bound: int, kind: bool) -> DataFrame:
        h = F.xxhash64("doc_id", F.lit(4))
        near = ids.filter(F.pmod(h, F.lit(1_000_000)) <= 1_500_000 * bound // max(1, of)).orderBy(h, "doc_id").limit(bound)
        return near.select("doc_id", F.lit(kind).alias("positive"))

    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    chosen = some(known.filter("toxic = 1"), toxic, max_positive, True).unionByName(some(ids, ids.count(), max_unlabelled, False))
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "positive").distinct()
    return written(got, "toxicity-sample"), toxic / max(1, n)


def choose(examples: DataFrame, max_features: int) -> list[str]:
    """Features that mark confirmed texts, the most telling first."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = Counter(), Counter()
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[positive].update(text_features(text))
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(both[k].keys(), pa.string()), pa.array([v * k for v in both[k].values()], pa.int64()), pa.array([v * (1 - k) for v in both[k].values()], pa.int64())], names=["feature", "p", "u"])

    n_u, n_p = (examples.filter(F.col("positive") == bool(k)).count() for k in (0, 1))
    if not n_p:
        return []
    every = examples.mapInArrow(counts, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = F.col("p") / n_p, (F.col("u") + 1) / (n_u + 1)
    good = every.filter((F.col("p") >= MIN_POSITIVE) & (share_p >= MIN_SHARE) & (share_p >= MIN_LIFT * share_u))
    return [r[0] for r in good.orderBy(((share_p - share_u) / F.sqrt(share_u)).desc(), "feature").limit(max_features).collect()]


def train(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset that least the non-negative risk, by Adam over all examples. x: 0 or 1."""
    n, m = x.shape
    theta, first, second = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    theta[m] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    p, u = positive, ~positive

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for t in range(1, steps + 1):
        z = (x @ theta[:m].astype(x.dtype)).astype(np.float64) + theta[m]
        s = sigmoid(z)
        soft = np.logaddexp(0, z)  # the loss of calling an example negative; its slope is s
        slope = np.zeros(n)
        negative_risk = soft[u].mean() - prior * soft[p].mean()
        if negative_risk >= 0:
            slope[p] = (prior * (s[p] - 1) - prior * s[p]) / p.sum()
            slope[u] = s[u] / u.sum()
        else:  # overfitting on the negatives: step back from it
            slope[p] = prior * s[p] / p.sum()
            slope[u] = -s[u] / u.sum()
        grad = np.append(slope.astype(x.dtype) @ x, slope.sum())
        grad[:m] += decay * theta[:m]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return theta[:m], float(theta[m])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> tuple[dict[str, float], float] | None:
    """({feature: weight}, offset); None if nothing confirmed is there to learn from."""
    examples, prior = sample(docs, labels, max_positive, max_unlabelled)
    names = choose(examples, max_features)
    place = {f: k for k, f in enumerate(names)}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[f] for f in text_features(t) if f in place) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["positive", "found"])

    rows = examples.mapInArrow(marked, "positive boolean, found array<int>").collect() if names else []
    rows.sort(key=lambda r: (r[0], r[1]))  # the same sums in every run
    positive = np.array([r[0] for r in rows], bool)
    if not positive.any() or positive.all():
        return None
    x = np.zeros((len(rows), len(names)), np.float32)
    for k, r in enumerate(rows):
        x[k, r[1]] = 1
    weights, offset = train(x, positive, prior)
    return {f: float(w) for f, w in zip(names, weights, strict=True)}, offset


class Scorer:
    def __init__(self, model: tuple[dict[str, float], float] | None):
        self.model, self.hot, self.seen = model, {}, set()

    def __call__(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        weights, offset = self.model
        words = set((text or "").lower().split())
        new = words - self.seen
        if new:
            if len(self.seen) > SEEN_WORDS:
                self.seen, self.hot = set(), {}
                new = words
            for w in new:
                if got := [f for f in word_features(w) if f in weights]:
                    self.hot[w] = got
            self.seen |= new
        found = {f for w in words & self.hot.keys() for f in self.hot[w]}
        return float(1 / (1 + np.exp(-np.clip(offset + sum(sorted(weights[f] for f in found)), -40, 40))))


def scored(docs: DataFrame, model, keep: list[str], below: float | None = None) -> DataFrame:
    """The columns `keep` of docs, and score; with `below` only those columns of the rows whose score is below it. docs must have `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        score = Scorer(model)
        for batch in batches:
            scores = pa.array([score(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[f"c{k}" for k in range(len(keep))] + ["score"])

    asked = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)), F.col("text").alias("scored_text"))
    kinds = [f.dataType.simpleString() for f in asked.schema.fields[:-1]]
    out = asked.mapInArrow(run, ", ".join([f"c{k} {t}" for k, t in enumerate(kinds)] + ["score double"]))
    own = [F.col(f"c{k}").alias(c) for k, c in enumerate(keep)]
    return out.select(*own, "score") if below is None else out.filter(F.col("score") < below).select(*own)


def judged(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = scored(docs, fit(docs, labels, **bounds), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """docs without the texts that are judged toxic."""
    return scored(docs, fit(docs, labels, **bounds), docs.columns, THRESHOLD)

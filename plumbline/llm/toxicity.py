"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train a linear classifier in
numpy.  The risk is ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: where
the bracket turns negative, the step goes up that part instead, so the model
cannot fit the unlabelled set below zero.  Features are hashed words and word
beginnings that stand out in toxic text; their values follow their share of a
text's words, so a long text weighs no more than a short one, and their weights
are held at zero or above.  A fifth of the rows is kept from the gradient to
place the threshold, where the recall less the false alarms is best; the false
alarms come from the unlabelled rows and the class prior.

Only rows outside the hold-out (crc32 of doc_id, modulo 3, is 1) lend labels or
text to the fit, which reads at most ``Params.max_positive`` toxic and
``Params.max_unlabelled`` other documents, whole.

The class prior is the toxic share of the labelled rows, which is right where
labels are a random sample of the documents; ``fit`` takes no other word for it.

Defined results: null and empty texts get the score of the bias alone; without
any toxic label, or any text to one that tells it apart, every score is 0; texts of any length are scored whole; of
several texts under one doc_id the least is learned from; features that stand
out alike are taken in the order of their numbers; repeated rows are scored one
by one; an empty table gives an empty result; extra columns are kept by
``filter_documents`` and otherwise left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hold_out, release, sampled_ids, shielded, text_batches

_BREAK = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Params:
    max_positive: int = 2_000
    max_unlabelled: int = 4_000
    bits: int = 20
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    features: int = 128
    min_documents: int = 3
    epochs: int = 40
    batch: int = 256
    rate: float = 0.05
    l2: float = 1e-6
    full_share: float = 0.01
    threshold: float = 0.7
    max_alarms: float = 0.02
    min_held: int = 20
    cache: int = 100_000


@dataclass(frozen=True)
class Model:
    """weights: of the features that count; the others are not in it."""

    weights: dict[int, float]
    bias: float
    params: Params


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_BREAK).split()


def word_features(word: bytes, params: Params) -> list[int]:
    mask, name = (1 << params.bits) - 1, word.decode("utf-8", "replace")
    return [crc32(b"w" + word) & mask] + [crc32(b"%d" % k + name[:k].encode()) & mask for k in params.prefixes if len(name) >= k]


def _value(count: float, total: int, params: Params) -> float:
    """From 0 to 1, reached where a feature holds ``full_share`` of the words and one more."""
    return min(1.0, count / (1 + params.full_share * total))


def document_features(text: str | None, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers in rising order, and their values."""
    counts = Counter(words(text))
    got: dict[int, int] = {}
    for w, n in counts.items():
        for f in word_features(w, params):
            got[f] = got.get(f, 0) + n
    total, index = sum(counts.values()), sorted(got)
    return np.array(index, np.int32), np.array([_value(got[i], total, params) for i in index], np.float32)


def standing_out(totals: DataFrame, positive: int, unlabelled: int, params: Params) -> list[int]:
    """The features whose mean value in toxic text stands out most, in standard errors; equal ones in the order of their numbers.

    totals: (f, p, u, seen), sums over the toxic and the other texts and the toxic texts that have f.
    """
    p, u = F.col("p") / max(1, positive), F.col("u") / max(1, unlabelled)
    z = F.round((p - u) / F.sqrt(p / max(1, positive) + u / max(1, unlabelled) + 1 / max(1, positive) ** 2), 9)
    top = totals.where(F.col("seen") >= params.min_documents).select("f", z.alias("z")).where("z > 0")
    return sorted(r.f for r in top.orderBy(F.desc("z"), "f").limit(params.features).collect())


def train(p_all: np.ndarray, u_all: np.ndarray, chosen: list[int], prior: float, params: Params = Params(), seed: int = 7) -> Model:
    """Adam on the non-negative risk with logistic loss; a row for each text, a column for each chosen feature."""
    if not len(p_all) or not len(u_all):
        return Model({}, -np.inf, params)
    held_p, held_u = (np.arange(len(x)) % 5 == 4 for x in (p_all, u_all))
    xp, xu = p_all[~held_p], u_all[~held_u] if (~held_u).any() else u_all
    rng = np.random.default_rng(seed)
    w = np.zeros(len(chosen) + 1)  # the last is the bias
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -30, 30)))  # noqa: E731  of log(1 + exp(-z))
    loss = lambda z: np.logaddexp(0, -z)
    p_size = max(1, min(len(xp), params.batch // 2))
    for epoch in range(params.epochs):
        order = rng.permutation(len(xu))
        rate = params.rate * (1 - epoch / params.epochs)
        for k in range(0, len(xu), params.batch):
            u, p = xu[order[k : k + params.batch]], xp[rng.choice(len(xp), p_size, replace=False)]
            zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
            if loss(-zu).mean() - prior * loss(-zp).mean() >= 0:
                gp, gu = prior * (slope(zp) + slope(-zp)) / len(p), -slope(-zu) / len(u)
            else:
                gp, gu = -prior * slope(-zp) / len(p), slope(-zu) / len(u)
            grad = np.append(gp @ p + gu @ u, gp.sum() + gu.sum()) + params.l2 * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)
    few = held_p.sum() < params.min_held  # too few to place a threshold by: all rows do
    zp, zu = (x @ w[:-1] + w[-1] for x in ((p_all, u_all) if few else (p_all[held_p], u_all[held_u])))
    cuts = np.unique(np.concatenate([zp, zu]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    recall = np.array([(zp >= t).mean() for t in cuts])
    alarms = np.clip((np.array([(zu >= t).mean() for t in cuts]) - prior * recall) / max(1e-9, 1 - prior), 0, 1)
    gain = np.where(alarms <= params.max_alarms, recall - 2 * alarms, -1.0)
    at = cuts[gain >= gain.max() - 0.005] if (gain >= 0).any() else cuts[-1:] + 1
    shift = np.log(params.threshold / (1 - params.threshold)) - (at.min() + at.max()) / 2
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=False) if x > 0}, float(w[-1] + shift), params)


class _Features(dict):
    """The features of words that count, made when first asked for; forgotten when there are too many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.model.params.cache:
            self.clear()
        self[word] = out = tuple(f for f in word_features(word, self.model.params) if f in self.model.weights)
        return out


def score_text(text: str | None, features: _Features) -> float:
    model, ws = features.model, words(text)
    found = Counter(chain.from_iterable(map(features.__getitem__, ws)))
    z = model.bias + sum(model.weights[f] * _value(n, len(ws), model.params) for f, n in sorted(found.items()))
    return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z))))) if np.isfinite(z) else 0.0


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """labels: doc_id, toxic (1 is toxic).  A document is toxic if any of its labels says so."""
    known = labels.where("doc_id is not null and toxic is not null").where(~hold_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text_batches(docs.sparkSession)
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share:
        return train(np.zeros((0, 0)), np.zeros((0, 0)), [], 0.0, params)
    chosen = sampled_ids(known.where("toxic = 1").select("doc_id"), params.max_positive).withColumn("_p", F.lit(True))
    others = sampled_ids(docs.where("doc_id is not null").where(~hold_out()).select("doc_id"), params.max_unlabelled).withColumn("_p", F.lit(False))
    rows = docs.select("doc_id", "text").join(chosen.unionByName(others), "doc_id").groupBy("doc_id", "_p").agg(F.min("text").alias("text"))
    rows = checkpointed(rows)
    sizes = {r._p: r.n for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, 1 << params.bits))
        for x in batches:
            for p, t in zip(x["_p"], x["text"], strict=True):
                i, v = document_features(t, params)
                sums[0 if p else 1, i] += v
                sums[2, i] += bool(p)
        f = np.flatnonzero(sums.any(0))
        yield pd.DataFrame({"f": f, "p": sums[0, f], "u": sums[1, f], "seen": sums[2, f]})

    totals = rows.mapInPandas(tally, "f int, p double, u double, seen double").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"), F.sum("seen").alias("seen"))
    top = standing_out(totals, sizes.get(True, 0), sizes.get(False, 0), params) if sizes.get(True) else []
    if not top:
        return train(np.zeros((0, 0)), np.zeros((0, 0)), [], 0.0, params)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {f: k for k, f in enumerate(top)}
        for x in batches:
            out = np.zeros((len(x), len(top)), np.float32)
            for r, t in enumerate(x["text"]):
                for f, v in zip(*document_features(t, params), strict=True):
                    if f in at:
                        out[r, at[f]] = v
            yield pd.DataFrame({"doc_id": x["doc_id"], "_p": x["_p"], "v": list(out)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # max_positive + max_unlabelled rows of ``features`` numbers at most.
    got = rows.mapInPandas(dense, f"doc_id {kind}, _p boolean, v array<float>").orderBy("doc_id").collect()
    p_all, u_all = (np.array([r.v for r in got if r._p is s], np.float32).reshape(-1, len(top)) for s in (True, False))
    return train(p_all, u_all, top, float(share), params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (own columns first) with score and predicted; columns of those names are replaced."""
    text_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # Params.features weights, whatever the data

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = _Features(shared.value)
        for x in batches:
            yield pd.Series([score_text(t, features) for t in x], dtype="float64")
        del features
        release()

    df = docs.withColumn("score", scored(F.col("text")))
    return df.withColumn("predicted", (F.col("score") >= model.params.threshold).cast("int"))


def filter_documents(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    own, restore = shielded(docs)
    return restore(score(own, fit(docs, labels, params)).where("predicted = 0"))

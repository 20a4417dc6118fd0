"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the set of hashes, into ``2**bits`` places, of its lower-cased words, of
adjacent pairs, and of pairs with one or two words left out between. Training goes through a
bounded sample of labelled rows one by one with a rate for each coordinate; L1 keeps all but a few
weights at zero, so what is broadcast is a short list of (place, weight). A logistic curve over the
sums, fitted on a fifth of the sample that isn't learned from, turns them into probabilities.

Defined results: a null or empty text scores the bias alone; without labels of both classes every
score is the smoothed share of label 1; repeated rows give repeated results; several labels of one
document count as their largest; null labels are ignored; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, map_rows
from quire.llm.quality import fit_curve, sampled

WORD = re.compile(r"[^\W_]+")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


@dataclass
class ToxicityModel:
    bits: int
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << self.bits, dtype=np.float32)
        dense[self.places] = self.weights
        return dense


def featurizer(bits: int):
    """A function from a text to the sorted distinct places of its features."""
    import xxhash

    memo = Memo(lambda w: xxhash.xxh64_intdigest(w.encode()), most=200_000)
    down = np.uint64(64 - bits)

    def of(text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        parts = [(h * MIX[0]) >> down]
        for gap in (1, 2, 3):
            if len(h) > gap:
                parts.append(((h[:-gap] * MIX[gap] + h[gap:]) * MIX[0]) >> down)
        return np.concatenate(parts).astype(np.int64)

    return of


def ftrl(rows, size: int, *, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 4, bias: float = 0.0):
    """Weights after ``epochs`` passes over rows of (distinct places, label); the bias isn't penalised."""
    z, n = np.zeros(size), np.zeros(size)
    zb, nb, b = 0.0, 0.0, bias
    for _ in range(epochs):
        for at, y in rows:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2))
            p = 1 / (1 + np.exp(-max(-30.0, min(30.0, w.sum() + b))))
            g = p - y
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * (b - bias)
            nb += g * g
            b = bias - zb / ((beta + nb**0.5) / alpha)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, b


def log_loss(rows, w: np.ndarray, b: float) -> float:
    z = np.array([w[at].sum() + b for at, _ in rows])
    return float(np.mean(np.logaddexp(0, np.where([y for _, y in rows], -z, z))))


def chosen(examples: list, size: int, strengths: tuple[float, ...], folds: int = 4) -> float:
    """The L1 strength of the least log loss on examples that weren't learned from, by cross-validation."""
    if len(strengths) == 1:
        return strengths[0]

    def loss(l1: float) -> float:
        total = 0.0
        for fold in range(folds):
            used, left = [x for i, x in enumerate(examples) if i % folds != fold], examples[fold::folds]
            total += log_loss(left, *ftrl(used, size, bias=odds(used), l1=l1 * len(used) ** 0.5)) * len(left)
        return total

    return min(strengths, key=loss)


def odds(rows) -> float:
    ones = sum(y for _, y in rows)
    return float(np.log((ones + 0.5) / (len(rows) - ones + 0.5)))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "toxic", key: str = "doc_id", text: str = "text",
    rows: int = 4000, features: int = 24_000_000, bits: int = 20, strengths: tuple[float, ...] = (0.05, 0.1, 0.2, 0.4), tried: int = 1000,
) -> ToxicityModel:
    """Learn from ``rows`` labelled texts of each class at most, in an order by hash until they have ``features``.

    The L1 strength is the best of ``strengths`` in a cross-validation over the first ``tried`` texts.
    """
    sample = sampled(labels, label, key, usable, rows)
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").filter("t is not null")

    def make():
        of = featurizer(bits)
        return lambda c: [c[0], c[1], [np.unique(of(t)).astype(np.int32).tobytes() for t in c[2]]]

    drawn = map_rows(own.select("draw", "y", "t"), make, "draw long, y int, places binary").orderBy("draw")
    examples, total = [], 0
    for r in drawn.toLocalIterator():
        total += len(r["places"]) // 4
        if total > features:
            break
        examples.append((np.frombuffer(bytes(r["places"]), dtype=np.int32), r["y"]))
    seen = {r["y"]: r["count"] for r in labels.filter(usable & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).count().collect()}
    ones, zeros = seen.get(1, 0), seen.get(0, 0)
    if len({y for _, y in examples}) < 2:
        share = (ones + 1) / (ones + zeros + 2)
        return ToxicityModel(bits, np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    l1 = chosen(examples[:tried], 1 << bits, strengths)
    # One example in five isn't learned from: the scale of the sums and their offset are fitted on these.
    held, used = examples[4::5], [x for i, x in enumerate(examples) if i % 5 != 4]
    # The noise of a coordinate's sum grows as the root of the examples.
    w, b = ftrl(used, 1 << bits, bias=odds(used), l1=l1 * (len(used) ** 0.5))
    scale, offset = 1.0, 0.0
    if len({y for _, y in held}) == 2:
        offset, scale = fit_curve(np.array([[w[at].sum() + b] for at, _ in held]), np.array([y for _, y in held], dtype=float), ridge=0.1)
    # The sample holds the classes more evenly than the labels do: back to the labels' own odds.
    offset += float(np.log(max(1, ones) / max(1, zeros))) - odds(examples)
    at = np.nonzero(w)[0]
    return ToxicityModel(bits, at.astype(np.int32), (scale * w[at]).astype(np.float32), float(scale * b + offset))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, score and predicted (1 at ``threshold`` or more). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights at most, a few thousand in practice

    def make():
        own = shared.value
        of, table = featurizer(own.bits), own.table()

        def one(text):
            at = of(text)
            at = at[table[at] != 0]  # few are left: distinct places of those alone
            return table[np.unique(at)].sum(dtype=np.float64) + own.bias

        def work(columns):
            z = np.array([one(t) for t in columns[1]])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return [columns[0], score.tolist(), (score >= threshold).astype(int).tolist()]

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, score double, predicted int")

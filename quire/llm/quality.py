"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of 512 bytes; every block is compressed on its own with each dictionary.
(bytes with the bad dictionary - bytes with the good one) / bytes of the text is the normalised
difference; a logistic curve over it and the text's shortness, fitted on labelled rows that no
dictionary has seen, turns it into the probability of label 1.

What is learned comes from a bounded sample of labelled rows (``rows`` of each class and
``sample_bytes`` of dictionary blocks for each, drawn by hash); scoring covers every whole text.

Defined results: a null or empty text has difference 0 and gets the curve's score for nothing
(the prior of short texts); with labels of one class only, or none, every score is the smoothed
share of label 1; repeated rows give repeated results; several labels of one document count as
their largest; null labels are ignored; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_rows, renamed

BLOCK = 512


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])  # of 1, difference, shortness
    level: int = 3

    def features(self):
        """A function from text to (normalised difference, shortness)."""
        import zstandard as zs

        if not self.good or not self.bad:
            return lambda text: (0.0, shortness(len(text.encode()) if text else 0))

        def compressor(content: bytes):
            d = zs.ZstdCompressionDict(content)
            d.precompute_compress(level=self.level)
            return zs.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        good, bad = compressor(self.good), compressor(self.bad)

        def of(text: str | None) -> tuple[float, float]:
            data = text.encode() if text else b""
            less = 0
            for at in range(0, len(data), BLOCK):
                block = data[at : at + BLOCK]
                less += len(bad(block)) - len(good(block))
            return less / max(1, len(data)), shortness(len(data))

        return of

    def probability(self, difference, short):
        z = self.weights[0] + self.weights[1] * np.asarray(difference) + self.weights[2] * np.asarray(short)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shortness(n_bytes: int) -> float:
    return 1 / (1 + n_bytes / 64)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Logistic regression by Newton's steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * w
        bend = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def dictionary(blocks: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the blocks themselves where they are too few to train on."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, blocks).as_bytes()
    except zs.ZstdError:
        return b"".join(blocks)[-size:]


def sampled(labels: DataFrame, label: str, key: str, usable: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled keys of each class, drawn by hash: (key, y, draw)."""
    own = (
        labels.filter(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("k"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .withColumn("draw", F.xxhash64("k"))
    )
    of = lambda y: own.filter(F.col("y") == y).orderBy("draw", "k").limit(rows)
    return of(0).unionByName(of(1))


def train_quality(
    docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "quality", key: str = "doc_id", text: str = "text",
    rows: int = 3000, sample_bytes: int = 6_000_000, dictionary_bytes: int = 65_536, level: int = 3,
) -> QualityModel:
    """Fit the two dictionaries and the curve. ``usable`` says which rows of ``labels`` may be learned from."""
    sample = sampled(labels, label, key, usable, rows)
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").filter(F.coalesce(F.length("t"), F.lit(0)) > 0)
    for_dictionary = own.filter(F.col("draw") % 2 == 0)

    def cut():
        def work(columns):
            out = [[], [], [], []]
            for k, t, y in zip(*columns):
                data = t.encode()
                for i, at in enumerate(range(0, len(data), BLOCK)):
                    for c, v in zip(out, (k, i, y, data[at : at + BLOCK])):
                        c.append(v)
            return out

        return work

    kind = docs.schema[key].dataType.simpleString()
    blocks = map_rows(for_dictionary.select("k", "t", "y"), cut, f"k {kind}, i int, y int, block binary").withColumn("h", F.xxhash64("k", "i"))
    most = max(1, sample_bytes // BLOCK)
    drawn = blocks.filter("y = 0").orderBy("h", "k", "i").limit(most).unionByName(blocks.filter("y = 1").orderBy("h", "k", "i").limit(most)).toArrow().to_pylist()
    drawn.sort(key=lambda r: (r["h"], str(r["k"]), r["i"]))
    contents = {y: dictionary([r["block"] for r in drawn if r["y"] == y], dictionary_bytes) for y in (0, 1)}
    model = QualityModel(contents[1], contents[0], level=level)

    measured = featured(own.filter(F.col("draw") % 2 != 0), model, "t", ["y"]).select("y", "difference", "short").toArrow()
    y = np.array(measured["y"], dtype=float)
    if len(set(y)) < 2:
        seen = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        share = (seen.get(1, 0) + 1) / (sum(seen.values()) + 2)
        return QualityModel(b"", b"", [float(np.log(share / (1 - share))), 0.0, 0.0], level)
    seen = {r["y"]: r["count"] for r in labels.filter(usable & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).count().collect()}
    model.weights = fit_curve(np.column_stack([np.array(measured["difference"]), np.array(measured["short"])]), y)
    # The sample holds the classes more evenly than the corpus does: back to the labels' own odds.
    model.weights[0] += float(np.log(max(1, seen.get(1, 0)) / max(1, seen.get(0, 0))) - np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum())))
    return model


def featured(docs: DataFrame, model: QualityModel, text: str, keep: list[str]) -> DataFrame:
    """``keep``, the normalised difference, shortness and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dictionary_bytes at most

    def make():
        own = shared.value
        of = own.features()

        def work(columns):
            *kept, texts = columns
            found = [of(t) for t in texts]
            d, s = [f[0] for f in found], [f[1] for f in found]
            return [*kept, d, s, own.probability(d, s).tolist()]

        return work

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs.select(*keep, text), make, f"{fields}, difference double, short double, score double")


def score_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, score, predicted (1 at ``threshold`` or more) and the normalised difference."""
    out = featured(docs, model, text, [key])
    return out.select(key, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")


def accepted(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score ``threshold`` or more, with all their columns. No shuffle."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    plain, names = renamed(docs)

    def run(batches):
        own = shared.value
        of = own.features()
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column(at)]
            if found:
                keep = own.probability(*np.array(found).T) >= threshold
                yield batch.filter(pa.array(keep))

    return plain.mapInArrow(run, plain.schema).toDF(*names)

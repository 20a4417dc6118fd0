"""Approximate nearest neighbours: a vantage-point tree a shard, with relaxed pruning.

Nearness is the inner product, |q| |x| cos(q, x). Trees are grown on the distances d between the
vectors' directions, which no norm changes, with cos = 1 - d^2 / 2, and each node knows the smallest
and largest norm of its rows. The far side of a node is at least the query's gap to the boundary
away, so no score there is above |q| max|x| (1 - gap^2 / 2); a search leaves the side out where that
is below its k-th best score. The gap counts 1 / ``factor`` times: factor 1 is exact, a smaller one
prunes more. The bound of a node depends on no row outside it, so a long vector elsewhere costs nothing.

Rows are dealt by hash of their id into shards of bounded bytes, queries into blocks; every block
meets every shard's tree once, by an equi-join on (shard, block). Each pair gives k rows a query at
most, and a window keeps the best k. Scores are computed anew on the original vectors, one product
after the other in double precision, so equal vectors have equal scores wherever they are.

Defined results: vectors that are null, zero or hold null or non-finite components take no part;
vectors of different lengths have no inner product, so each length is searched by itself; rows of
one id count once (the smallest vector by its bytes); equal vectors are all found, smaller ids
first; a null id takes no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128
#: More candidates than asked for, so that rounding in the tree's products can't cost a place.
SPARE = 8
#: Distances of products near 1 are right to about 1e-8.
ROUNDING = 1e-7


class VantageTree:
    """A tree over rows of ``x``, in numpy arrays that travel as one blob."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids,))
        ids, x = ids[order], x[order]
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(inverse.ravel(), kind="stable")  # ids of each distinct vector, in their order
        self.ids = ids[by]
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel(), minlength=len(self.x)))])
        y, norms = directions(self.x)
        self.place, nodes = np.arange(len(y)), []

        def build(lo: int, hi: int) -> int:
            me, own = len(nodes), self.place[lo:hi]
            nodes.append([lo, hi, -1, -1, -1, 0.0, norms[own].min(), norms[own].max()])
            if hi - lo > LEAF:
                middle = (hi - lo) // 2
                vantage = own[middle]
                d = chords(y[own] @ y[vantage])
                part = np.argpartition(d, middle)
                self.place[lo:hi] = own[part]
                edge = d[part[middle]]
                left = build(lo, lo + middle)
                nodes[me][2:6] = [left, build(lo + middle, hi), vantage, edge]
            return me

        if len(y):
            build(0, len(y))
        self.nodes = np.array(nodes, dtype=np.float64).reshape(-1, 8)

    def blob(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, ids=self.ids, offsets=self.offsets, place=self.place, nodes=self.nodes)
        return out.getvalue()

    @classmethod
    def of(cls, blob: bytes) -> VantageTree:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as f:
            own.x, own.ids, own.offsets, own.place, own.nodes = f["x"], f["ids"], f["offsets"], f["place"], f["nodes"]
        return own

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` and scores, by |q|, of the k nearest found of each query; -1 where there are fewer."""
        (y, norms), (q, _) = directions(self.x), directions(queries)
        best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)

        def visit(node: int, at: np.ndarray) -> None:
            lo, hi, left, right, vantage = self.nodes[node, :5].astype(int)
            if left < 0:
                own = self.place[lo:hi]
                d = (q[at] @ y[own].T) * norms[own]
                d, w = np.concatenate([best[at], d], 1), np.concatenate([who[at], np.broadcast_to(own, (len(at), len(own)))], 1)
                pick = np.argpartition(-d, k - 1, axis=1)[:, :k]
                best[at], who[at] = np.take_along_axis(d, pick, 1), np.take_along_axis(w, pick, 1)
                return
            edge = self.nodes[node, 5]
            d = chords(q[at] @ y[vantage])
            for near, far, own in ((left, right, d <= edge), (right, left, d > edge)):
                if own.any():
                    sub, gap = at[own], np.maximum(0.0, np.abs(d[own] - edge) - ROUNDING)
                    visit(near, sub)
                    least, most = self.nodes[far, 6:]
                    cos = 1 - np.minimum(2.0, gap / factor) ** 2 / 2
                    go = np.where(cos > 0, most, least) * cos >= best[sub].min(1) - ROUNDING * most
                    if go.any():
                        visit(far, sub[go])

        if len(self.nodes) and len(q):
            visit(0, np.arange(len(q)))
        return who, best

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the k best of this shard, without the query's own id."""
        who, _ = self.search(queries, k + SPARE, factor)
        at, slot = np.nonzero(who >= 0)
        distinct = who[at, slot]
        n = np.minimum(np.diff(self.offsets)[distinct], k + 1)  # further copies of a vector can't be among the k
        at, distinct, first = np.repeat(at, n), np.repeat(distinct, n), np.repeat(np.cumsum(n) - n, n)
        ids = self.ids[self.offsets[distinct] + np.arange(len(distinct)) - first]
        keep = ids != query_ids[at]
        at, distinct, ids = at[keep], distinct[keep], ids[keep]
        score = np.zeros(len(at))
        for c in range(self.x.shape[1]):
            score += queries[at, c].astype(np.float64) * self.x[distinct, c].astype(np.float64)
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < k
        return query_ids[at[keep]], ids[keep], score[keep]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and the lengths they had."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(1, initial=0.0)  # so that squares stay in range
    x /= scale[:, None]
    norms = np.sqrt((x * x).sum(1))
    return x / norms[:, None], norms * scale


def chords(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row an id, the smallest vector by its bytes."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tobytes()))
    keep = [i for n, i in enumerate(order) if not n or ids[i] != ids[order[n - 1]]]
    return ids[keep], x[keep]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def steps(dim: int, dtype, k: int, factor: float):
    """What runs on a shard, on a block of queries, and on a pair of both."""

    def matrix(column):
        return np.concatenate([np.zeros(0, dtype), *[c.flatten().to_numpy(zero_copy_only=False).astype(dtype) for c in column.chunks]]).reshape(-1, dim)

    def grow(group: pa.Table) -> pa.Table:
        tree = VantageTree(*once(group["id"].to_numpy(), matrix(group["v"])))
        return pa.table({"shard": pa.array([group["part"][0].as_py()], pa.int32()), "tree": pa.array([tree.blob()], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        ids, x = once(group["id"].to_numpy(), matrix(group["v"]))
        out = io.BytesIO()
        np.savez(out, ids=ids, x=x)
        return pa.table({"block": pa.array([group["part"][0].as_py()], pa.int32()), "queries": pa.array([out.getvalue()], pa.binary())})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            with np.load(io.BytesIO(right["queries"][0].as_py())) as f:
                found = VantageTree.of(left["tree"][0].as_py()).answer(f["ids"], f["x"], k, factor)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), found, (pa.int64(), pa.int64(), pa.float64()))})

    return grow, gather, meet


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 20, factor: float = 0.2, shard_bytes: int = 2 << 20, block_rows: int = 4096,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row where ``is_query``."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(
        F.col("id").isNotNull() & usable(F.col("v"))
    )
    sizes = own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq")).collect()
    out_schema = "query_id long, vec_id long, score double"
    spark, found = vectors.sparkSession, None
    for s in sizes:
        dim = s["dim"]
        shards = max(1, -(-s["n"] * dim * 8 // shard_bytes))
        blocks = max(1, -(-s["nq"] // block_rows))
        grow, gather, meet = steps(dim, np.float32 if kind == "float" else np.float64, k, factor)
        part = own.filter(F.size("v") == dim)
        dealt = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("part")
        trees = dealt(part.select("id", "v"), shards).applyInArrow(grow, "shard int, tree binary")
        asked = dealt(part.filter("q").select("id", "v"), blocks).applyInArrow(gather, "block int, queries binary")
        trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        each = trees.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, out_schema)
        found = each if found is None else found.unionByName(each)
    if found is None:
        found = spark.createDataFrame([], out_schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

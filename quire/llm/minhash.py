"""Near-duplicates by BagMinHash: weighted Jaccard over multisets of word shingles.

A text's shingles are all runs of ``shingle`` consecutive words, with their counts as weights; the
counts are the discretised weights. Each shingle's weight axis is cut into octaves (0, 1], (1, 2],
(2, 4] and so on, each with a Poisson process in time whose rate is the octave's length. A point
draws a register and, by hash bits, a place in its octave; it counts where the weight reaches its
place. Two texts see the same points below their smaller weight, so the first point of a register is
the same with a probability of exactly their weighted Jaccard similarity. Points come in order of
time, and a process stops once it is beyond all registers, so a signature costs a fixed number of
points besides one for each shingle.

Signatures are banded; texts that share a band meet in its bucket. No bucket emits its pairs. First
its members meet one hub, the text that shares most buckets with others, and those close to it are
linked. Classes are the connected components of links, so a bucket whose members are in one class by
now, through whatever bucket, is done. In the others, a member of the hub's class has to meet the
rest only if the triangle inequality (1 - weighted Jaccard is a metric) allows that they are close.
These meet in blocks of ``block`` members, which compute the overlap of members of different classes
and emit a spanning forest of the links. So classes are those that all pairs of each bucket would
give, while only what a hub can't decide is compared by pairs, within bounded blocks.

Texts with the same words are one text in all of this; their rows join their class at the end.

Defined results: words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A
text of fewer words than a shingle is one shingle of all of them. A null or empty text, or one
without words, is a class of its own. Rows of one key are told apart by their texts; the class id is
the least key of its rows, null where all are; exactly one row of a class is ``kept``. An empty
table gives no rows. Other columns are ignored or, in ``distinct_documents``, kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, joined_spread, renamed
from quire.session import discard, materialize

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
#: Words whose texts' signatures are drawn together, points that are drawn together, and shingles of hubs that a worker keeps.
TOGETHER, POINTS, KEPT = 400_000, 1 << 17, 1 << 20
HOLDS_POINT = np.uint64(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """(hashes of the distinct shingles, their counts) of lists of words."""

    def __init__(self, shingle: int):
        import xxhash

        self.shingle = shingle
        self.memo = Memo(xxhash.xxh64_intdigest, most=100_000)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.many([words])[0]

    def many(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = [len(words) for words in texts]
        w = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=sum(sizes))
        by = {n: self.hashed(w, n) for n in {min(self.shingle, size) for size in sizes} if n}
        out, at = [], 0
        for size in sizes:
            n = min(self.shingle, size)
            own = by[n][at : at + size - n + 1] if n else np.zeros(0, np.uint64)
            out.append(np.unique(own, return_counts=True))
            at += size
        return out

    @staticmethod
    def hashed(w: np.ndarray, n: int) -> np.ndarray:
        h = np.full(max(0, len(w) - n + 1), n, dtype=np.uint64)
        for i in range(n):
            h = h * MIX[0] + w[i : i + len(h)]
        return mix(h)


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode().lower()) if text else []


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of point hashes a bag; every bag holds a shingle at least."""
    sizes = np.array([len(h) for h, _ in bags])
    hashes, counts = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    octaves = 1 + np.ceil(np.log2(counts)).astype(np.int64)
    at = np.repeat(np.arange(len(hashes)), octaves)
    octave = np.arange(len(at)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    length = np.left_shift(1, np.maximum(octave - 1, 0))
    process = (mix(hashes[at] + octave.astype(np.uint64) * MIX[0]), length, np.where(octave > 0, length, 0), counts[at], owner[at])
    weight = np.bincount(owner, weights=counts, minlength=len(bags))
    horizon = registers / weight * (np.log(registers) + 4)  # all registers are met by then, but in a few bags of a hundred
    out = np.zeros((len(bags), registers), dtype=np.uint64)
    todo = np.arange(len(bags))
    while len(todo):
        mine = np.flatnonzero(np.isin(process[-1], todo))
        out[todo] = points([x[mine] for x in process], horizon, len(bags), registers)[todo]
        todo = todo[(out[todo] == 0).any(1)]
        horizon = horizon * 2
    return out


def points(process: list[np.ndarray], horizon: np.ndarray, bags: int, registers: int) -> np.ndarray:
    """The hash of each register's first point before the horizon, 0 where there is none."""
    first = np.full(bags * registers, np.inf)
    who = np.zeros(bags * registers, dtype=np.uint64)
    # Matrices hold the points of some processes; a process has about its rate times the horizon of these.
    points = np.cumsum(np.maximum(1.0, process[1] * horizon[process[-1]]))
    cuts = np.flatnonzero(np.diff((points / POINTS).astype(np.int64))) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(points)]):
        seed, length, offset, count, owner = (x[begin:end] for x in process)
        time, until, drawn, step = np.zeros(len(seed)), horizon[owner], 0, 1
        while len(seed):
            n = np.arange(drawn, drawn + step, dtype=np.uint64)
            x = mix(seed[:, None] + (n + np.uint64(1)) * MIX[0])
            t = time[:, None] + np.cumsum(-np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length[:, None], axis=1)
            y = mix(x + MIX[0])
            place = offset[:, None] + (y >> np.uint64(32)).astype(np.int64) % length[:, None] + 1
            hit = (t < until[:, None]) & (place <= count[:, None])
            row, t_hit, x_hit = np.nonzero(hit)[0], t[hit], x[hit]
            register = owner[row] * registers + ((y[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, register, t_hit)
            best = t_hit == first[register]
            who[register[best]] = x_hit[best] | HOLDS_POINT
            stay = t[:, -1] < until
            time = t[stay, -1]
            seed, length, offset, count, owner, until = (x[stay] for x in (seed, length, offset, count, owner, until))
            drawn, step = drawn + step, step * 2
    return who.reshape(bags, registers)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * MIX[0]), (len(signature), 1))
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for i in range(rows):
        out = mix(out * MIX[0] + parts[:, :, i])
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signed(docs: DataFrame, key: str, text: str, *, shingle: int, bands: int, rows: int, carry: list[str]) -> DataFrame:
    """A row each: rid, key, node (a digest of its words, null without any), and of texts new to their task bands and, unless it is carried, text."""
    kind, carried = docs.schema[key].dataType.simpleString(), text in carry
    fields = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        from pyspark import TaskContext

        shingler = Shingler(shingle)
        fresh = Memo(lambda k: True, most=100_000)
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                nodes, new, bags, size, begin = [], [], [], 0, at
                while at < batch.num_rows and size < TOGETHER:
                    words = words_of(texts[at].as_py())
                    size += len(words)
                    node = hashlib.md5(b" ".join(words)).digest() if words else None
                    if node is not None and node not in fresh and node not in fresh.old:
                        fresh[node]
                        new.append(len(nodes))
                        bags.append(words)
                    nodes.append(node)
                    at += 1
                banded, own = [None] * len(nodes), [None] * len(nodes)
                if bags:
                    for i, b in zip(new, band_hashes(signatures(shingler.many(bags), bands * rows), bands).view(np.int64)):
                        banded[i], own[i] = b, None if carried else texts[begin + i].as_py()
                part = batch.slice(begin, len(nodes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(rid, rid + len(nodes)), pa.int64()), part.column(0), pa.array(nodes, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(own, pa.string()), *part.columns[2:]],
                    names=["rid", "key", "node", "bands", "own", *carry],
                )
                rid += len(nodes)

    return docs.select(F.col(key), text, *carry).mapInArrow(run, f"rid long, key {kind}, node binary, bands array<long>, own string{fields}")


def compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hub, far) of pairs of nodes: 1 - the similarity of their texts."""
    members = texts.select("node", F.col("own").alias("text"))
    hubs = texts.select(F.col("node").alias("hub"), F.col("own").alias("hub_text"))

    def run(batches):
        shingler = Shingler(shingle)
        known, size = {}, 0
        for batch in batches:
            far = []
            for i, hub in enumerate(batch.column(1).to_pylist()):
                if hub not in known:
                    if size > KEPT:
                        known, size = {}, 0
                    known[hub] = shingler(words_of(batch.column(3)[i].as_py()))
                    size += len(known[hub][0])
                far.append(1 - overlap(known[hub], shingler(words_of(batch.column(2)[i].as_py()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64())], names=["node", "hub", "far"])

    met = joined_spread(pairs.join(members, "node"), hubs, "hub", "node").select("node", "hub", "text", "hub_text")
    return met.mapInArrow(run, "node binary, hub binary, far double")


def elements(nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, elements): the multiset of shingles as a set, the n-th copy of a shingle an element of its own."""

    def run(batches):
        shingler = Shingler(shingle)
        for batch in batches:
            sets = []
            for t in batch.column(1):
                h, c = shingler(words_of(t.as_py()))
                copy = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                sets.append(mix(np.repeat(h, c) + copy.astype(np.uint64) * MIX[1]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "elements"])

    return nodes.select("node", "own").mapInArrow(run, "node binary, elements array<long>")


def forest(roots: list[bytes], sets: list[np.ndarray], most: float) -> list[tuple[bytes, bytes]]:
    """Links between classes, which join all that have close members."""
    n = len(roots)
    sizes = np.array([len(x) for x in sets], dtype=np.float32)
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at) > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    keep = often[at]
    both = np.zeros((n, n), dtype=np.float32)
    row, col, width = row[keep], place[at[keep]], int(often.sum())
    for begin in range(0, width, 4096):
        own = (col >= begin) & (col < begin + 4096)
        part = np.zeros((n, min(4096, width - begin)), dtype=np.float32)
        part[row[own], col[own] - begin] = 1
        both += part @ part.T
    far = 1 - both / (sizes[:, None] + sizes[None, :] - both)
    near = np.triu(far <= most, 1)
    up = {r: r for r in roots}

    def top(r):
        while up[r] != r:
            r = up[r]
        return r

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def met_in_blocks(state: DataFrame, texts: DataFrame, *, shingle: int, most: float, block: int) -> DataFrame:
    """(a, b): the classes with close members in the buckets of ``state`` (bucket, node, root, members), as far as it joins them."""
    sized = state.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    # Members of a bucket of several blocks meet every other block of it.
    placed = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root"
    )
    involved = elements(texts.join(state.select("node").distinct(), "node", "left_semi"), shingle)
    full = placed.join(involved, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def run(batches):
        held, open_key = [], None

        def close():
            if len(held) < 2:
                return
            found = forest(*map(list, zip(*held)), most)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            roots, lists = batch.column(3).to_pylist(), batch.column(4)
            for n, key in enumerate(keys):
                if key != open_key:
                    yield from close()
                    held, open_key = [], key
                held.append((roots[n], lists[n].values.to_numpy(zero_copy_only=False)))
        yield from close()

    return full.select("bucket", "i", "j", "root", "elements").mapInArrow(run, "a binary, b binary")


def roots_of(buckets: DataFrame, texts: DataFrame, *, shingle: int, most: float, block: int) -> DataFrame:
    """(node, root) of the nodes that are close to another, directly or through others. ``buckets``: (bucket, node)."""
    sized = joined_spread(buckets, buckets.groupBy("bucket").agg((F.count("*") - 1).alias("others")), "bucket", "node")
    shared = sized.groupBy("node").agg(F.sum("others").alias("shared"))
    hubs = buckets.join(shared, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("shared")).alias("order"), "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub"))
    met = materialize(joined_spread(buckets, hubs, "bucket", "node").filter("node != hub").select("bucket", "node", "hub"), "met")
    found = materialize(compared(met.select("node", "hub").distinct(), texts, shingle), "pairs")
    links = found.filter(F.col("far") <= most).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    roots = components(links)
    of_node, of_hub = roots.withColumnRenamed("root", "r"), roots.select(F.col("node").alias("hub"), F.col("root").alias("h"))
    seen = joined_spread(met.join(found, ["node", "hub"]).join(of_node, "node", "left"), of_hub, "hub", "node", "left").select(
        "bucket", "node", "far", F.coalesce("r", "node").alias("root"), (F.coalesce("r", "node") != F.coalesce("h", "hub")).alias("apart")
    )
    seen = materialize(seen, "seen")
    # The hub has met everyone and leaves; so do members of its class that can't be close to one of another.
    bounds = seen.filter("apart").groupBy("bucket").agg(F.min("far").alias("nearest"))
    near = joined_spread(seen, bounds, "bucket", "node").filter(F.col("apart") | (F.col("far") >= F.col("nearest") - most - 1e-9))
    staying = materialize(near.select("bucket", "node", "root"), "staying")
    several = staying.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members")).filter("least != most").select("bucket", "members")
    apart = materialize(joined_spread(staying, several, "bucket", "node"), "apart")
    more = materialize(met_in_blocks(apart, texts, shingle=shingle, most=most, block=block), "more")
    for old in (met, seen, staying, apart):
        discard(old)
    if not more.limit(1).count():
        return roots
    tops = components(more).select("node", "root")
    of_root = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = joined_spread(roots, of_root, "root", "node", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.unionByName(tops.join(roots.select("node"), "node", "left_anti"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by least labels and pointer jumping."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), "labels")
    while True:
        near = joined_spread(both, labels.select(F.col("node").alias("u"), "root"), "u", "v").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = materialize(joined_spread(step, up, "root", "node").select("node", F.least("root", "up").alias("root"), "was"), "labels")
        changed = jumped.filter("root != was").limit(1).count()
        discard(labels)
        labels = jumped
        if not changed:
            discard(both)
            return labels


def classed(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 5, block: int = 512, key: str, text: str, carry: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: every row's rid, key, node and ``carry``; each node's class (key, rid of the row that is kept); the rid of each class's kept row."""
    table = materialize(signed(docs, key, text, shingle=shingle, bands=bands, rows=rows, carry=carry), "signed")
    least = F.min(F.struct(F.col("key").isNull().alias("n"), "key", "rid")).alias("least")
    nodes = materialize(
        table.filter("node is not null").groupBy("node").agg(least, F.min(F.when(F.col("bands").isNotNull(), F.col("rid"))).alias("rid")), "nodes"
    )
    sole = table.filter("bands is not null").join(nodes.select("node", "rid"), ["node", "rid"], "left_semi")
    placed = sole.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").count().filter("count > 1").select("bucket")
    buckets = materialize(joined_spread(placed, shared, "bucket", "node").select("bucket", "node"), "buckets")
    texts = materialize(sole.select("node", F.col(text if text in carry else "own").alias("own")).join(buckets.select("node").distinct(), "node", "left_semi"), "texts")
    roots = roots_of(buckets, texts, shingle=shingle, most=1 - similarity + 1e-9, block=block)
    discard(buckets)
    discard(texts)
    of_node = nodes.select("node", "least").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = of_node.groupBy("root").agg(F.min("least").alias("class"))
    own = materialize(joined_spread(of_node.select("node", "root"), of_root, "root", "node").select("node", "class"), "classes")
    return table, own, own.select(F.col("class.rid").alias("rid")).distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: key, class_id and whether it is the one of its class that is kept."""
    table, classes, _ = classed(docs.select(F.col(f"`{key}`").alias("c0"), F.col(f"`{text}`").alias("c1")), key="c0", text="c1", carry=[], **options)
    out = joined_spread(table.select("rid", "key", "node"), classes, "node", "rid", "left")
    alone = F.col("node").isNull()
    return out.select(F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("class.key")).alias("class_id"), (alone | (F.col("rid") == F.col("class.rid"))).alias("kept"))


def distinct_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    plain, names = renamed(docs)
    table, _, kept = classed(plain, key=names[key], text=names[text], carry=list(names.values()), **options)
    rows = table.filter("node is null").unionByName(table.join(kept, "rid", "left_semi"))
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])

"""Substring dedup: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes where it is covered by a ``width``-byte string that also starts earlier, by
(key, start); strings are judged on the input, not on what is left, and never cross documents.

One transform over a corpus can't be built in bounded memory, so windows are dealt first. Every
window of ``width`` bytes has a least hash among its ``seed``-byte strings; equal windows share it,
so windows with the same least hash (a bucket) meet in one task and windows whose least hash is
nowhere else are left out. Consecutive windows of a document with one least hash travel as one
segment. Equal segments are pre-aggregated: all but the first lose every byte, and only distinct
segments go on. A bucket with more than ``hot`` distinct segments is cut into single windows, which
are pre-aggregated by the whole window, so no task gets an unbounded bucket.

A task takes buckets in chunks of ``chunk_bytes``, builds the Burrows-Wheeler order of a chunk, and
derives its common prefixes breadth first by increasing value: boundaries between intervals of
prefixes of n symbols give, one backward extension further, those of n + 1. It stops at ``width``;
rows that are still without a boundary share the whole window. Symbols are groups of bytes, so
that there are only width / group levels.

Defined results: a null text is empty; texts under ``width`` bytes lose nothing; rows of one key
are documents of their own, in the order of their texts' hashes, null keys first; a wholly repeated
row is a later copy; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SLICE, keyed
from quire.session import discard, materialize

ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)
#: Windows that are hashed at a time, and windows of a segment at most.
BLOCK, LONGEST = 1 << 17, 64


class Hasher:
    """Least hashes of the windows of a text, in blocks of bounded size."""

    def __init__(self, width: int, seed: int):
        self.width, self.seed, self.reach = width, seed, width - seed + 1
        powers = np.full((2, BLOCK + width + 1), [[ODD], [BACK]], dtype=np.uint64)
        powers[:, 0] = 1
        self.up, self.down = np.cumprod(powers, axis=1, dtype=np.uint64)

    def least(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all seeds, and the least of those in each window."""
        n = len(data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[self.seed :] - total[: -self.seed]) * self.down[: n - self.seed + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        m, span = h, 1
        while span * 2 <= self.reach:
            m, span = np.minimum(m[:-span], m[span:]), span * 2
        count = n - self.width + 1
        return h, np.minimum(m[:count], m[self.reach - span : self.reach - span + count])

    def inner(self, h: np.ndarray, least: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """True for segments with their least hash in two places, which may hold a window twice."""
        seen = np.lib.stride_tricks.sliding_window_view(h, self.reach)
        first = start + (seen[start] == least[:, None]).argmax(1)
        last = end - 1 + self.reach - 1 - (seen[end - 1][:, ::-1] == least[:, None]).argmax(1)
        return first != last

    def segments(self, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the block, hashes of its seeds; least hash, first window and end of each segment)."""
        whole = np.frombuffer(text, dtype=np.uint8)
        for at in range(0, len(whole) - self.width + 1, BLOCK):
            h, m = self.least(whole[at : at + BLOCK + self.width - 1].astype(np.uint64))
            edge = np.concatenate([[True], m[1:] != m[:-1]])
            start = np.flatnonzero(edge)
            # A run of windows over LONGEST is cut, from its own start on.
            size = np.diff(np.append(start, len(m)))
            if size.max() > LONGEST:
                parts = -(-size // LONGEST)
                first = np.repeat(start, parts)
                start = first + LONGEST * (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts))
            yield at, h, m[start], start, np.append(start[1:], len(m))


def texts_of(batches, column: int) -> Iterator[tuple[list, list[bytes], pa.RecordBatch]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0).to_pylist(), [t.encode() if t else b"" for t in part.column(column).to_pylist()], part


def least_hashes(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(k, mh) of every segment of every text, twice where it may hold a window twice."""

    def run(batches):
        hasher = Hasher(width, seed)
        for keys, texts, _ in texts_of(batches, 1):
            ks, ms = [], []
            for k, text in zip(keys, texts):
                for _, h, m, start, end in hasher.segments(text):
                    m = np.concatenate([m, m[hasher.inner(h, m, start, end)]])
                    ks.append(np.full(len(m), k, dtype=np.int64))
                    ms.append(m.view(np.int64))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks)), pa.array(np.concatenate(ms))], names=["k", "mh"])

    return docs.select("k", "text").mapInArrow(run, "k long, mh long")


def wanted_segments(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(mh, content, k, start, inner) of the segments whose least hash is in ``wanted``; ``inner``: it may hold a window twice."""

    def run(batches):
        hasher = Hasher(width, seed)
        for keys, texts, part in texts_of(batches, 1):
            out = [[], [], [], [], []]
            for k, text, want in zip(keys, texts, part.column(2)):
                want = np.sort(want.values.to_numpy(zero_copy_only=False)).view(np.int64)
                for at, h, m, start, end in hasher.segments(text):
                    own = m.view(np.int64)
                    place = np.minimum(np.searchsorted(want, own), len(want) - 1)
                    keep = np.flatnonzero(want[place] == own)
                    if not len(keep):
                        continue
                    s, e, least = start[keep], end[keep], m[keep]
                    out[0].append(own[keep])
                    out[1] += [text[at + i : at + j + width - 1] for i, j in zip(s.tolist(), e.tolist())]
                    out[2].append(np.full(len(keep), k, dtype=np.int64))
                    out[3].append(at + s)
                    out[4].append(hasher.inner(h, least, s, e))
            if out[0]:
                a = [np.concatenate(out[i]) for i in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[0]), pa.array(out[1], pa.binary()), pa.array(a[1]), pa.array(a[2].astype(np.int64)), pa.array(a[3])], names=["mh", "content", "k", "start", "inner"]
                )

    return docs.select("k", "text", "wanted").mapInArrow(run, "mh long, content binary, k long, start long, inner boolean")


def byte_group(width: int) -> int:
    return max(g for g in range(1, 9) if width % g == 0)


def leading(text: np.ndarray, symbols: int) -> np.ndarray:
    """The first ``symbols`` bytes of each suffix as one number."""
    out = np.zeros(len(text), dtype=np.uint64)
    padded = np.concatenate([text, np.zeros(symbols, dtype=np.uint8)])
    for i in range(symbols):
        out = (out << np.uint64(8)) | padded[i : i + len(text)]
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling: only those that still share a rank are sorted again."""
    n, known = len(text), 8
    key = leading(text, known)
    order = np.argsort(key)
    edge = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.zeros(n + 1, dtype=np.uint64)  # a rank is its first row, counted from 1; 0 beyond the end
    rank[order] = np.maximum.accumulate(np.where(edge, np.arange(n), 0)) + 1
    rows = np.flatnonzero(~edge | ~np.append(edge[1:], True))
    while len(rows) and known < n:
        who = order[rows]
        key = (rank[who] << np.uint64(32)) | rank[np.minimum(who + known, n)]
        by = np.argsort(key)
        who, key = who[by], key[by]
        edge = np.concatenate([[True], np.diff(key) != 0])
        order[rows] = who
        rank[who] = np.maximum.accumulate(np.where(edge, rows, 0)) + 1
        rows = rows[~edge | ~np.append(edge[1:], True)]
        known *= 2
    return order


def expanded(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """True where a row of the order doesn't share its first ``width`` bytes with the row before.

    Backward extension: row j's suffix without its first symbol stands in row after[j]; two rows that
    share a symbol share one symbol more than the rows after them do. So the boundaries of the
    intervals of n symbols give those of n + 1, by increasing n, and the expansion stops at ``width``.
    """
    n, group = len(text), byte_group(width)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    after = place[np.minimum(order + group, n - 1)]
    symbol = leading(text, group)[order]
    bound = np.concatenate([[True], symbol[1:] != symbol[:-1]])  # intervals of one symbol
    rows = np.flatnonzero(~bound)
    low, high = after[rows - 1], after[rows]
    for _ in range(width // group - 1):
        upto = np.cumsum(bound, dtype=np.int32)
        found = upto[high] > upto[low]
        if not found.any():
            break
        bound[rows[found]] = True
        stay = ~found
        rows, low, high = rows[stay], low[stay], high[stay]
    return bound


def repeated_windows(contents: list[bytes], keys: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the runs of windows that also start earlier, by (key, start), in some content."""
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    text = np.frombuffer(b"\0".join(contents) + bytes(width + 8), dtype=np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(contents)), sizes - width + 1)
    first = np.repeat(begin, sizes - width + 1)
    at = first + np.arange(len(owner)) - np.repeat(np.cumsum(sizes - width + 1) - (sizes - width + 1), sizes - width + 1)
    order = suffix_order(text)
    bound = expanded(text, order, width)
    group = np.empty(len(text), dtype=np.int64)
    group[order] = np.cumsum(bound)
    g, k, s = group[at], keys[owner], starts[owner] + at - first
    by = np.lexsort((s, k, g))
    g, k, s = g[by], k[by], s[by]
    head = np.concatenate([[True], g[1:] != g[:-1]])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    gone = np.zeros(len(at), dtype=bool)
    gone[by] = (k != k[lead]) | (s != s[lead])
    # Consecutive windows of one content join.
    place = np.flatnonzero(gone)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.concatenate([[True], (np.diff(place) > 1) | (owner[place[1:]] != owner[place[:-1]])])
    one, end = place[cut], place[np.append(np.flatnonzero(cut)[1:], len(place)) - 1]
    from_start = lambda p: starts[owner[p]] + at[p] - first[p]
    return keys[owner[one]], from_start(one), from_start(end) + width


def expand(buckets: DataFrame, width: int, chunk_bytes: int) -> DataFrame:
    """(k, s, e) of repeated windows in whole buckets, which lie together in each partition."""

    def run(batches):
        held, size, open_deal = [], 0, None

        def spans():
            if not held:
                return
            contents = [c for part in held for c in part[0]]
            k, s, e = repeated_windows(contents, np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held]), width)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s), pa.array(e)], names=["k", "s", "e"])

        for batch in batches:
            deal = batch.column(0).to_numpy(zero_copy_only=False)
            contents = batch.column(1).to_pylist()
            k, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            at = 0
            for end in [*(np.flatnonzero(deal[1:] != deal[:-1]) + 1).tolist(), len(deal)]:
                if end == at:
                    continue
                if size >= chunk_bytes and deal[at] != open_deal:  # only between buckets
                    yield from spans()
                    held, size = [], 0
                held.append((contents[at:end], k[at:end], s[at:end]))
                size += sum(map(len, contents[at:end]))
                open_deal, at = deal[at], end
        yield from spans()

    return buckets.select("deal", "content", "k", "start").mapInArrow(run, "k long, s long, e long")


def repeated_singles(segments: DataFrame, width: int) -> DataFrame:
    """(k, s, e) of windows of hot buckets' segments that also start earlier: pre-aggregated by whole window."""
    n = F.length("content") - width + 1
    each = segments.select("k", "start", "content", F.explode(F.sequence(F.lit(1), n)).alias("i")).select(
        F.unhex(F.md5(F.expr(f"substring(content, i, {width})"))).alias("window"), "k", (F.col("start") + F.col("i") - 1).alias("s")
    )
    firsts = each.groupBy("window").agg(F.min(F.struct("k", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return each.join(firsts.select("window", F.col("first.k").alias("fk"), F.col("first.s").alias("fs")), "window").filter("k != fk or s != fs").select("k", "s", (F.col("s") + width).alias("e"))


def removed_spans(rows: DataFrame, *, width: int, seed: int, hot: int, chunk_bytes: int) -> list[DataFrame]:
    """Tables of (k, s, e): the bytes [s, e) of document k go."""
    runs = least_hashes(rows, width, seed)
    again = runs.groupBy("mh").count().filter("count > 1").select("mh")
    wanted = materialize(runs.join(again, "mh").groupBy("k").agg(F.collect_set("mh").alias("wanted")), "wanted")
    segments = materialize(wanted_segments(rows.join(wanted, "k"), width, seed), "segments")
    discard(wanted)
    own = F.xxhash64("content").alias("ch")
    distinct = materialize(
        segments.groupBy("mh", "content").agg(F.min(F.struct("k", "start")).alias("first"), F.count("*").alias("n"), F.max("inner").alias("inner"))
        .select("mh", "content", own, F.col("first.k").alias("k"), F.col("first.start").alias("start"), "n", "inner"), "distinct"
    )
    # All occurrences but the first of a repeated segment go as a whole.
    firsts = distinct.filter("n > 1").select("mh", "ch", F.col("k").alias("fk"), F.col("start").alias("fs"))
    places = segments.select("mh", own, "k", "start", (F.col("start") + F.length("content")).alias("e"))
    later = materialize(places.join(firsts, ["mh", "ch"]).filter("k != fk or start != fs").select("k", F.col("start").alias("s"), "e"), "later")
    discard(segments)
    sizes = distinct.groupBy("mh").agg(F.count("*").alias("contents"))
    bucketed = distinct.join(sizes, "mh").filter("contents > 1 or inner")
    cold = bucketed.filter(F.col("contents") <= hot).select(F.col("mh").alias("deal"), "content", "k", "start")
    dealt = cold.repartition("deal").sortWithinPartitions("deal", "content", "k", "start")
    spans = [materialize(expand(dealt, width, chunk_bytes), "cold"), materialize(repeated_singles(bucketed.filter(F.col("contents") > hot), width), "split")]
    discard(distinct)
    return [later, *spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return data
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def dedup_substrings(
    docs: DataFrame, *, width: int = 100, seed: int = 50, hot: int = 4096, chunk_bytes: int = 2 << 20, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row a document: key, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the bytes that stay."""
    if not 8 <= seed <= width:
        raise ValueError("seed must be 8 to width bytes")
    rows = keyed(docs, key, text)
    spans = None
    for part in removed_spans(rows, width=width, seed=seed, hot=hot, chunk_bytes=chunk_bytes):
        spans = part if spans is None else spans.unionByName(part)
    by_row = spans.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [[], [], [], [], []]
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = t.encode()
                    gone = merged([(x["s"], x["e"]) for x in spans or ()])
                    kept = without(data, gone)
                    for c, v in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(by_row, "k", "left").select("key", "text", "spans").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

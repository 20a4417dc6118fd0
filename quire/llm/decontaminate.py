"""Benchmark decontamination: hash set of normalised test n-grams against every training window.

Words: A-Z lower-cased, then maximal runs of digits, a-z and all characters beyond ASCII. A window
is ``width`` consecutive words of a benchmark item, or all its words where it has fewer, but some.
A document word inside any occurrence of a window is hit.

The windows go to the executors as a hash set, at most ``block_windows`` at a time; a benchmark
beyond that is scanned in as many passes as it has blocks, each written before the next block is
read, and the marks of the passes are joined, so its size never decides what is found. A hash hit is verified word by word.

Defined results: a null or empty text has no words and is clean; an item without words has no
window; repeated items are one item by their id; an item with a null id still hits words but isn't
counted or named; repeated documents give repeated rows; other columns of either table are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_rows, renamed
from quire.session import discard, materialize

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """In UTF-8, a character beyond ASCII is a run of bytes of 128 and more."""
    return WORDS.findall(text.encode().lower()) if text else []


def windows(text: str | None, width: int) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


class Scanner:
    """Finds the occurrences of a block of windows: {words of a window: its item ids}."""

    def __init__(self, block: dict[tuple[bytes, ...], list]):
        self.block = block
        self.ids = {w: i for i, w in enumerate(sorted({w for t in block for w in t}), 1)}
        self.powers = [BASE**k for k in range(max(map(len, block), default=0) + 1)] if block else []
        by = defaultdict(list)
        for t in block:
            by[len(t)].append(self.hashed(np.array([self.ids[w] for w in t], dtype=np.uint64), len(t))[0])
        self.by = {n: np.unique(np.array(h, dtype=np.uint64)) for n, h in by.items()}
        self.filters = {n: self.filtered(h) for n, h in self.by.items()}

    def hashed(self, codes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * BASE + codes[k : len(codes) - n + 1 + k]
            out ^= out >> np.uint64(29)
            out *= BASE
        return out

    @staticmethod
    def filtered(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        bits = max(16, min(26, int(len(hashes)).bit_length() + 6))
        table = np.zeros(1 << bits, dtype=bool)
        down = np.uint64(64 - bits)
        table[(hashes >> down).astype(np.int64)] = True
        return table, down

    def scan(self, text: str | None) -> tuple[list[bytes], list[tuple[int, int]], list[tuple[bytes, ...]]]:
        """Words; (start, length) of each occurrence, in words; the windows that occur."""
        w = words(text)
        if not w or not self.block:
            return w, [], []
        codes = np.fromiter(map(self.ids.get, w, (0,) * len(w)), dtype=np.uint64, count=len(w))
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        found, kinds = [], set()
        for n, hashes in self.by.items():
            if len(w) < n:
                continue
            starts = np.nonzero(known[n:] - known[:-n] == n)[0]  # every word is some item's
            if not len(starts):
                continue
            h = self.hashed(codes, n)[starts]
            table, down = self.filters[n]
            near = table[(h >> down).astype(np.int64)]
            starts, h = starts[near], h[near]
            for i in starts[np.isin(h, hashes)].tolist():
                t = tuple(w[i : i + n])
                if t in self.block:  # the hash hit is verified
                    found.append((i, n))
                    kinds.add(t)
        return w, found, list(kinds)


def hit_words(n_words: int, found: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for i, n in found:
        edge[i] += 1
        edge[i + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def blocks_of(benchmark: DataFrame, width: int, block_windows: int, key: str, text: str):
    """The benchmark's windows in blocks of bounded size, read by the driver a block at a time."""
    block: dict[tuple[bytes, ...], list] = {}
    for row in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        for t in windows(row["t"], width):
            if t not in block and len(block) >= block_windows:
                yield block
                block = {}
            own = block.setdefault(t, [])
            if row["k"] is not None and str(row["k"]) not in own:
                own.append(str(row["k"]))
    yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, width: int = 10, mode: str = "report", block_windows: int = 100_000,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``report``: (key, n_words, n_hit, n_items, items_sha256, contaminated) of every document.
    ``documents``: the rows of ``docs`` that aren't contaminated, with all their columns.
    ``spans``: all rows of ``docs``, without the words that are hit and what stands between them."""
    if mode not in ("report", "documents", "spans"):
        raise ValueError(f"no such mode: {mode}")
    blocks = blocks_of(benchmark, width, block_windows, item, item_text)
    block, following = next(blocks), next(blocks, None)
    if following is not None:
        return in_passes(docs, chain([block, following], blocks), mode, key, text)
    if mode == "report":
        return counted(marked(docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_text")), block), F.col("_k").alias(key))
    plain, names = renamed(docs)
    return filtered(plain, block, mode, names[text]).toDF(*names)


def counted(marks: DataFrame, key: Column) -> DataFrame:
    return marks.select(
        key, "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def marked(rows: DataFrame, block) -> DataFrame:
    """(_k, n_words, hits, items) of rows of (_k, text): the places of the words that are hit, and the items, sorted as strings."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def make():
        scanner = Scanner(shared.value)

        def work(columns):
            out = [columns[0], [], [], []]
            for t in columns[1]:
                w, found, kinds = scanner.scan(t)
                out[1].append(len(w))
                out[2].append(np.nonzero(hit_words(len(w), found))[0].tolist() if found else [])
                out[3].append(sorted({i for t in kinds for i in scanner.block[t]}))
            return out

        return work

    return map_rows(rows, make, f"_k {rows.schema['_k'].dataType.simpleString()}, n_words long, hits array<int>, items array<string>")


def in_passes(docs: DataFrame, blocks: Iterator, mode: str, key: str, text: str) -> DataFrame:
    """One pass a block, written before the next block is read, so that the driver holds two blocks at most.

    A report and the cut of spans need every row's marks of all passes, since windows overlap: rows
    are numbered, and their marks joined by number.
    """
    plain, names = renamed(docs)
    if mode == "documents":
        out = plain
        for block in blocks:
            before, out = out, materialize(filtered(out, block, mode, names[text]), "clean")
            discard(before)
        return out.toDF(*names)
    rows = materialize(plain.withColumn("_k", F.monotonically_increasing_id()), "rows")
    texts = rows.select("_k", F.col(names[text]).alias("_text"))
    every = None
    for block in blocks:
        own = materialize(marked(texts, block).filter("size(hits) > 0"), "marks")
        every = own if every is None else every.unionByName(own)
    merged = every.groupBy("_k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<string>")
    marks = rows.select("_k").join(merged, "_k", "left").select("_k", F.coalesce("hits", none.cast("array<int>")).alias("hits"), F.coalesce("items", none).alias("items"))
    if mode == "report":
        sizes = marked(texts, {}).select("_k", "n_words")
        return counted(rows.select("_k", F.col(names[key]).alias("_key")).join(sizes, "_k").join(marks, "_k"), F.col("_key").alias(key))
    return cut(rows.join(marks.drop("items"), "_k").drop("_k"), names[text]).toDF(*names)


def cut(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a last column ``hits``: without it, and without the words that it names."""
    at = docs.columns.index(text)

    def make():
        def work(columns):
            *kept, hits = columns
            texts = []
            for t, h in zip(kept[at], hits):
                if h:
                    hit = np.zeros(len(words(t)), dtype=bool)
                    hit[h] = True
                    t = without(t, hit)
                texts.append(t)
            kept[at] = texts
            return kept

        return work

    return map_rows(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "hits"))


def filtered(docs: DataFrame, block, mode: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at = docs.columns.index(text)

    def make():
        scanner = Scanner(shared.value)

        def work(columns):
            keep, texts = [], []
            for i, t in enumerate(columns[at]):
                w, found, _ = scanner.scan(t)
                if not found or mode == "spans":
                    keep.append(i)
                    texts.append(without(t, hit_words(len(w), found)) if found else t)
            out = [[c[i] for i in keep] for c in columns]
            out[at] = texts
            return out

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, make, schema)


def without(text: str, hit: np.ndarray) -> str:
    """The text without its runs of hit words; what remains on either side is set off by a line end."""
    data = text.encode()
    spans = [m.span() for m in WORDS.finditer(data.lower())]
    out, at, i = [], 0, 0
    while i < len(spans):
        if hit[i]:
            j = i
            while j + 1 < len(spans) and hit[j + 1]:
                j += 1
            out.append(data[at : spans[i][0]])
            at, i = spans[j][1], j
        i += 1
    out.append(data[at:])
    return b"\n".join(out).decode()

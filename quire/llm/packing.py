"""Bounded-space online best-fit packing of token sequences.

Documents become token ids and an end id; only a document longer than a sequence is cut, into
pieces of a full sequence and a last one. Pieces are packed online: a bitset has bit f set while a
bin with f places free is open, so that the tightest bin that takes a piece is the lowest set bit
from its length on. At most ``open_bins`` are open; when another must open, the fullest closes.

Tokens are counted where the texts are; only (key, piece, start, length, checksum) moves. The
pieces are dealt by hash to as many packers as the tokens need, so bins that stay part full are a
fixed number for each ``tokens_per_packer`` tokens.

Defined results: a null or empty text is the end id alone; repeated rows are packed each by
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, map_rows
from quire.llm.token_counts import byte_alphabet
from quire.session import materialize

#: What the vocabulary's pattern splits, for the characters that are usual here.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: All but characters that stay as they are under NFC, that every Unicode version classes alike and that aren't numbers beyond 0-9.
UNUSUAL = re.compile(r"[^\t\n\r -~¡-±´-¸º»¿-įĲ-ɏ–—‘-„…]|<\|")


@cache
def encoder(vocabulary: str):
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    No token crosses white space: what stands between goes through a memo, and where it is new its
    words do, and a new word through the vocabulary's merges. A worker keeps both memos for all of its
    tasks. A text with unusual characters goes through the library as a whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    model = json.load(open(vocabulary, encoding="utf-8"))["model"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    ids, tail, letters, never = model["vocab"], model["end_of_word_suffix"], byte_alphabet(), len(model["merges"])

    of = ranks.get

    def encoded(word: str) -> bytes:
        parts = list(word) if word.isascii() else [letters[b] for b in word.encode()]
        parts[-1] += tail
        rank = [of(pair, never) for pair in zip(parts, parts[1:])]
        while rank and (least := min(rank)) < never:
            i = rank.index(least)
            parts[i] = own = parts[i] + parts.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = of((own, parts[i + 1]), never)
            if i:
                rank[i - 1] = of((parts[i - 1], own), never)
        return array("I", [ids[p] for p in parts]).tobytes()

    words = Memo(encoded, most=800_000)

    def of_part(part: str) -> bytes:
        if part.isalpha():
            return words[part]
        if part[:-1].isalpha():
            return words[part[:-1]] + words[part[-1]]
        return b"".join(map(words.__getitem__, SPLIT.findall(part)))

    parts = Memo(of_part, most=800_000)
    seen = parts.__getitem__

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        plain = text.isascii() and text.replace("\n", " ").isprintable() and "<|" not in text  # quicker than the pattern
        if not plain and UNUSUAL.search(text):
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(seen, text.lower().split()))

    return encode


class Bins:
    """Open bins by free space. ``place`` gives (bin, offset) of a piece."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.free, self.n_open, self.n_bins = 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            own = self.take(space)
        else:
            if self.n_open >= self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, own = self.size, self.n_bins
            self.n_bins += 1
        if left := space - length:
            self.free.setdefault(left, []).append(own)
            self.bits |= 1 << left
            self.n_open += 1
        return own, self.size - space

    def take(self, space: int) -> int:
        stack = self.free[space]
        own = stack.pop()
        if not stack:
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return own


def pieces(docs: DataFrame, vocabulary: str, *, size: int, end: int, key: str, text: str) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece of every document."""

    def make():
        encode, tail = encoder(vocabulary), array("I", [end]).tobytes()

        def work(columns):
            out = [[], [], [], [], []]
            for k, t in zip(*columns):
                ids = encode(t) + tail
                for i, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    for c, v in zip(out, (k, i, at // 4, len(own) // 4, zlib.crc32(own))):
                        c.append(v)
            return out

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, vocabulary: str, *, size: int = 2048, end: int = 0, open_bins: int = 256,
    tokens_per_packer: int = 16_000_000, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id and offset in the sequence."""
    cut = materialize(pieces(docs, vocabulary, size=size, end=end, key=key, text=text), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // tokens_per_packer))
    # Dealt in a fixed order, so that a packer that runs again packs alike.
    dealt = cut.repartition(packers, F.xxhash64(key, "piece", "ids_crc32")).sortWithinPartitions(F.xxhash64(key, "ids_crc32"), key, "piece", "ids_crc32")

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        bins = Bins(size, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            columns = [*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return dealt.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


__all__ = ["Bins", "encoder", "pack", "pieces"]

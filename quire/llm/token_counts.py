"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token is a doubly linked list of byte symbols; a heap holds its adjacent pairs by merge
rank, then by place. The lowest pair is popped and merged until none is left. The count is the
number of initial symbols minus the merges: no identifier is ever looked up or emitted.

Defined results: a null or empty text has 0 bytes and 0 tokens; every input row gives one row, so
repeated rows repeat; a string of the vocabulary's special tokens counts as one token, as the
library's default does; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, map_rows

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every Unicode version classes alike; a text with others is split by the library.
UNUSUAL = re.compile(r"[^\t\n\r -~¡-ɏ–—‘-„…]")


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging always the pair of lowest rank, leftmost first."""
    n = len(symbols)
    if n < 2:
        return n
    after, before, parts = [*range(1, n), -1], [*range(-1, n - 1)], list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    left = n
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if j < 0 or parts[i] != a or parts[j] != b:
            continue  # one side was merged meanwhile
        parts[i], parts[j] = a + b, ""
        after[i] = k = after[j]
        after[j] = -1
        left -= 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heappush(heap, (r, h, parts[h], parts[i]))
    return left


@cache
def counter(vocabulary: str) -> Callable[[str], int]:
    """Tokens of a text under a byte-level BPE vocabulary file of the ``tokenizers`` library. A worker keeps its memo for all of its tasks."""
    from tokenizers import pre_tokenizers

    spec = json.load(open(vocabulary, encoding="utf-8"))
    merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
    special = [t["content"] for t in spec["added_tokens"]]
    pieces = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    words, letters = regex.compile(SPLIT).findall, byte_alphabet()
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def of_word(word: str) -> int:
        return merged_count([letters[b] for b in word.encode()], ranks)

    memo = Memo(of_word, most=400_000)
    seen = memo.__getitem__

    def plain(text: str) -> int:
        if UNUSUAL.search(text):
            return sum(merged_count(list(w), ranks) for w, _ in library.pre_tokenize_str(text))
        return sum(map(seen, words(text)))

    def count(text: str | None) -> int:
        if not text:
            return 0
        if pieces is None or not pieces.search(text):
            return plain(text)
        return sum(map(plain, filter(None, pieces.split(text)))) + len(pieces.findall(text))

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: its bytes, its tokens and whether they are over ``limit``. No shuffle."""

    def make():
        count = counter(vocabulary)

        def work(columns):
            ids, texts = columns
            tokens = [count(t) for t in texts]
            return [ids, [len(t.encode()) if t else 0 for t in texts], tokens, [n > limit for n in tokens]]

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")), make, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

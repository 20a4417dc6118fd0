"""Hidden Markov language model with exact sequence likelihoods.

Tokens are the white-space words, A-Z lower-cased, and one end a text. Counts of all training
tokens are a shuffled table; the most frequent ``own_symbols`` tokens (``lookup`` at most) travel to
the executors, all others meet their counts in a join. The model's symbols are these tokens and
``classes`` classes of all others by their last two bytes:

    P(token | state) = P(symbol | state) * P(token | symbol, state)

The last factor is 1 for a token with a symbol of its own. Each of all others has expected counts n
by state in a shuffled table, which every pass makes anew and which is joined back to the texts:

    P(token | class, state) = (n + a) / (N + a (V + 1)),  a = N / C

in a class of C occurrences of V distinct tokens, N of them in the state. That is (c + 1) / (C + V + 1)
where a token's states are those of its class, before the first pass and for unknown tokens. Baum-Welch runs first on a bounded sample, to leave
the symmetric start, and then ``passes`` times over every whole training text: each partition's
expected counts are summed by symbol with a shuffle. Scores come from the
scaled forward recursion over each whole text.

Defined results: a null or empty text is the end alone; every input row gives one row, repeated
rows too; without training texts N = V = 0 and the model is uniform; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SLICE
from quire.session import discard, materialize

END = b"\n"
#: Symbols of a segment, and of the segments whose recursions are in memory at once.
SEGMENT = 128
TOGETHER = 1 << 19
#: Bytes of a symbol.
WIDTH = 4
#: Expected counts are summed as integers of this fraction, so that no order of summing shows.
UNIT = float(1 << 20)


def tokens(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly 0x20 and 0x09-0x0D, bytes.lower() changes exactly A-Z."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def class_of(token: bytes, classes: int) -> int:
    return zlib.crc32(token[-2:]) % classes


def token_table(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(token, c) of all texts; a task sums up to ``most`` distinct tokens before it lets go of them."""

    def run(batches):
        names = pa.schema([("token", pa.binary()), ("n", pa.int64())])

        def flush(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=names)

        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(at, SLICE).to_pylist():
                    seen.update(tokens(text))
                if len(seen) > most:
                    yield flush(seen)
                    seen = Counter()
        if seen:
            yield flush(seen)

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Vocabulary:
    """What the executors know of the counts: the frequent tokens and the classes of all others."""

    def __init__(self, frequent: list[tuple[bytes, int]], totals: dict[int, tuple[int, int]], n: int, v: int, own_symbols: int, classes: int):
        frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.n, self.v, self.classes, self.own = n, v, classes, min(own_symbols, len(frequent))
        c, d = np.zeros(classes), np.zeros(classes)
        for k, (a, b) in totals.items():
            c[k], d[k] = a, b
        for t, k in frequent[: self.own]:
            c[class_of(t, classes)] -= k
            d[class_of(t, classes)] -= 1
        self.class_log = np.log10(c + d + 1)
        self.class_counts, self.class_sizes = c, d
        self.tokens = [t for t, _ in frequent]
        counts = np.array([k for _, k in frequent], dtype=np.float64)
        self.log_count = np.append(np.log10(counts + 1), 0.0)
        kind = np.array([class_of(t, classes) for t in self.tokens], dtype=np.int64)
        at = np.arange(len(frequent))
        self.symbol = np.append(np.where(at < self.own, at, self.own + kind), 0).astype(np.uint32)
        self.within = np.append(np.where(at < self.own, 0.0, np.log10(counts + 1) - self.class_log[kind]), 0.0)
        self.symbol_counts = np.concatenate([counts[: self.own], c])

    @property
    def symbols(self) -> int:
        return self.own + self.classes


def batches_of(lengths: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some of the sequences, longest first: (their numbers, places of all first symbols, all second ones and so on, how many reach step t)."""
    order = some[np.argsort(-lengths[some], kind="stable")]
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    reach = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    return order, np.concatenate([starts[:m] + t for t, m in enumerate(reach)]) if len(reach) else starts, reach


def cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of segments of ``most`` symbols at most, and each one's number in its sequence."""
    count = -(-lengths // most)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.minimum(most, np.repeat(lengths, count) - number * most), number


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)  # emit: symbol x state

    @classmethod
    def blank(cls, states: int, symbol_counts: np.ndarray, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = (symbol_counts + 0.1)[:, None] * np.exp(rng.normal(0, 1.0, (len(symbol_counts), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def log_likelihood(self, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log probability of each sequence, by the scaled forward recursion."""
        order, place, reach = batches_of(lengths, np.arange(len(lengths)))
        total, symbols, at = np.zeros(len(lengths)), symbols[place], 0
        for t, m in enumerate(reach):
            e = self.emit[symbols[at : at + m]].T
            alpha = e * (self.start[:, None] if t == 0 else self.move.T @ alpha[:, :m])
            s = alpha.sum(0)
            alpha /= s
            total[:m] += np.log(s)
            at += m
        out = np.empty(len(lengths))
        out[order] = total
        return out

    def expected(self, lengths: np.ndarray, symbols: np.ndarray, segment: int = SEGMENT, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, of moves, and of symbols by state, over whole sequences.

        The recursions run in segments side by side, each with what its sequence says before and
        after it, so that a long sequence costs no more than short ones and no count depends on cuts.
        """
        k = len(self.start)
        sizes, number = cut(lengths, segment)
        ends = np.cumsum(sizes)
        at = np.unique(ends // together, return_index=True)[1].tolist()
        blocks = [(slice(i, j), symbols[ends[i] - sizes[i] : ends[j - 1]]) for i, j in zip(at, [*at[1:], len(sizes)])]
        before, after, moves = self.across(sizes, number, blocks)
        first, seen = np.zeros(k), np.zeros((len(self.emit), k))
        for own, flat in blocks:
            more, begin, gamma, flat = self.within(sizes[own], flat, before[:, own], after[:, own])
            moves += more
            first += begin[:, number[own] == 0].sum(1)
            for state in range(k):
                seen[:, state] += np.bincount(flat, weights=gamma[state], minlength=len(seen))
        return first, moves * self.move, seen

    def across(self, sizes: np.ndarray, number: np.ndarray, blocks: list[tuple[slice, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment (a column) the states expected before its first symbol and the weights of its last states
        by what follows; and the moves from segment to segment, still without the factor ``move``."""
        k = len(self.start)
        before, after, moves = np.repeat(self.start[:, None], len(sizes), 1), np.ones((k, len(sizes))), np.zeros((k, k))
        several = (number > 0) | np.append(number[1:] > 0, False)[: len(number)]
        if not several.any():
            return before, after, moves
        # From each state before a segment to each state at its end: a product over its symbols.
        through = np.empty((k, k, len(sizes)))
        for own, flat in blocks:
            some = np.nonzero(several[own])[0]
            order, place, reach = batches_of(sizes[own], some)
            emits, product, at = self.emit[flat[place]].T.copy(), np.zeros((k, k, len(order))), 0
            for t, m in enumerate(reach):
                e = emits[:, at : at + m]
                product[:, :, :m] = np.eye(k)[:, :, None] * e if t == 0 else np.matmul(self.move.T, product[:, :, :m]) * e
                if t % 8 == 7:
                    product[:, :, :m] /= product[:, :, :m].sum((0, 1))
                at += m
            through[:, :, own.start + order] = product / product.sum((0, 1))
        rounds = np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])
        last = np.empty((k, len(sizes)))
        for i in rounds[1:]:
            ending = np.einsum("an,abn->bn", before[:, i - 1], through[:, :, i - 1])
            last[:, i - 1] = ending / ending.sum(0)
            before[:, i] = self.move.T @ last[:, i - 1]
        for i in rounds[:0:-1]:
            weight = np.einsum("abn,bn->an", through[:, :, i], after[:, i])
            weight /= (before[:, i] * weight).sum(0)
            moves += last[:, i - 1] @ weight.T
            after[:, i - 1] = self.move @ weight
        return before, after, moves

    def within(self, sizes: np.ndarray, symbols: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The moves in segments, without the factor ``move``; the states at their starts; the states of each symbol, and these symbols."""
        order, place, reach = batches_of(sizes, np.arange(len(sizes)))
        symbols = symbols[place]
        emits, gamma, scales = self.emit[symbols].T.copy(), np.empty((len(self.start), len(symbols))), np.empty(len(symbols))
        at = np.cumsum(reach) - reach
        for t, (i, m) in enumerate(zip(at.tolist(), reach.tolist())):
            a = emits[:, i : i + m] * (before[:, order] if t == 0 else self.move.T @ a[:, :m])
            np.sum(a, 0, out=scales[i : i + m])
            a /= scales[i : i + m]
            gamma[:, i : i + m] = a
        moves, beta = np.zeros_like(self.move), after[:, order]
        for t in range(len(reach) - 1, -1, -1):
            i, m = at[t], reach[t]
            if t + 1 < len(reach):
                j, n = at[t + 1], reach[t + 1]
                w = emits[:, j : j + n] * beta[:, :n]
                w /= scales[j : j + n]
                moves += gamma[:, i : i + n] @ w.T
                beta[:, :n] = self.move @ w
            gamma[:, i : i + m] *= beta[:, :m]
        begin = np.empty_like(before)
        begin[:, order] = gamma[:, : len(order)]
        return moves, begin, gamma, symbols

    @classmethod
    def of_counts(cls, first: np.ndarray, moves: np.ndarray, at: np.ndarray, own: int) -> Hmm:
        first, moves, at = first + 0.1, moves + 0.1, at + 0.01
        at[own:] += at.sum(0) / at.sum()  # a class is there once more, for tokens that training hasn't seen
        return cls(first / first.sum(), moves / moves.sum(1, keepdims=True), at / at.sum(0))


def lengths_of(blobs: list[bytes]) -> np.ndarray:
    return np.array([len(b) // WIDTH for b in blobs], dtype=np.int64)


def symbols_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.uint32).astype(np.int64)


class Rare:
    """The tokens of some texts that have no symbol of their own: how often they occur in training, and their factors by state."""

    def __init__(self, model: Hmm, within: np.ndarray | None, vocabulary: tuple[int, np.ndarray, np.ndarray], flat: np.ndarray, others: pa.Array, found: pa.Array | None):
        own, c, v = vocabulary
        self.names: dict[bytes, int] = {}
        self.place = np.nonzero(flat >= own)[0]
        self.at = np.array([self.names.setdefault(w, len(self.names)) for w in others.flatten().to_pylist()], dtype=np.int64)
        self.kind = np.zeros(len(self.names), dtype=np.int64)
        self.kind[self.at] = flat[self.place]
        self.count = np.zeros(len(self.names))
        factor = np.ones((len(self.names), len(model.start)))
        if found is not None and len(self.names):
            rows = found.flatten()
            i = np.array([self.names[t] for t in rows.field("token").to_pylist()], dtype=np.int64)
            self.count[i] = rows.field("c").to_numpy(zero_copy_only=False)
            if within is not None and len(i):
                n = np.column_stack([rows.field(f"s{j}").to_numpy(zero_copy_only=False) for j in range(len(model.start))]) / UNIT
                k = self.kind[i] - own
                share = within[k] / np.maximum(c[k], 1)[:, None] + 1e-12
                factor[i] = (n + share) / (share * (c + v + 1)[k][:, None]) * ((c + v + 1)[k] / (self.count[i] + 1))[:, None]
        #: Symbols with one more for each of these tokens, and the model that has emissions for them.
        self.flat = flat
        self.flat[self.place] = len(model.emit) + self.at
        self.model = Hmm(model.start, model.move, np.vstack([model.emit, model.emit[self.kind] * factor]))


def encoded(docs: DataFrame, held: Column, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """Every text as symbols, with its sums over the tokens that the executors know and a list of the others."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[key].dataType
    fields = f"rid long, `{key}` {kind.simpleString()}, held_out boolean, n_tokens long, known long, log_counts double, within double, symbols binary, others array<binary>"

    def run(batches):
        from pyspark import TaskContext

        own = shared.value
        missing = len(own.tokens)
        look = {t: i for i, t in enumerate(own.tokens)}.get
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [[] for _ in range(7)]
                for t in part.column(2).to_pylist():
                    words = tokens(t)
                    i = np.fromiter(map(look, words, repeat(missing)), dtype=np.int64, count=len(words))
                    symbols = own.symbol[i]
                    unknown = np.nonzero(i == missing)[0].tolist()
                    others = [words[j] for j in unknown]
                    if unknown:
                        symbols[unknown] = [own.own + class_of(w, own.classes) for w in others]
                    within = own.within[i].sum() - sum(own.class_log[class_of(w, own.classes)] for w in others)
                    for c, v in zip(out, (rid, len(words), len(words) - len(others), float(own.log_count[i].sum()), float(within), symbols.tobytes(), others)):
                        c.append(v)
                    rid += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
                a = [pa.array(c, k) for c, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([a[0], part.column(0), part.column(1), *a[1:]], names=["rid", key, "held_out", "n_tokens", "known", "log_counts", "within", "symbols", "others"])

    return docs.select(key, held.alias("held_out"), text).mapInArrow(run, fields)


def with_rare(texts: DataFrame, rare: DataFrame | None, states: int) -> DataFrame:
    """The texts with ``found``, what ``rare`` says of their tokens in ``others``."""
    columns = ["token", "c", *[f"s{i}" for i in range(states)]]
    if rare is None:
        return texts.withColumn("found", F.lit(None).cast("array<struct<token:binary,c:bigint>>"))
    asked = texts.select("rid", F.explode(F.array_distinct("others")).alias("token"))
    found = asked.join(rare.select(*columns), "token").groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("found"))
    return texts.join(found, "rid", "left")


def baum_welch_pass(train: DataFrame, model: Hmm, vocabulary: Vocabulary, rare: DataFrame | None, within: np.ndarray | None) -> tuple[Hmm, DataFrame, np.ndarray]:
    """One expectation over all training texts, summed across partitions, and the maximisation: the model, the written sums (those of rare tokens in rows below 0), the counts of classes."""
    states, symbols = len(model.start), vocabulary.symbols
    shared = train.sparkSession.sparkContext.broadcast((model, within, (vocabulary.own, vocabulary.class_counts, vocabulary.class_sizes)))
    columns = [f"s{i}" for i in range(states)]
    joined = rare is not None

    def rows(numbers, names, counts, table):
        table = np.rint(table * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), *[pa.array(table[:, i], pa.int64()) for i in range(states)]], names=["row", "token", "c", *columns])

    def run(batches):
        (own, within, known), sums = shared.value, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                blobs = part.column(0).to_pylist()
                lengths = lengths_of(blobs)
                local = Rare(own, within, known, symbols_of(blobs), part.column(1), part.column(2) if joined else None)
                first, moves, seen = local.model.expected(lengths, local.flat)
                if local.names:
                    yield rows(np.full(len(local.names), -1), list(local.names), np.bincount(local.at), seen[symbols:])
                    np.add.at(seen, local.kind, seen[symbols:])
                found = (first, moves, seen[:symbols])
                sums = found if sums is None else tuple(a + b for a, b in zip(sums, found))
        if sums is not None:
            table = np.vstack([sums[2], sums[1], sums[0][None]])
            some = np.nonzero(np.rint(table * UNIT).any(1))[0]
            yield rows(some, [None] * len(some), np.zeros(len(some), dtype=np.int64), table[some])

    each = with_rare(train, rare, states).select("symbols", "others", "found").mapInArrow(run, "row int, token binary, c long, " + ", ".join(f"{c} long" for c in columns))
    expected = materialize(each.groupBy("row", "token").agg(*[F.sum(c).alias(c) for c in ("c", *columns)]), "expected")
    sums = expected.filter("row >= 0").select("row", *columns).toArrow()
    table = np.zeros((symbols + states + 1, states))
    table[np.array(sums["row"])] = np.column_stack([np.array(sums[c], dtype=np.float64) for c in columns]) / UNIT if sums.num_rows else 0
    return Hmm.of_counts(table[-1], table[symbols : symbols + states], table[:symbols], vocabulary.own), expected, table[vocabulary.own : symbols]


def score_texts(
    docs: DataFrame, held: Column, *, states: int = 4, passes: int = 2, lookup: int = 262_144, own_symbols: int = 262_144, classes: int = 256,
    sample_rows: int = 1000, sample_tokens: int = 400_000, sample_passes: int = 20, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows where ``held`` aren't learned from."""
    counts = materialize(token_table(docs.filter(~held).select(text)), "tokens")
    bucket = F.floor(F.log2("c") * 16).cast("int")
    by = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # 16 buckets a doubling
    n, v = sum(r["n"] for r in by), sum(r["v"] for r in by)
    cut, room = 1 << 30, min(lookup, own_symbols)
    for r in sorted(by, key=lambda r: -r["b"]):
        if (room := room - r["v"]) < 0:
            break
        cut = r["b"]
    frequent = counts.filter(bucket >= cut).toArrow()  # ``lookup`` rows at most
    totals = counts.groupBy(F.pmod(F.crc32(F.substring("token", -2, 2)), F.lit(classes)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    vocabulary = Vocabulary(list(zip(frequent["token"].to_pylist(), frequent["c"].to_pylist())), {r["k"]: (r["c"], r["v"]) for r in totals}, n, v, own_symbols, classes)

    texts = materialize(encoded(docs, held, vocabulary, key, text), "symbols")
    train = texts.filter(~F.col("held_out"))
    model = Hmm.blank(states, vocabulary.symbol_counts)
    # The warm-up sees texts of all lengths, in an order by hash until they have ``sample_tokens``.
    drawn, size = [], 0
    for r in train.select("rid", F.length("symbols").alias("n"), F.xxhash64("rid").alias("h")).orderBy("h").limit(sample_rows).collect():
        if size < sample_tokens:
            drawn.append(r["rid"])
            size += r["n"] // WIDTH
    if drawn:
        blobs = [bytes(r["symbols"]) for r in train.filter(F.col("rid").isin(drawn)).select("rid", "symbols").orderBy("rid").collect()]
        lengths, flat = lengths_of(blobs), symbols_of(blobs)
        for _ in range(sample_passes):
            first, moves, at = model.expected(lengths, flat)
            # What the sample hasn't seen keeps the shape of the whole corpus.
            model = Hmm.of_counts(first, moves, at + 0.1 * vocabulary.symbol_counts[:, None] / max(1.0, vocabulary.symbol_counts.sum()) * at.sum(0), vocabulary.own)
    # Counts of the tokens without a symbol of their own; their factors are 1 until a pass has seen them.
    rare = within = old = None
    for _ in range(passes if n else 0):
        model, expected, within = baum_welch_pass(train, model, vocabulary, rare, within)
        discard(old)
        rare, old = expected.filter("row < 0"), expected
    if rare is not None:
        discard(counts)
    else:
        rare = counts.filter(bucket < cut).select("token", "c", *[F.lit(0).cast("long").alias(f"s{i}") for i in range(states)])

    shared = docs.sparkSession.sparkContext.broadcast((model, within, (vocabulary.own, vocabulary.class_counts, vocabulary.class_sizes)))

    def run(batches):
        own, within, known = shared.value
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            lengths = lengths_of(blobs)
            local = Rare(own, within, known, symbols_of(blobs), batch.column(2), batch.column(3))
            found = local.model.log_likelihood(lengths, local.flat) / np.log(10) if blobs else np.zeros(0)
            text = np.repeat(np.arange(len(blobs)), [len(o) for o in batch.column(2)])
            counts = local.count[local.at]
            logs, seen = (np.bincount(text, weights=w, minlength=len(blobs)) for w in (np.log10(counts + 1), (counts > 0).astype(float)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4, batch.num_columns)], pa.array(found, pa.float64()), pa.array(logs, pa.float64()), pa.array(seen.astype(np.int64), pa.int64())],
                names=[key, "held_out", "n_tokens", "known", "log_counts", "within", "likelihood", "rare_logs", "rare_known"],
            )

    kind = docs.schema[key].dataType.simpleString()
    scored = with_rare(texts, rare, states).select("rid", "symbols", "others", "found", key, "held_out", "n_tokens", "known", "log_counts", "within").mapInArrow(
        run, f"`{key}` {kind}, held_out boolean, n_tokens long, known long, log_counts double, within double, likelihood double, rare_logs double, rare_known long"
    )
    return scored.select(
        key, "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("rare_logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("likelihood") + F.col("within") + F.col("rare_logs")).alias("score"),
    )


__all__ = ["Hmm", "Vocabulary", "score_texts", "token_table", "tokens"]

"""Each operator against a plain version, on rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [(1, base), (2, " ".join(near)), (3, base), (4, prose(2, 90)), (5, None), (6, ""), (7, "..."), (8, "one two"), (9, "one two"), (10, "x"), (11, prose(3, 3000)), (12, "ab" * 400)]
    out += [(13, base + "\n" + prose(4, 30)), (14, prose(4, 30) + "\n" + prose(5, 10)), (15, "Ωμέγα ı ß İ " + prose(6, 20)), (4, prose(2, 90)), (16, "Is Is " * 90)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "k", t, 0) for k, t in rows], "doc_id long, text string, key string, own string, rid int")


def empty(docs):
    return docs.filter("false")


def test_near_duplicates(docs, rows):
    from quire.llm.minhash import distinct_documents, near_duplicates

    got = [(r.doc_id, r.class_id, r.kept) for r in near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    classes = defaultdict(set)
    for k, c, _ in got:
        classes[c].add(k)
    assert classes[1] == {1, 2, 3} and classes[8] == {8, 9} and classes[4] == {4}
    assert all(classes[k] == {k} for k in (5, 6, 7, 10, 11))
    assert Counter(c for _, c, kept in got if kept) == Counter({c: 1 for c in classes})
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_are_those_of_all_pairs(spark):
    from quire.llm.minhash import near_duplicates, words_of

    r, texts = random.Random(5), []
    for family in range(6):
        base = prose(100 + family, 80).split()
        for _ in range(25):
            own = list(base)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(own))
    bags = []
    for t in texts:
        w = words_of(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    # Bands of one register put texts into buckets whose hubs don't decide, so that blocks have to.
    for options in ({}, {"block": 8, "bands": 40, "rows": 1}):
        got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()}
        assert got == {i: top(i) for i in range(len(texts))}


def test_near_duplicates_that_only_blocks_find(spark, monkeypatch):
    from quire.llm import minhash

    base = prose(100, 80).split()
    texts = []
    for family in range(4):
        own = [w if i % 4 else f"f{family}" for i, w in enumerate(base)]
        texts += [" ".join(own[:77] + [f"x{n}"] + own[78:]) for n in range(3)]
    seen, blocks = [], minhash.met_in_blocks
    monkeypatch.setattr(minhash, "met_in_blocks", lambda state, *a, **k: seen.append(state.count()) or blocks(state, *a, **k))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs, shingle=1, bands=40, rows=1, similarity=0.9, block=4).collect()}
    assert seen[0] and got == {i: i - i % 3 for i in range(len(texts))}


def test_signatures_estimate_weighted_jaccard():
    from quire.llm.minhash import overlap, signatures

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 2**63, 40, dtype=np.uint64))
    a, b = (keys, rng.integers(1, 9, len(keys))), (keys, rng.integers(1, 9, len(keys)))
    s = signatures([a, b, a], 4096)
    assert (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - overlap(a, b)) < 0.03


def test_quality(spark):
    from pyspark.sql import functions as F

    from quire.llm.common import held_out
    from quire.llm.quality import accepted, score_quality, train_quality
    from quire.session import table

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = train_quality(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    got = score_quality(docs, model).join(labels.filter(held_out(F.col("doc_id"), 5, 0)), "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (1, None, 0)], "doc_id long, text string, `a.score` long")
    assert score_quality(odd, model).count() == 4 and accepted(odd, model).columns == odd.columns
    assert score_quality(odd.filter("false"), model).count() == 0 and accepted(odd.filter("false"), model).count() == 0
    want = {r.doc_id for r in score_quality(docs, model).filter("predicted = 1").collect()}
    assert {r.doc_id for r in accepted(docs, model).collect()} == want
    # The plain score: sizes of blocks with either dictionary, through the curve.
    import zstandard as zs

    text = "plain words of a text, again and again. " * 40
    sizes = []
    for content in (model.good, model.bad):
        d = zs.ZstdCompressionDict(content)
        sizes.append(sum(len(zs.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode()[i : i + 512])) for i in range(0, len(text), 512)))
    z = model.weights[0] + model.weights[1] * (sizes[1] - sizes[0]) / len(text) + model.weights[2] / (1 + len(text) / 64)
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert math.isclose(score_quality(one, model).collect()[0].score, 1 / (1 + math.exp(-z)), rel_tol=1e-6)
    none = train_quality(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in score_quality(odd, none).collect()} == {0.5}


def test_suffix_dedup(docs, rows):
    from quire.llm.suffix_dedup import dedup_substrings

    ordered = sorted(rows, key=lambda r: r[0])
    for hot in (4096, 1):
        got = dedup_substrings(docs, hot=hot).collect()
        assert len(got) == len(rows)
        # Rows of one key are documents of their own; equal ones are interchangeable here.
        first, want = {}, Counter()
        for n, (k, t) in enumerate(ordered):
            b = (t or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - 99):
                if first.setdefault(b[i : i + 100], (n, i)) != (n, i):
                    gone[i : i + 100] = b"\1" * 100
            kept = bytes(c for c, g in zip(b, gone) if not g)
            runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
            want[(k, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert dedup_substrings(empty(docs)).count() == 0


def test_interval_expansion():
    from quire.llm.suffix_dedup import expanded, suffix_order

    r = random.Random(2)
    part = bytes(r.choice(b"ab") for _ in range(300))
    text = np.frombuffer(part + b"\0" + part[50:200] + b"\0" + b"a" * 90 + b"\0" + part[100:] + bytes(120), dtype=np.uint8)
    order, whole = suffix_order(text), text.tobytes()
    assert order.tolist()[120:] == sorted(range(len(text)), key=lambda i: whole[i:])[120:]  # but for the zeros at the end
    for width in (8, 16, 50, 100):
        want = [a == 0 or whole[order[a - 1] :][:width] != whole[order[a] :][:width] for a in range(len(order))]
        got = expanded(text, order, width)
        assert got[130:].tolist() == want[130:]
        assert expanded(text, np.roll(order, 7), width).tolist() != want  # boundaries come from the order's extension alone


def test_decontaminate(spark, docs, rows):
    from quire.llm.decontaminate import decontaminate, windows, words

    bench = [(1, " ".join(prose(2, 90).split()[20:45])), (2, "One, two"), (3, None), (4, "..."), (None, "x"), (10, " ".join(prose(11, 12).split())), (1, "One, two")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    items = defaultdict(set)
    for k, t in bench:
        for w in windows(t, 10):
            items[w].add(k)
    want = Counter()
    for k, t in rows:
        w, hit, ids = words(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in items}:
                own = tuple(w[i : i + n])
                if len(own) == n and own in items:
                    hit |= set(range(i, i + n))
                    ids |= {str(x) for x in items[own] if x is not None}
        want[(k, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    for block in (100_000, 3):
        got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs, table, block_windows=block).collect())
        assert got == want
        clean = decontaminate(docs, table, mode="documents", block_windows=block)
        assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
        odd = docs.withColumnRenamed("own", "a.b")
        assert decontaminate(odd, table, mode="documents", block_windows=block).columns == odd.columns
        cut = [r.text for r in decontaminate(odd, table, mode="spans", block_windows=block).collect()]
        again = decontaminate(spark.createDataFrame(list(enumerate(cut)), "doc_id long, text string"), table, block_windows=100_000)
        assert len(cut) == len(rows) and again.filter("contaminated").count() == 0
        assert Counter(cut) == Counter(spans_cut(t, items) for _, t in rows)
    assert decontaminate(docs, table.filter("false")).filter("contaminated").count() == 0


def spans_cut(text, items):
    """Runs of hit words go with what stands between them; a line end stands for each."""
    import re

    if text is None:
        return None
    found = list(re.finditer(rb"[0-9a-z\x80-\xff]+", text.encode().lower()))
    w, hit = [m.group() for m in found], set()
    for n in {len(x) for x in items}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in items:
                hit |= set(range(i, i + n))
    data, out, at = text.encode(), [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(data[at : found[i].start()])
        at = found[i].end()
    return b"\n".join([*out, data[at:]]).decode()


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    from quire.llm.packing import pack

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = pack(docs, vocabulary("word_bpe_49k.json")).collect()
    want = Counter()
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[(k, n, at, len(own), zlib.crc32(array("I", own).tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(empty(docs), vocabulary("word_bpe_49k.json")).count() == 0
    clash = docs.withColumnRenamed("own", "piece").withColumnRenamed("rid", "offset")
    assert pack(clash, vocabulary("word_bpe_49k.json")).count() == len(got)
    large = pack(table_of(docs.sparkSession, "sf0.01"), vocabulary("word_bpe_49k.json")).agg({"sequence_id": "count", "length": "sum"}).collect()[0]
    used = pack(table_of(docs.sparkSession, "sf0.01"), vocabulary("word_bpe_49k.json")).select("sequence_id").distinct().count()
    assert used <= 1.03 * -(-large["sum(length)"] // 2048)


def table_of(spark, sf):
    from quire.session import table

    return table(spark, f"/root/testdata/{sf}", "documents")


def test_line_dedup(spark):
    from quire.llm.line_dedup import dedup_lines, without_repeated_lines

    r = random.Random(9)
    lines = ["a b c", "d", "e f", "g h i j k l m n o p", "  g h i j k l m n o p\t", "", "q r s t"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(0, 14))) for _ in range(60)] + [None, "", "\n\n"]
    data = list(enumerate(texts)) + [(None, "a b c\nd")]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0))
    seqs = [[x.strip(" \t\r") for x in (t or "").split("\n")] for _, t in order]
    seqs = [[x for x in s if x] for s in seqs]
    first = {}
    for n, s in enumerate(seqs):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                first.setdefault(tuple(s[i:j]), (n, i))
    for n, ((k, t), s) in enumerate(zip(order, seqs)):
        gone = set()
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if sum(x.count(" ") + 1 for x in s[i:j]) >= 10 and first[tuple(s[i:j])] != (n, i):
                    gone |= set(range(i, j))
        kept, m = [], 0
        for line in (t or "").split("\n"):
            blank = not line.strip(" \t\r")
            if blank or m not in gone:
                kept.append(line)
            m += not blank
        assert got[k] == (len(s), len(gone), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    wide = spark.createDataFrame([(1, "a", "x", 5), (2, None, "y", 6)], "doc_id long, text string, k string, n int")
    assert without_repeated_lines(wide).columns == wide.columns and without_repeated_lines(wide).count() == 2
    assert dedup_lines(wide.filter("false")).count() == 0


def test_line_dedup_of_short_and_unspaced_lines(spark):
    import corpus_pipeline

    tabs, no_spaces, twice = "\t".join("abcdefghijkl"), "文" * 30, "only twice"
    own = [["all rights reserved"], [tabs], [no_spaces], [twice]]
    data = [(k, f"text of its own number {k}\n" + "\n".join(own[0] + (own[1] + own[2] + own[3] if k < 2 else [])), 0) for k in range(12)]
    got = {r.doc_id: r.text.split("\n")[1:] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(data, "doc_id long, text string, n_chars long"), SF).collect()}
    # A line in two places stays where it is short and what is around it doesn't repeat; here it ends a repeated run.
    assert got == {0: ["all rights reserved", tabs, no_spaces, twice]} | {k: [] for k in range(1, 12)}
    apart = [(k, f"{k} one\n{twice}\n{k} two\n{no_spaces}\n{k} three\n{tabs}", 0) for k in range(2)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(apart, "doc_id long, text string, n_chars long"), SF).collect()}
    assert got == {0: apart[0][1], 1: f"1 one\n{twice}\n1 two\n1 three"}


def test_language_model(spark, docs, rows):
    from pyspark.sql import functions as F

    from quire.llm.common import held_out
    from quire.llm.language_model import Hmm, score_texts, tokens

    got = score_texts(docs, held_out(F.col("doc_id"), 7, 2), lookup=50, own_symbols=20, classes=8, states=3).collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for k, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want[(k, held(k), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    # The scaled recursion gives what all state paths give.
    rng = np.random.default_rng(1)
    m = Hmm(np.array([0.3, 0.7]), np.array([[0.6, 0.4], [0.1, 0.9]]), rng.dirichlet(np.ones(4), 2).T)
    seq = [0, 3, 1, 2]
    total = sum(math.prod([m.start[p[0]] * m.emit[seq[0], p[0]]] + [m.move[p[i - 1], p[i]] * m.emit[seq[i], p[i]] for i in range(1, 4)]) for p in np.ndindex(2, 2, 2, 2))
    assert math.isclose(m.log_likelihood(np.array([4]), np.array(seq))[0], math.log(total))
    # One step of Baum-Welch is the sum over all state paths, weighted by their probability given the symbols.
    texts = [[0, 3, 1], [2, 2], [1]]
    first, moves, seen = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for own in texts:
        paths = list(np.ndindex(*[2] * len(own)))
        p = np.array([m.start[q[0]] * math.prod(m.emit[s, x] for s, x in zip(own, q)) * math.prod(m.move[x, y] for x, y in zip(q, q[1:])) for q in paths])
        for q, share in zip(paths, p / p.sum()):
            first[q[0]] += share
            for x, y in zip(q, q[1:]):
                moves[x, y] += share
            for s, x in zip(own, q):
                seen[s, x] += share
    lengths, flat = np.array([3, 2, 1]), np.array(sum(texts, []))
    for cuts in ({}, {"segment": 1}, {"segment": 2, "together": 2}):
        for a, b in zip(m.expected(lengths, flat, **cuts), (first, moves, seen)):
            assert np.allclose(a, b)
    # Long texts, too, count the same however they are cut.
    lengths, whole = np.array([700, 1, 90, 300]), {"segment": 1000, "together": 10_000}
    flat = rng.integers(0, 4, lengths.sum())
    for cuts in ({}, {"segment": 7, "together": 50}):
        for a, b in zip(m.expected(lengths, flat, **cuts), m.expected(lengths, flat, **whole)):
            assert np.allclose(a, b)
    assert score_texts(empty(docs), F.lit(False)).count() == 0


def test_language_model_tells_rare_tokens_of_a_class_apart(spark):
    from pyspark.sql import functions as F

    from quire.llm.language_model import score_texts

    # Two kinds of texts; the rare words of both end alike, so that one class has them all.
    kinds = [("sun moon star sky", "aa"), ("iron coal salt tin", "bb")]
    r = random.Random(3)
    data = []
    for k in range(120):
        words, mark = kinds[k % 2]
        data.append((k, " ".join(f"{mark}{r.randrange(30)}xx" if r.random() < 0.2 else r.choice(words.split()) for _ in range(60))))
    data += [(1000, "sun moon aa1xx star"), (1001, "sun moon bb1xx star"), (1002, "iron coal bb1xx tin"), (1003, "iron coal aa1xx tin")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    by = {}
    for own in (12, 262_144):
        got = score_texts(docs, F.col("doc_id") >= 1000, own_symbols=own, classes=4, states=2, passes=4)
        by[own] = {x.doc_id: x.score - x.base_score for x in got.collect()}
    for scores in by.values():
        assert scores[1000] > scores[1001] + 0.5 and scores[1002] > scores[1003] + 0.5


def test_neighbours(spark):
    from pyspark.sql import functions as F

    from quire.llm.neighbours import nearest
    from quire.session import table

    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    data = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in vectors.collect()}
    exact = {q: [k for _, k in sorted((-sum(float(a) * float(b) for a, b in zip(data[q], x)), k) for k, x in data.items() if k != q)[:20]] for q in data if q % 20 == 0}
    for factor, least in ((1.0, 1.0), (0.2, 0.9)):
        got = defaultdict(list)
        for r in nearest(vectors, F.col("vec_id") % 20 == 0, factor=factor, shard_bytes=40_000).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        recall = sum(len(set(got[q]) & set(e)) for q, e in exact.items()) / sum(map(len, exact.values()))
        assert recall >= least
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [None, 1.0]), (6, [2.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(odd, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 6), (0, 2, 4)]
    assert nearest(odd.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("lengths", ["one long vector", "mixed"])
def test_neighbours_of_unequal_norms(spark, lengths):
    from pyspark.sql import functions as F

    from quire.llm.neighbours import nearest
    from quire.session import table

    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    x = np.array([r.embedding for r in rows])
    rng = np.random.default_rng(0)
    x *= np.where(np.arange(len(x)) == 1234, 5.0, 1.0)[:, None] if lengths != "mixed" else np.exp(rng.normal(0, 0.5, len(x)))[:, None]
    vectors = spark.createDataFrame([(r.vec_id, v) for r, v in zip(rows, x.tolist())], "vec_id long, embedding array<double>")
    exact = {}
    for i, r in enumerate(rows):
        if r.vec_id % 20 == 0:
            scores = x @ x[i]
            scores[i] = -np.inf
            exact[r.vec_id] = {rows[j].vec_id for j in np.argsort(-scores)[:20]}
    for factor, least in ((1.0, 1.0), (0.2, 0.9)):
        got = nearest(vectors, F.col("vec_id") % 20 == 0, factor=factor).collect()
        assert sum(r.vec_id in exact[r.query_id] for r in got) / sum(map(len, exact.values())) >= least


def test_neighbours_in_several_shards_of_many_leaves(spark):
    from pyspark.sql import functions as F

    from quire.llm.neighbours import nearest

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (200, 48))
    x = (centres[rng.integers(0, 200, 12_000)] + rng.normal(0, 0.5, (12_000, 48))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    scores = x[::20].astype(np.float64) @ x.astype(np.float64).T
    scores[np.arange(len(scores)), np.arange(0, len(x), 20)] = -np.inf
    exact = {20 * i: set(np.argpartition(-s, 20)[:20].tolist()) for i, s in enumerate(scores)}
    for factor, least in ((1.0, 1.0), (0.2, 0.9)):
        got = nearest(vectors, F.col("vec_id") % 20 == 0, factor=factor, shard_bytes=1 << 20).collect()  # 5 shards of some 2400 rows
        recall = sum(r.vec_id in exact[r.query_id] for r in got) / sum(map(len, exact.values()))
        print("recall", factor, recall)
        assert recall >= least


def test_toxicity(spark):
    from pyspark.sql import functions as F

    from quire.llm.common import held_out
    from quire.llm.toxicity import score_toxicity, train_toxicity
    from quire.session import table

    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = train_toxicity(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    got = score_toxicity(docs, model).join(labels.filter(held_out(F.col("doc_id"), 4, 2)), "doc_id").collect()
    yes, no = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    assert sum(a > b for a in yes for b in no) / (len(yes) * len(no)) > 0.95
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x", 3), (1, None, 1)], "doc_id long, text string, score long")
    assert score_toxicity(odd, model).count() == 4 and score_toxicity(odd.filter("false"), model).count() == 0
    assert score_toxicity(odd, train_toxicity(docs, labels.filter("false"), F.lit(True))).count() == 4


def test_ftrl_is_the_plain_one():
    from quire.llm.toxicity import ftrl

    r = random.Random(4)
    rows = [(np.array(sorted(r.sample(range(12), r.randrange(0, 6))), dtype=np.int64), r.randrange(2)) for _ in range(60)]
    z, n, zb, nb, b = [0.0] * 12, [0.0] * 12, 0.0, 0.0, 0.5
    weight = lambda i: 0.0 if abs(z[i]) <= 0.3 else -(z[i] - math.copysign(0.3, z[i])) / ((1 + math.sqrt(n[i])) / 2 + 0.1)
    for _ in range(3):
        for at, y in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 2 * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / 2 * (b - 0.5)
            nb += g * g
            b = 0.5 - zb / ((1 + math.sqrt(nb)) / 2)
    got, bias = ftrl(rows, 12, alpha=2.0, beta=1.0, l1=0.3, l2=0.1, epochs=3, bias=0.5)
    assert np.allclose(got, [weight(i) for i in range(12)]) and math.isclose(bias, b)


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    from quire.llm.token_counts import token_counts

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for k, t in [*rows]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(k, len((t or "").encode()), n, n > 512)] += 1
    assert Counter(tuple(r) for r in token_counts(docs, vocabulary("byte_bpe_50k.json")).collect()) == want
    odd = docs.withColumnRenamed("doc_id", "doc id").withColumnRenamed("own", "n_tokens").withColumnRenamed("key", "a.b")
    assert Counter(tuple(r) for r in token_counts(odd, vocabulary("byte_bpe_50k.json"), key="doc id").collect()) == want
    assert token_counts(empty(docs), vocabulary("byte_bpe_50k.json")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from quire.session import materialize, table

    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "stage")
        sizes.append(docs.count())
        if n < 4:
            assert docs.columns == columns and sizes[-1] <= sizes[-2]
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline
    from quire.session import table

    docs = table(spark, SF, "documents")
    good = [r.text for r in docs.filter("text is not null").orderBy("doc_id").limit(60).collect()]
    bench = table(spark, SF, "benchmark").filter("text is not null").first().text
    lines = "\n".join(prose(70 + i, 12) for i in range(4))
    own = [(0, None), (1, ""), (2, good[0]), (3, good[0]), (3, good[0]), (None, good[1]), (4, good[2] + "\n" + bench), (5, lines), (6, prose(90, 30) + "\n" + lines)]
    own += [(10 + i, t) for i, t in enumerate(good[3:])] + [(100, " ".join(good) * 20)]
    odd = spark.createDataFrame([(k, t, "en", "s", 0, 1, 2) for k, t in own], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, node int")
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        before, odd = odd, stage(spark, odd, SF).persist()
        by[name] = odd.collect()
        assert name == "best-fit packing" or odd.columns == before.columns
        empty = stage(spark, before.filter("false"), SF)
        assert empty.count() == 0
    texts = {n: Counter(r.text for r in v) for n, v in by.items() if n != "best-fit packing"}
    after_lines, after_near, after_bench = (texts[n] for n in ("line dedup", "MinHash near-dedup", "benchmark decontamination"))
    assert not any(n > 1 for t, n in after_near.items() if t) and set(after_near) <= set(after_lines)
    from quire.llm.decontaminate import windows

    grams = {w for r in table(spark, SF, "benchmark").collect() for w in windows(r.text, 10)}
    sizes = {len(w) for w in grams}

    def leaks(t):
        from quire.llm.decontaminate import words

        w = words(t)
        return any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert after_bench == Counter({t: n for t, n in after_near.items() if not leaks(t)})
    assert {r.doc_id for r in by["best-fit packing"]} == {r.doc_id for r in by["benchmark decontamination"]}


def test_stages():
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5

"""Term weights and spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import bound


def terms_in(text: Column) -> Column:
    """Words of two characters or more, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term), a row for each time."""
    return docs.select(key, F.explode(terms_in(F.col(text))).alias("term"))


def counted(values: Column) -> Column:
    """(term, tf) of an array, in order: runs of the sorted array."""
    last = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: ~F.get(v, i).eqNullSafe(F.get(v, i + 1)))
    runs = lambda v, at: F.transform(at, lambda e, n: F.struct(F.get(v, e).alias("term"), (e - F.coalesce(F.get(at, n - 1), F.lit(-1))).cast("long").alias("tf")))
    return bound(F.sort_array(values), lambda v: F.when(F.size(v) > 0, bound(last(v), lambda at: runs(v, at))))


def tfidf(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ag_tfidf: (key, term, weight): tf (ln((1 + N) / (1 + df)) + 1), each document's weights of length 1.

    Terms are counted within their row; then rows of a term meet for df, and rows of a document for its length.
    """
    n = docs.select(F.count("*").alias("n_docs"))
    rows = docs.select(key, F.inline(counted(terms_in(F.col(text))))).repartition("term")
    tf = rows.groupBy(key, "term").agg(F.sum("tf").alias("tf")).withColumn("df", F.count("*").over(Window.partitionBy("term")))
    raw = tf.join(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))  # n is one row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def top_terms(weights: DataFrame, docs: DataFrame, most: int = 20) -> DataFrame:
    """tk_tfidf20: terms by their mean weight over all documents; ties by term."""
    n = docs.select(F.count("*").alias("n_docs"))
    return weights.groupBy("term").agg(F.sum("weight").alias("s")).join(F.broadcast(n)).select("term", (F.col("s") / F.col("n_docs")).alias("mean_weight")).orderBy(F.desc("mean_weight"), "term").limit(most)


def without_stopwords(terms: DataFrame, stopwords: list[str] | None = None, least: int = 3) -> DataFrame:
    """tx_stopwords: German stop words and shorter words go."""
    if stopwords is None:
        from pyspark.ml.feature import StopWordsRemover

        stopwords = StopWordsRemover.loadDefaultStopWords("german")
    return terms.filter((F.length("term") >= least) & ~F.lower("term").isin(stopwords))


def shortened(word: Column, most: int) -> Column:
    """The word and what is left of it without any ``most`` characters or fewer."""
    less = lambda v: F.when(F.length(v) > 0, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.left(v, i - 1), F.substring(v, i + 1, F.length(v))))).otherwise(F.array().cast("array<string>"))
    out = now = F.array(word)
    for _ in range(most):
        now = F.array_distinct(F.flatten(F.transform(now, less)))
        out = F.concat(out, now)
    return F.array_distinct(out)


def spelled(terms: DataFrame, lexicon: DataFrame, most: int = 2, short: int = 12) -> DataFrame:
    """tx_spell: each distinct term with its nearest word of the lexicon (word, n), at most ``most`` edits off; none else.

    Not a cross join. Words of ``short`` characters at most and their terms meet where both, without ``most`` characters or
    fewer, are the same. Of longer words cut in ``most`` + 1 pieces, one is in the term unchanged, at a shift of ``most`` at
    most: these meet by length, number and text of a piece. Ties by frequency, then by word.
    """
    own = terms.select("term").distinct()
    words = lexicon.select("word", "n")
    near = own.filter(F.length("term") <= short + most).select("term", F.explode(shortened(F.col("term"), most)).alias("p"))
    far = words.filter(F.length("word") <= short).select("word", "n", F.explode(shortened(F.col("word"), most)).alias("p"))
    met = near.join(far, "p").select("term", "word", "n")
    cut = lambda size, i: F.floor(size * i / (most + 1)).cast("int")
    span = lambda size, i: cut(size, i + 1) - cut(size, i)
    each = F.sequence(F.lit(0), F.lit(most))
    pieces = words.filter(F.length("word") > short).select("word", "n", F.length("word").alias("size"), F.explode(each).alias("i"))
    pieces = pieces.withColumn("p", F.substring(F.col("word"), cut(F.col("size"), F.col("i")) + 1, span(F.col("size"), F.col("i"))))
    parts = own.filter(F.length("term") > short - most).select("term", F.explode(F.sequence(F.length("term") - most, F.length("term") + most)).alias("size")).filter(F.col("size") > short).select("term", "size", F.explode(each).alias("i"))
    parts = parts.select("term", "size", "i", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("at", cut(F.col("size"), F.col("i")) + F.col("shift")).filter("at >= 0")
    parts = parts.select("term", "size", "i", F.substring(F.col("term"), F.col("at") + 1, span(F.col("size"), F.col("i"))).alias("p")).distinct()
    long = parts.join(pieces, ["size", "i", "p"]).select("term", "word", "n")
    pairs = met.unionByName(long).withColumn("d", F.levenshtein("term", "word")).filter(F.col("d") <= most)
    best = pairs.groupBy("term").agg(F.min(F.struct("d", (-F.col("n")).alias("n"), "word")).alias("b"))
    return own.join(best, "term", "left").select("term", F.col("b.word").alias("corrected"))

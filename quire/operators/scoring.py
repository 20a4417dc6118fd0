"""Scores of predictions against gold: sets and triples, strict or relaxed, confusions, token tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T


def normaliser(view: str):
    return {"strict": T.norm_strict, "relaxed": T.norm_relaxed}[view]


def prf(out: DataFrame) -> DataFrame:
    """ag_prf1: precision, recall and f1 of tp, fp and fn; 0.0 without a denominator."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matched(gold: DataFrame, pred: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """tp, fp and fn by ``group`` of the distinct ``keys`` on either side: one union and one aggregate, no join."""
    both = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    each = both.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    n = lambda c: F.sum(c.cast("long"))
    g, p = F.col("g") == 1, F.col("p") == 1
    return each.groupBy(*group).agg(n(g & p).alias("tp"), n(~g & p).alias("fp"), n(g & ~p).alias("fn"))


def entity_scores(gold: DataFrame, pred: DataFrame, view: str = "strict", categories: list[str] | None = None) -> DataFrame:
    """jn_gold_pred_entities: tp, fp, fn and scores by document and category, categories without any included.

    Both tables: (doc_id, category, name).
    """
    norm = normaliser(view)
    own = lambda df: df.select("doc_id", "category", norm(F.col("name")).alias("name")).filter("name != ''")
    counts = matched(own(gold), own(pred), ["doc_id", "category", "name"], ["doc_id", "category"])
    names = categories or [c for c, _, _ in R.CATEGORIES]
    every = gold.select("doc_id").union(pred.select("doc_id")).distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in names])))
    return prf(every.join(counts, ["doc_id", "category"], "left").na.fill(0, ["tp", "fp", "fn"]))


def totals(scores: DataFrame, by: list[str]) -> DataFrame:
    """ag_macro_micro: micro scores of the sums, and the mean of the groups' f1, empty ones counting 0."""
    out = scores.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"))
    return prf(out)


def corpus_totals(scores: DataFrame, key: str) -> DataFrame:
    """ag_corpus_micro: by key over all documents; no macro."""
    return prf(scores.groupBy(key).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def misses(gold: DataFrame, pred: DataFrame, view: str = "strict") -> DataFrame:
    """ag_fp_fn_lists: (doc_id, category, fp_names, fn_names), sorted."""
    norm = normaliser(view)
    side = lambda df, name: df.select("doc_id", "category", norm(F.col("name")).alias("n")).filter("n != ''").groupBy("doc_id", "category").agg(F.collect_set("n").alias(name))
    none = F.array().cast("array<string>")
    both = side(gold, "g").join(side(pred, "p"), ["doc_id", "category"], "full").select("doc_id", "category", F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    return both.select("doc_id", "category", F.array_sort(F.array_except("p", "g")).alias("fp_names"), F.array_sort(F.array_except("g", "p")).alias("fn_names"))


def triple_keys(rel: DataFrame, view: str) -> DataFrame:
    norm, low = normaliser(view), lambda c: F.btrim(F.lower(F.coalesce(c, F.lit(""))))
    return rel.select(
        "doc_id", norm(F.col("subject")).alias("s"), low(F.col("subject_type")).alias("st"), low(F.col("relation_type")).alias("relation_type"),
        norm(F.col("object")).alias("o"), low(F.col("object_type")).alias("ot"), *[c for c in ("n",) if c in rel.columns],
    )


def triple_scores(gold: DataFrame, pred: DataFrame, view: str = "strict") -> DataFrame:
    """jn_gold_pred_triples: by document and relation type."""
    keys = ["doc_id", "s", "st", "relation_type", "o", "ot"]
    return prf(matched(triple_keys(gold, view), triple_keys(pred, view), keys, ["doc_id", "relation_type"]))


def confusions(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """jn_confusions: gold links that are predicted with other types alone; these types in order, repeated ones too. Relaxed names."""
    link = ["doc_id", "s", "st", "o", "ot"]
    own = triple_keys(pred, "relaxed").groupBy(*link).agg(F.array_sort(F.collect_list(F.struct("n", "relation_type"))).alias("all"))
    types = F.transform("all", lambda x: x["relation_type"])
    out = triple_keys(gold, "relaxed").join(own, link).withColumn("predicted", types).drop("all", "n")
    return out.filter(~F.array_contains("predicted", F.col("relation_type"))).withColumnRenamed("relation_type", "gold")


def tag_spans(tokens: DataFrame, tag: str, lenient: bool) -> DataFrame:
    """(key, first, last, type) of a tag column; lenient: an I- of another type or after O starts a span."""
    from pyspark.sql import Window

    from quire.operators.mentions import bio_spans

    own = tokens.filter(F.col("ignored") == False).select("key", "n", F.col(tag).alias("tag"))  # noqa: E712
    if not lenient:
        return bio_spans(own, key="key", order="n").select("key", "first", "last", "type")
    by = Window.partitionBy("key").orderBy("n")
    kind = F.substring("tag", 3, 100)
    before, before_kind = F.lag("tag", 1, "O").over(by), F.lag(kind, 1, "").over(by)
    starts: Column = (F.left("tag", F.lit(1)) == "I") & ((before == "O") | (before_kind != kind))
    return tag_spans(own.withColumn("tag", F.when(starts, F.concat(F.lit("B-"), kind)).otherwise(F.col("tag"))).withColumn("ignored", F.lit(False)), "tag", False)


def span_scores(tokens: DataFrame, lenient: bool = True) -> DataFrame:
    """ag_seqeval: tokens (key, n, gold, pred, ignored) to scores by type; ``totals`` gives micro and macro."""
    keys = ["key", "first", "last", "type"]
    return prf(matched(tag_spans(tokens, "gold", lenient), tag_spans(tokens, "pred", lenient), keys, ["type"]))

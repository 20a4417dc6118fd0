"""Entity mentions: predictors, token tags to spans, and tables of counts, reviews and exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Predictors take sentences as (doc_id, sentence_id, sentence) frames and give frames of this schema.
MENTIONS = "doc_id long, sentence_id int, text string, label string, score double, start int, end int, sentence string"


def predict(sentences: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], *, threshold: float = 0.0, labels: list[str] | None = None) -> DataFrame:
    """er_predict_mentions, er_zero_shot: a model by batches on the executors; threshold and labels are filters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    out = sentences.mapInPandas(run, MENTIONS).filter(F.col("score") >= threshold)
    return out.filter(F.col("label").isin(labels)) if labels else out


#: The rule predictor's labels and patterns: a stand-in that needs no weights.
RULES = [("MAIL", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("YEAR", "[12][0-9]{3}"), ("NAME", r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"), ("CAPS", r"\p{Lu}{2,}")]


def rule_mentions(sentences: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(doc_id, sentence_id, label, text): all matches of the rules, by built-in functions."""

    def found(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("sentence", F.lit(f"({pattern})"), 1), lambda x: F.struct(F.lit(name).alias("label"), x.alias("text")))

    return sentences.select("doc_id", "sentence_id", F.inline(F.concat(*[found(*rule) for rule in rules])))


def span_find(entities: DataFrame, pages: DataFrame, *, on: list[str], entity: str = "entity", text: str = "text") -> DataFrame:
    """jn_span_find: all non-overlapping literal occurrences of each entity in the text it is joined with: start and end in characters."""
    both = entities.filter(F.btrim(F.col(entity)) != "").withColumn(entity, F.btrim(F.col(entity))).join(pages, on)
    pieces = F.split(F.col(text), F.concat(F.lit("\\Q"), F.replace(F.col(entity), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * F.length(entity))
    starts = F.slice("ends", F.lit(1), F.size("ends") - 1)
    out = both.withColumn("pieces", pieces).withColumn("ends", ends).withColumn("start", F.explode(starts)).drop("pieces", "ends")
    return out.withColumn("end", F.col("start") + F.length(entity))


def bio_spans(tokens: DataFrame, *, key: str, order: str, tag: str = "tag") -> DataFrame:
    """wn_bio_islands: (key, first, last, type, tokens). I- continues a span of its own type alone; any other I- is outside."""
    by = Window.partitionBy(key).orderBy(order)
    head, kind = F.left(tag, F.lit(1)), F.substring(tag, F.lit(3), F.length(tag))
    run = Window.partitionBy(key, "run").orderBy(order)
    rows = tokens.select(key, order, head.alias("head"), kind.alias("kind")).withColumn("run", F.sum((F.col("head") == "B").cast("int")).over(by)).filter("run > 0")
    rows = rows.withColumn("type", F.first("kind").over(run))
    broken = (F.col("head") == "O") | ((F.col("head") == "I") & (F.col("kind") != F.col("type")))
    rows = rows.withColumn("broken", F.max(broken.cast("int")).over(run)).filter("broken = 0")
    return rows.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first("type").alias("type"), F.count("*").alias("tokens")).drop("run")


def tags_to_mentions(tokens: DataFrame, *, key: str = "sentence_id") -> DataFrame:
    """er_bio_tags_to_mentions: tokens (key, n, start, end, tag, prob, sentence) to mentions; the score is the mean of the covered tokens, to 4 places, half to even."""
    real = tokens.filter(F.col("end") > F.col("start"))
    spans = bio_spans(real, key=key, order="n")
    inside = real.alias("t").join(spans.alias("s"), [key]).filter("t.n between s.first and s.last")
    return inside.groupBy(key, "first", "last", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bround(F.avg("prob"), 4).alias("score"), F.first("sentence").alias("sentence")).select(
        key, F.expr("substring(sentence, start + 1, end - start)").alias("text"), F.col("type").alias("label"), "score", "start", "end"
    )


def label_list(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """ag_label_list: (id, label): O, then B- and I- of each type in order."""
    types = tags.select(F.substring(T.canonical_tag(F.col(tag)), 3, 100).alias("t")).filter("t != ''").agg(F.array_sort(F.collect_set("t")).alias("types"))
    every = F.concat(F.array(F.lit("O")), F.flatten(F.transform("types", lambda t: F.array(F.concat(F.lit("B-"), t), F.concat(F.lit("I-"), t)))))
    return types.select(F.posexplode(every).alias("id", "label"))


def first_subwords(subwords: DataFrame, *, key: str, order: str, word: str = "word_id", label: str = "label") -> DataFrame:
    """wn_prev_word: a label at a word's first piece, -100 at all others and at special pieces."""
    before = F.lag(word).over(Window.partitionBy(key).orderBy(order))
    new = F.col(word).isNotNull() & (before.isNull() | (before != F.col(word)))
    return subwords.withColumn("aligned", F.when(new, F.col(label)).otherwise(-100))


def counts(mentions: DataFrame, *by: str) -> DataFrame:
    """ag_label_counts, ag_tag_counts."""
    return mentions.groupBy(*by).agg(F.count("*").alias("n"))


def top_entities(mentions: DataFrame, most: int = 15) -> DataFrame:
    """ag_top_entities; ties by label and text."""
    return counts(mentions, "label", "text").orderBy(F.desc("n"), "label", "text").limit(most)


def by_score(mentions: DataFrame, *, below: float | None = None, ascending: bool = True, most: int = 15, ties: tuple[str, ...] = ("label", "text")) -> DataFrame:
    """tk_low_conf, tk_gliner_high, tk_gliner_low."""
    rows = mentions if below is None else mentions.filter(F.col("score") < below)
    return rows.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), *ties).limit(most)


def groups(mentions: DataFrame, keys: list[str], *, label: str = "label", score: str = "score") -> DataFrame:
    """ag_mention_groups: labels and scores by falling score, and the gap between the two best (1.0 where there is one)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))))
    out = mentions.groupBy(*keys).agg(ordered.alias("o"))
    gap = F.when(F.size("o") > 1, F.get("o", F.lit(1))["s"] - F.get("o", F.lit(0))["s"]).otherwise(1.0)
    return out.select(*keys, F.transform("o", lambda x: x["l"]).alias("labels"), F.transform("o", lambda x: -x["s"]).alias("scores"), gap.alias("gap"))


def ambiguous(grouped: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """tk_ambiguous: the smallest gaps of those with several labels."""
    return grouped.filter(F.size("labels") > 1).orderBy("gap", *keys).limit(most)


def repeat_scores(grouped: DataFrame, text: str = "text") -> DataFrame:
    """ag_repeat_variance: the best scores of each text that occurs more than once, in order."""
    best = grouped.select(text, F.get("scores", F.lit(0)).alias("s"))
    return best.groupBy(text).agg(F.array_sort(F.collect_list("s")).alias("scores")).filter(F.size("scores") > 1)


def review_sample(sentences: DataFrame, mentions: DataFrame, *, key: str = "sentence_id", size: int = 150, seed: int = 42) -> DataFrame:
    """sm_review, tx_predicted_join: a seeded sample by hash with its predictions and three columns to fill in."""
    drawn = sentences.orderBy(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(size)
    joined = mentions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", F.concat(F.col("label"), F.lit(": "), F.col("text")).alias("p")))).alias("all"))
    return drawn.join(joined, key, "left").select(
        key, "sentence", F.coalesce(F.array_join(F.transform("all", lambda x: x["p"]), " | "), F.lit("")).alias("predicted"),
        F.coalesce(F.size("all"), F.lit(0)).alias("n_predicted"), F.lit("").alias("n_wrong"), F.lit("").alias("n_missed"), F.lit("").alias("notes"),
    ).orderBy(key)


def review_scores(review: DataFrame, gate: float = 0.85) -> DataFrame:
    """ag_review_pr: precision and recall from a filled-in review; NaN without a denominator."""
    n = lambda c: F.coalesce(F.sum(F.expr(f"try_cast({c} as int)")), F.lit(0))
    sums = review.agg(n("n_predicted").alias("predicted"), n("n_wrong").alias("wrong"), n("n_missed").alias("missed")).withColumn("tp", F.col("predicted") - F.col("wrong"))
    nan = F.lit(float("nan"))
    out = sums.withColumn("precision", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(nan)).withColumn(
        "recall", F.when(F.col("tp") + F.col("missed") > 0, F.col("tp") / (F.col("tp") + F.col("missed"))).otherwise(nan)
    )
    fine = ~F.isnan("precision") & ~F.isnan("recall") & (F.col("precision") >= gate) & (F.col("recall") >= gate)
    return out.withColumn("good_enough", fine)


def outermost(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """er_flat_spans: spans inside a longer one of the same text go.

    In order of start and falling end, a span is inside another exactly where an earlier one ends at or beyond its end.
    """
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "label").rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumn("_reach", F.max("end").over(order)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).drop("_reach")


def doccano(sentences: DataFrame, mentions: DataFrame, *, key: str = "sentence_id", keep: bool = False) -> DataFrame:
    """snk_doccano_jsonl: one JSON line a sentence, with [start, end, tag] lists, also where there are none; ``keep``: with its key, in no order."""
    one: Column = F.concat(F.lit("["), F.col("start"), F.lit(","), F.col("end"), F.lit(","), F.to_json(F.array("label")).substr(F.lit(2), F.length(F.to_json(F.array("label"))) - 2), F.lit("]"))
    spans = mentions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", one.alias("j")))).alias("all"))
    text = F.to_json(F.array("sentence"))
    line = F.concat(F.lit('{"text":'), text.substr(F.lit(2), F.length(text) - 2), F.lit(',"label":['), F.coalesce(F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("")), F.lit("]}"))
    out = sentences.join(spans, key, "left").select(key, line.alias("value"))
    return out if keep else out.orderBy(key).select("value")

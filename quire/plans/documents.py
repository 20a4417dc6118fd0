"""Whole chains: a text collection to mentions, a volume's pages to continuous text, model answers to results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import json_repair
from quire.functions import text as T
from quire.operators import layout, mentions, relations, segment
from quire.session import materialize
from quire.sources.readers import RELATION

ENTITIES = "category string, name string"


def mention_counts(docs: DataFrame) -> DataFrame:
    """(lang, label, n): cleaned texts, sentences, the rule predictor's mentions."""
    clean = docs.select("doc_id", "lang", T.footnote_clean(F.coalesce("text", F.lit(""))).alias("text"))
    parts = clean.select("doc_id", "lang", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_id", "sentence"))

    def found(name: str, pattern: str):
        return F.array_repeat(F.lit(name), F.size(F.regexp_extract_all("sentence", F.lit(f"({pattern})"), 1)))

    return parts.select("lang", F.explode(F.concat(*[found(*rule) for rule in mentions.RULES])).alias("label")).groupBy("lang", "label").agg(F.count("*").alias("n"))


def volume(lines: DataFrame, style: str = "unicode") -> dict[str, DataFrame]:
    """A volume's lines to ``lines``, ``paragraphs``, ``body``, ``notes``, ``footnotes`` (status a page) and ``audit``."""
    kept = materialize(layout.kept_lines(lines), "lines")  # what follows reads it several times
    marked, footnotes = layout.with_markers(kept, style)
    marked = materialize(marked, "marked")
    runs = materialize(layout.paragraphs(layout.strata(marked)), "runs")
    paras = materialize(layout.two_columns(layout.titled(layout.reflowed(runs))), "paragraphs")
    changed = layout.audit(kept.select("page", "line_idx", F.col("raw").alias("text")), kept, "rule").unionByName(layout.audit(kept, marked, "marker"))
    return {"lines": marked, "paragraphs": paras, "body": layout.joined_body(paras), "notes": layout.joined_notes(paras), "footnotes": footnotes, "audit": changed, "folios": layout.folios(paras)}


def prepared(docs: DataFrame, *, corrector: Callable[[pd.Series], pd.Series] | None = None, first: int = 20_000) -> DataFrame:
    """tx_clean_ocr and er_correct_text: ``cleaned``, ``corrected``, ``note`` and flt_nonempty_doc's ``status``.

    The corrector sees the first 20,000 characters; what is shorter than 10 afterwards counts as failed.
    """
    out = docs.withColumn("cleaned", T.clean_ocr(F.coalesce("text", F.lit(""))))
    out = out.withColumn("status", F.when(F.col("cleaned") == "", "failed").otherwise("success"))
    if corrector is None:
        return out.withColumn("corrected", F.col("cleaned")).withColumn("note", F.lit(None).cast("string"))
    udf = F.pandas_udf(lambda s: corrector(s), "string")
    new = udf(F.left("cleaned", F.lit(first)))
    out = out.withColumn("_new", new)
    failed = F.col("_new").isNull() | (F.length("_new") < 10)
    rest = F.substring(F.col("cleaned"), F.lit(first + 1), F.length("cleaned"))
    joined = F.when(rest != "", F.concat("_new", F.lit("\n\n"), rest)).otherwise(F.col("_new"))
    return out.withColumn("corrected", F.when(failed, F.col("cleaned")).otherwise(joined)).withColumn("note", F.when(failed, "correction failed")).drop("_new")


def answers(docs: DataFrame, client: Callable[[str, int], str], *, text: str = "corrected", tries: int = 3) -> DataFrame:
    """er_extract_llm, er_relations_llm, er_chat_retry: (doc_id, chunk, start_page, answer, error) of overlapping chunks."""
    import time

    chunks = segment.chunks(docs, text=text)
    placed = segment.page_asof(chunks, segment.page_index(docs, text=text)).repartition("doc_id", "start")

    def ask(chunk: str, page: int):
        for n in range(tries):
            try:
                return client(chunk, page), None
            except Exception as e:  # a failed chunk is a row, not a failed job
                error = str(e)
                if n + 1 < tries:
                    time.sleep(2**n)
        return None, error

    def run(batches):
        for b in batches:
            got = [ask(c, p) for c, p in zip(b["chunk"], b["page"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "chunk": b["start"], "start_page": b["page"], "answer": [g[0] for g in got], "error": [g[1] for g in got]})

    return placed.mapInPandas(run, "doc_id long, chunk int, start_page int, answer string, error string")


def entity_lists(answered: DataFrame) -> DataFrame:
    """Answers of seven lists to merged entities."""
    from quire.functions.rules import CATEGORIES

    kind = "struct<" + ",".join(f"{c}:array<string>" for c, _, _ in CATEGORIES) + ">"
    got = answered.filter("answer is not null").withColumn("e", F.coalesce(F.from_json(json_repair.fenceless(F.col("answer")), kind), F.from_json(json_repair.repair_json(json_repair.fenceless(F.col("answer"))), kind)))

    def named(c: str):
        return F.transform(F.coalesce(F.col(f"e.{c}"), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("category"), i.alias("pos"), x.alias("name")))

    rows = F.flatten(F.array(*[named(c) for c, _, _ in CATEGORIES]))
    return relations.merged_entities(got.select("doc_id", "chunk", F.inline(rows)))


def relation_lists(answered: DataFrame, entities: DataFrame, known_names: DataFrame | None = None, properties: DataFrame | None = None) -> DataFrame:
    """er_process_document's relations: parsed, turned, typed, deduplicated, validated and aligned."""
    kind = "struct<" + ",".join(x.strip().replace(" ", ":") for x in RELATION.split(",")) + ">"
    got = answered.filter("answer is not null").select("doc_id", "chunk", F.posexplode(json_repair.parsed(F.col("answer"), kind, "relationships")).alias("pos", "r")).select("doc_id", "chunk", "pos", "r.*")
    long = entities.select("doc_id", "category", F.explode("names").alias("name"))
    typed = relations.resolved(relations.inverted(got), long)
    return relations.aligned(relations.validated(relations.deduplicated(typed, ["chunk", "pos"])), known_names, properties)

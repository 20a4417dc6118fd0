"""Writers and the tables behind exports."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T


def csv_with_bom(df: DataFrame, path: str) -> None:
    """snk_csv_bom: a byte-order mark before the first header's name."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", "true").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """snk_result_json, snk_doccano_jsonl, snk_batch_json: non-ASCII characters stay."""
    (df.write.mode("overwrite").text(path) if df.columns == ["value"] else df.write.mode("overwrite").option("ignoreNullFields", "false").json(path))


def batch_summary(results: DataFrame) -> DataFrame:
    """ag_batch_summary."""
    ok = F.col("status") == "success"
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


def batch_text(results: DataFrame, text: str) -> DataFrame:
    """snk_batch_text: all texts under headings, by name, one row for each batch."""
    part = F.concat(F.lit("=== "), F.col("name"), F.lit(" ===\n"), F.col(text))
    return results.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def unified_diff(pages: DataFrame) -> DataFrame:
    """snk_unified_diff: (page, before, after) to (page, diff), without context. A page is one row."""

    def run(batches):
        for b in batches:
            diff = ["\n".join(difflib.unified_diff(x.split("\n"), y.split("\n"), f"plaintext/{p}", f"corrected/{p}", n=0, lineterm="")) for p, x, y in zip(b["page"], b["before"], b["after"])]
            yield pd.DataFrame({"page": b["page"], "diff": diff})

    return pages.select("page", "before", "after").mapInPandas(run, "page string, diff string")


def manifest(wanted: DataFrame, sentences: DataFrame) -> DataFrame:
    """snk_manifest: (path, ...) with found, sentences and tokens."""
    sizes = sentences.groupBy("path").agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens"))
    return wanted.join(sizes, "path", "left").withColumn("found", F.col("sentences").isNotNull()).na.fill(0, ["sentences", "tokens"])


def label_studio_tasks(pages: DataFrame, spans: DataFrame, links: DataFrame, model: str = "quire") -> DataFrame:
    """snk_label_studio, er_annot_tasks: one JSON task a page. pages: (doc_id, page, text, raw_text, image); spans: (doc_id, page, span_id, start, end, name, label); links as ``relation_spans`` gives them."""
    labels = F.create_map(*[F.lit(x) for _, t, n in R.CATEGORIES for x in (t, n)])
    span = F.struct(
        F.col("span_id").alias("id"), F.lit("text").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"),
        F.struct("start", "end", F.col("name").alias("text"), F.array(F.coalesce(labels[F.col("label")], F.col("label"))).alias("labels")).alias("value"),
    )
    link = F.struct(F.col("from_span").alias("from_id"), F.col("to_span").alias("to_id"), F.lit("relation").alias("type"), F.lit("right").alias("direction"), F.array("relation_type").alias("labels"))
    by = ["doc_id", "page"]
    a = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "span_id", F.to_json(span).alias("j")))).alias("spans"))
    b = links.filter("found").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", F.to_json(link).alias("j")))).alias("links"))
    both = pages.join(a, by, "left").join(b, by, "left")
    result = F.array_join(F.concat(*[F.coalesce(F.transform(c, lambda x: x["j"]), F.array().cast("array<string>")) for c in ("spans", "links")]), ",")
    data = F.to_json(F.struct("doc_id", "page", "text", "raw_text", "image"))
    return both.select(*by, F.concat(F.lit('{"data":'), data, F.lit(f',"predictions":[{{"model_version":"{model}","result":['), result, F.lit("]}]}")).alias("value"))


def label_config() -> str:
    """The labelling interface: one label a category, one relation a type."""
    labels = "".join(f'<Label value="{label}"/>' for _, _, label in R.CATEGORIES)
    links = "".join(f'<Relation value="{r[0]}"/>' for r in R.RELATIONS)
    return f'<View><Relations>{links}</Relations><Labels name="labels" toName="text">{labels}</Labels><Text name="text" value="$text"/></View>'


def relation_rows(rel: DataFrame) -> DataFrame:
    """snk_md_table: (n, value): a Markdown table of relations, header first."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("subject", "relation_type", "object")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells, T.evidence_trimmed(F.coalesce("evidence", F.lit("")))), F.lit(" |"))
    head = rel.sparkSession.createDataFrame([(-2, "| subject | relation | object | evidence |"), (-1, "|-|-|-|-|")], "n long, value string")
    return head.unionByName(rel.select(F.col("n").cast("long").alias("n"), row.alias("value"))).orderBy("n")


def graph_html(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """snk_html_graph: (doc_id-free) one row of JSON for nodes and one for edges, which a page's script draws."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("name", "type")).alias("value")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "label")).alias("value")))


def entity_preview(merged: DataFrame, most: int = 15) -> DataFrame:
    """tk_entity_list: the first names, and how many more there are."""
    more = F.size("names") - most
    shown = F.array_join(F.slice("names", 1, most), ", ")
    return merged.select("doc_id", "category", F.when(more > 0, F.concat(shown, F.lit(" … and "), more.cast("string"), F.lit(" more"))).otherwise(shown).alias("shown"))


def statistics(merged: DataFrame, rel: DataFrame) -> DataFrame:
    """ag_statistics, ag_doc_entity_total: names by document in all, relations valid and flagged."""
    a = merged.groupBy("doc_id").agg(F.sum(F.size("names")).alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.size("names").alias("n"))))).alias("by_category"))
    b = rel.groupBy("doc_id").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("flagged"))
    return a.join(b, "doc_id", "full").na.fill(0, ["entities", "valid", "flagged"])

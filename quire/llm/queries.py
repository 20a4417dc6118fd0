"""The queries of this package, under the contracts of their digests, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held_out
from quire.session import ship, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_counts import token_counts

    return token_counts(table(ship(spark), sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.minhash import near_duplicates

    return near_duplicates(table(ship(spark), sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import score_quality, train_quality

    docs, labels = table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_quality(docs, train_quality(docs, labels, ~held_out(F.col("doc_id"), 5, 0)))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "difference")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import dedup_substrings

    return dedup_substrings(table(ship(spark), sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import decontaminate

    return decontaminate(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(table(ship(spark), sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.line_dedup import dedup_lines

    return dedup_lines(table(ship(spark), sf_dir, "documents")).drop("kept")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.language_model import score_texts

    return score_texts(table(ship(spark), sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.neighbours import nearest

    return nearest(table(ship(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import score_toxicity, train_toxicity

    docs, labels = table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_toxicity(docs, train_toxicity(docs, labels, ~held_out(F.col("doc_id"), 4, 2)))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_packing": op5_packing,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_model": op7_language_model,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_toxicity": op9_toxicity,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    from quire.llm.line_dedup import LINE_SQL

    return {"op4_decontamination": OP4_SQL, "op6_line_dedup": LINE_SQL}


OP4_SQL = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bench WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), placed AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM docs CROSS JOIN (SELECT DISTINCT n FROM grams) AS sizes WHERE len(w) >= n
), found AS (
  SELECT p.doc_id, p.i, p.n, grams.item_id
  FROM placed AS p JOIN grams ON grams.n = p.n AND grams.g = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

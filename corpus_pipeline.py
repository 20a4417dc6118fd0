"""The corpus pipeline: what goes in is ``documents``, what comes out are packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns;
the last one returns the pieces and their places. Between stages, documents are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held_out
from quire.llm.decontaminate import decontaminate
from quire.llm.line_dedup import by_script, without_repeated_lines
from quire.llm.minhash import distinct_documents
from quire.llm.packing import pack
from quire.llm.quality import accepted, train_quality
from quire.llm.queries import vocabulary
from quire.session import materialize, ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    labels = table(ship(spark), sf_dir, "labels")
    return accepted(docs, train_quality(docs, labels, ~held_out(F.col("doc_id"), 5, 0)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines, nor of lines in 10 places or more; those that were nothing else go."""
    out = without_repeated_lines(docs, widely=10, words=by_script)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]
#: SQL can't express the classifier, the signatures or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

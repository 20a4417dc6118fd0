"""Segmentation: sentences, chunks, pages, and as-of lookups of a page or line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def sentences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", protect: bool = False, first: int = 0) -> DataFrame:
    """(key, sentence_id, sentence), numbered from ``first``."""
    return docs.select(key, F.posexplode(T.split_sentences(F.coalesce(F.col(text), F.lit("")), protect)).alias("n", "sentence")).select(key, (F.col("n") + first).alias("sentence_id"), "sentence")


def short_sentences(table: DataFrame, *, under: int = 25, most: int = 15) -> DataFrame:
    """tk_short_sent: the first short ones in order."""
    key = table.columns[0]
    return table.filter(F.length("sentence") < under).orderBy(key, "sentence_id").limit(most)


def chunks(docs: DataFrame, *, size: int = 8000, overlap: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """tx_chunk_overlap: (key, start, chunk); the last chunk is the one that reaches the end."""
    step, n = size - overlap, F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    return docs.filter(F.col(text).isNotNull()).select(key, text, F.explode(starts).alias("start")).select(key, "start", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


MARK = r"(?i)\[\[\s*page\s+(\d+)\s*\]\]"


def page_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """tx_page_index: (key, page, start, page_start): where each marker stands and where its page's text starts, in characters."""
    marks = F.regexp_extract_all(text, F.lit("(?i)(\\[\\[\\s*page\\s+\\d+\\s*\\]\\])"), 1)
    parts = F.split(text, MARK, -1)
    before = lambda i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("marks", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
    at = docs.select(key, marks.alias("marks"), parts.alias("parts"))
    rows = F.transform("marks", lambda m, i: F.struct(F.regexp_extract(m, MARK, 1).cast("int").alias("page"), before(i).alias("start"), (before(i) + F.length(m)).alias("page_start"), F.get("parts", i + 1).alias("text")))
    return at.select(key, F.inline(rows))


def split_pages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """tx_split_pages: (key, page, text). Without a marker, all is page 1; of a page met twice, the later one counts."""
    marked = page_index(docs, key=key, text=text).groupBy(key, "page").agg(F.max_by("text", "start").alias("text"))
    plain = docs.filter(~F.col(text).rlike(MARK)).select(key, F.lit(1).alias("page"), F.col(text).alias("text"))
    trim = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return marked.unionByName(plain).withColumn("text", trim)


def page_asof(offsets: DataFrame, marks: DataFrame, *, key: str = "doc_id", at: str = "start") -> DataFrame:
    """jn_page_asof, jn_line_asof: each offset with the last mark at or before it; 1 before the first.

    A union and a window by key, since Spark has no as-of join.
    """
    extra = [c for c in offsets.columns if c not in (key, at)]
    left = offsets.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("page"), F.struct(*[F.col(c) for c in extra]).alias("_row") if extra else F.lit(None).cast("struct<x:int>").alias("_row"))
    right = marks.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), "page", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(order), F.lit(1))).filter("_kind = 1")
    return out.select(key, F.col("_at").alias(at), "page", *[F.col(f"_row.{c}").alias(c) for c in extra])


def page_ranges(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """wn_page_ranges: consecutive pages as a–b, comma-joined in order."""
    island = pages.select(*keys, page).distinct().withColumn("g", F.col(page) - F.row_number().over(Window.partitionBy(*keys).orderBy(page)))
    runs = island.groupBy(*keys, "g").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    name = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", name.alias("r")))).alias("all")).select(*keys, F.array_join(F.transform("all", lambda x: x["r"]), ", ").alias("ranges"))


def regex_preview(docs: DataFrame, pattern: str, *, key: str = "doc_id", text: str = "text", width: int = 40, most: int = 20, never: str | None = None) -> DataFrame:
    """tk_match_preview: the first matches of each text with their surroundings.

    The expression tries ``width`` places from each character on. ``never`` is a class of characters that no match has:
    of a stretch of these, only what surroundings reach stays, parted by a line's end, which they don't cross.
    """
    flat = whole = F.replace(F.col(text), F.lit("\n"), F.lit(" "))
    if never is not None:
        flat = F.regexp_replace(flat, f"({never}{{{width + 1}}}){never}+({never}{{{width + 1}}})", "$1\n$2")
    context = F.regexp_extract_all(flat, F.lit(f"(?d)(.{{0,{width}}}(?:{pattern}).{{0,{width}}})"), 1)
    found = docs.filter(whole.rlike(pattern)) if never is not None else docs
    return found.select(key, F.posexplode(F.slice(context, 1, most)).alias("n", "preview"))


def page_texts(rows: DataFrame, pages: DataFrame, *, on: list[str], text: str = "text") -> DataFrame:
    """jn_page_text: each row with its page's raw text, empty where there is none."""
    return rows.join(pages.select(*on, F.col(text).alias("raw_text")), on, "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))

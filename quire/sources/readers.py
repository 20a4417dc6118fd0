"""Readers: layout XML, texts, token-tagged TSV, JSON documents, vocabularies, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COORDS = "Coords struct<_points:string>"
WORD = f"struct<_id:string,{COORDS.replace(' ', ':', 1)},TextEquiv:array<struct<_conf:double,Unicode:string>>>"
LINE = f"struct<_id:string,{COORDS.replace(' ', ':', 1)},TextEquiv:array<struct<_conf:double,Unicode:string>>,Word:array<{WORD}>>"
PAGE_SCHEMA = (
    f"_imageFilename string, _imageWidth int, _imageHeight int, ImageRegion array<struct<_id:string,{COORDS.replace(' ', ':', 1)}>>, "
    f"TextRegion array<struct<_id:string,_type:string,{COORDS.replace(' ', ':', 1)},TextLine:array<{LINE}>>>"
)


def bbox(points: Column) -> Column:
    """src_bbox: 'x,y x,y ...' to a struct of x0, y0, x1, y1."""
    xy = F.transform(F.split(F.btrim(points), r"\s+"), lambda p: F.split(p, ","))
    xs, ys = F.transform(xy, lambda p: F.get(p, F.lit(0)).cast("double").cast("int")), F.transform(xy, lambda p: F.get(p, F.lit(1)).cast("double").cast("int"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def page_number(name: Column) -> Column:
    """src_page_num: the first four digits of a file's name."""
    return F.regexp_extract(name, r"(\d{4})", 1)


def page_xml(spark: SparkSession, path: str) -> DataFrame:
    """src_page_xml: the lines of all pages. Words without text are left out, regions without lines, too; images count anywhere."""
    pages = spark.read.format("xml").option("rowTag", "Page").option("ignoreNamespace", "true").schema(PAGE_SCHEMA).load(path)
    pages = pages.select(page_number(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("page"), F.col("_imageWidth").alias("width"), F.col("_imageHeight").alias("height"), "ImageRegion", "TextRegion")
    images = F.transform(F.coalesce("ImageRegion", F.array()), lambda r: bbox(r["Coords"]["_points"]))
    lines = pages.select("page", "width", "height", images.alias("images"), F.posexplode("TextRegion").alias("region_idx", "r")).select(
        "page", "width", "height", "images", "region_idx", F.col("r._id").alias("region"), F.posexplode("r.TextLine").alias("pos", "l")
    )
    words = F.filter(
        F.transform(F.coalesce("l.Word", F.array()), lambda w: F.struct(F.get(w["TextEquiv"], F.lit(0))["Unicode"].alias("text"), F.get(w["TextEquiv"], F.lit(0))["_conf"].alias("conf"), bbox(w["Coords"]["_points"]).alias("b"))),
        lambda w: F.btrim(F.coalesce(w["text"], F.lit(""))) != "",
    )
    flat = F.transform(words, lambda w: F.struct(F.btrim(w["text"]).alias("text"), w["conf"].alias("conf"), w["b"]["x0"].alias("x0"), w["b"]["y0"].alias("y0"), w["b"]["x1"].alias("x1"), w["b"]["y1"].alias("y1")))
    order = Window.partitionBy("page").orderBy("region_idx", "pos")
    out = lines.withColumn("b", bbox(F.col("l.Coords._points"))).withColumn("line_idx", F.row_number().over(order) - 1)
    plain = F.coalesce(F.nullif(F.array_join(F.transform(flat, lambda w: w["text"]), " "), F.lit("")), F.get("l.TextEquiv", F.lit(0))["Unicode"])
    return out.select("page", "width", "height", "images", "region", "region_idx", "line_idx", F.col("l._id").alias("line_id"), "b.x0", "b.y0", "b.x1", "b.y1", flat.alias("words"), plain.alias("plain"))


def plain_lines(lines: DataFrame) -> DataFrame:
    """src_plain_extract: (page, line_idx, text): a line's own words, else its own text."""
    return lines.select("page", "line_idx", F.coalesce("plain", F.lit("")).alias("text"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """src_text: (path, text), a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "pdf"), most_bytes: int = 50 << 20) -> DataFrame:
    """src_dir_batch, flt_file_size: (path, length, content, accepted) of files with these suffixes; larger ones aren't accepted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.filter(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$")).withColumn("accepted", F.col("length") <= most_bytes)


def iob(spark: SparkSession, path: str) -> DataFrame:
    """src_iob_tsv of files: see ``iob_sentences``."""
    texts = whole_texts(spark, path)
    return iob_sentences(texts)


def iob_sentences(texts: DataFrame) -> DataFrame:
    """src_iob_tsv, wn_doc_carry: (path, text) to (path, document_id, sentence_no, tokens, ner_tags).

    What stands before the header is left out; a blank line or EndOfSentence ends a sentence; lines
    that begin with # are comments, of which document ids are kept as they are when the sentence ends.
    """
    from quire.functions.text import canonical_tag

    lines = texts.select("path", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "line"))
    by = Window.partitionBy("path").orderBy("n")
    lines = lines.withColumn("header", F.first(F.when(F.col("line").startswith("TOKEN"), F.col("line")), ignorenulls=True).over(by)).filter(F.col("header").isNotNull() & ~F.col("line").startswith("TOKEN"))
    doc = F.when(F.col("line").startswith("#"), F.nullif(F.regexp_extract("line", r"document_id\s*=\s*(\S+)", 1), F.lit("")))
    names, cells = F.split("header", "\t", -1), F.split("line", "\t", -1)
    cell = lambda name: F.get(cells, F.array_position(names, F.lit(name)).cast("int") - 1)
    rows = lines.withColumn("doc", F.last(doc, ignorenulls=True).over(by)).withColumn("comment", F.col("line").startswith("#"))
    rows = rows.withColumn("token", F.when(~F.col("comment") & (F.btrim("line") != ""), cell("TOKEN"))).withColumn("tag", cell("NE-COARSE-LIT"))
    misc = F.coalesce(F.when(F.array_position(names, F.lit("MISC")) > 0, cell("MISC")), F.lit("_"))
    ends = (~F.col("comment") & (F.btrim("line") == "")) | (F.col("token").isNotNull() & misc.contains("EndOfSentence"))
    rows = rows.withColumn("ends", ends).withColumn("s", F.coalesce(F.sum(F.col("ends").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("n", "token", canonical_tag(F.col("tag")).alias("tag")))))
    out = rows.groupBy("path", "s").agg(each.alias("all"), F.max_by("doc", "n").alias("document_id")).filter(F.size("all") > 0)
    number = F.row_number().over(Window.partitionBy("path").orderBy("s")) - 1
    return out.select("path", "document_id", number.alias("sentence_no"), F.transform("all", lambda x: x["token"]).alias("tokens"), F.transform("all", lambda x: x["tag"]).alias("ner_tags"))


def iob_files(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """src_iob_locate: wanted (dataset, split, lang) with the first fitting file's path, null where there is none."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "HIPE-2022-*.tsv").load(root).select("path")
    m = lambda i: F.regexp_extract("path", r"HIPE-2022-.*?-([^-/]+)-([^-/]+)-([^-/]+)\.tsv$", i)
    best = there.select(m(1).alias("dataset"), m(2).alias("split"), m(3).alias("lang"), "path").groupBy("dataset", "split", "lang").agg(F.min("path").alias("path"))
    return wanted.join(best, ["dataset", "split", "lang"], "left")


def tagged_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """src_jsonl."""
    return spark.read.schema("tokens array<string>, ner_tags array<string>").json(path)


RELATION = "subject string, subject_type string, relation_type string, object string, object_type string, evidence string, page int"
DOCUMENT = f"status string, source struct<file_path:string,file_type:string,ocr_confidence:double,num_pages:int>, raw_text string, extracted_text string, entities struct<{','.join(f'{c}:array<string>' for c in ('persons', 'places', 'physical_human_made_thing', 'visual_item', 'iconographic_subject', 'dates', 'groups'))}>, relationships array<struct<{','.join(x.strip().replace(' ', ':') for x in RELATION.split(','))}>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """src_json_doc: result or gold files, with the file's name as ``doc_id``."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "")
    return spark.read.schema(DOCUMENT).option("multiLine", "true").json(path).withColumn("doc_id", name)


def paired(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jn_doc_pairs: documents on both sides, and gold ids without a prediction."""
    return gold.alias("g").join(pred.alias("p"), "doc_id"), gold.join(pred, "doc_id", "left_anti").select("doc_id")


def relation_names(spark: SparkSession, path: str) -> DataFrame:
    """src_vocab: the database's relation names, one a line."""
    return spark.read.text(path).select(F.btrim("value").alias("relation_name")).filter("relation_name != ''")


def properties(spark: SparkSession, path: str) -> DataFrame:
    """src_vocab: declared properties (id, name, inverse, page)."""
    return spark.read.schema("id string, name string, inverse string, page int").option("multiLine", "true").json(path)


def settings(text: str, overrides: list[str] = ()) -> dict:
    """src_yaml_cfg: nested ``key: value`` settings, and dotted key=value overrides. Plain scalars and flat lists."""
    import json

    def value(v: str):
        v = v.split(" #")[0].strip()
        try:
            return json.loads(v)
        except ValueError:
            return [value(x) for x in v[1:-1].split(",")] if v.startswith("[") and v.endswith("]") else v.strip("'\"")

    out: dict = {}
    stack = [(-1, out)]
    for line in text.splitlines():
        if not line.strip() or line.strip().startswith("#"):
            continue
        depth, (k, _, v) = len(line) - len(line.lstrip()), line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if v.split("#")[0].strip():
            stack[-1][1][k] = value(v)
        else:
            stack.append((depth, stack[-1][1].setdefault(k, {})))
    for o in overrides:
        *path, last = o.partition("=")[0].split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value(o.partition("=")[2])
    return out


def ocr_confidence(words: DataFrame, *by: str) -> DataFrame:
    """ag_ocr_conf: the mean of positive word confidences, 0 without any."""
    return words.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)).alias("ocr_confidence"))


def ocr(found: DataFrame, engine) -> DataFrame:
    """src_ocr_image, src_ocr_pdf: ``engine`` turns (path, content) frames into (path, page, text, ocr_confidence); pages join behind markers."""

    def run(batches):
        for b in batches:
            yield engine(b)

    pages = found.filter("accepted").select("path", "content").mapInPandas(run, "path string, page int, text string, ocr_confidence double")
    part = F.concat(F.lit("[[PAGE "), F.col("page").cast("string"), F.lit("]]\n"), F.col("text"))
    return pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"), F.avg(F.when(F.col("ocr_confidence") > 0, F.col("ocr_confidence"))).alias("ocr_confidence"), F.count("*").alias("num_pages"))


def workspace_names(found: DataFrame) -> DataFrame:
    """src_workspace: page ids by the order of file names, a folder at a time."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return found.select("path", F.format_string("PHYS_%04d", F.row_number().over(Window.partitionBy(folder).orderBy("path"))).alias("page_id"))

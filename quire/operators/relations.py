"""Relations between entities: inverse names, types, validation, alignment with vocabularies, merging, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import rules as R

COLUMNS = ["subject", "subject_type", "relation_type", "object", "object_type"]


def taxonomy(spark: SparkSession) -> DataFrame:
    """(relation, subjects, objects, cidoc, names, other_type, other_names)."""
    rows = [(r, sorted(s), sorted(o), c, n.split(), next(iter(x), None), (next(iter(x.values()), "")).split()) for r, s, o, c, n, x in R.RELATIONS]
    return spark.createDataFrame(rows, "relation string, subjects array<string>, objects array<string>, cidoc string, names array<string>, other_type string, other_names array<string>")


def normal(name):
    return F.btrim(F.lower(name))


def inverted(rel: DataFrame) -> DataFrame:
    """er_inverse: has_author becomes created, with both ends exchanged."""
    turn = normal(F.col("relation_type")) == "has_author"
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    new = {c: swap(c, d) for c, d in (("subject", "object"), ("object", "subject"), ("subject_type", "object_type"), ("object_type", "subject_type"))}
    new["relation_type"] = F.when(turn, "created").otherwise(F.col("relation_type")).alias("relation_type")
    return rel.select(*[new.get(c, F.col(c)) for c in rel.columns])


def type_lookup(entities: DataFrame) -> DataFrame:
    """(doc_id, name, type): the first category, in their fixed order, that has the name. entities: (doc_id, category, name)."""
    order = F.create_map(*[F.lit(x) for i, (c, _, _) in enumerate(R.CATEGORIES) for x in (c, i)])
    types = F.create_map(*[F.lit(x) for c, t, _ in R.CATEGORIES for x in (c, t)])
    rows = entities.select("doc_id", normal(F.col("name")).alias("name"), order[F.col("category")].alias("o"), types[F.col("category")].alias("type")).filter("o is not null")
    return rows.groupBy("doc_id", "name").agg(F.min_by("type", "o").alias("type"))


def resolved(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """jn_type_lookup, er_resolve_types: types from the entity lists win over those of the relation."""
    look = type_lookup(entities)
    out = rel
    for end in ("subject", "object"):
        own = look.select(F.col("doc_id"), F.col("name").alias("_n"), F.col("type").alias("_t"))
        out = out.withColumn("_n", normal(F.col(end))).join(own, ["doc_id", "_n"], "left").withColumn(f"{end}_type", F.coalesce("_t", f"{end}_type")).drop("_n", "_t")
    return out.select(*rel.columns)


def validated(rel: DataFrame) -> DataFrame:
    """jn_taxonomy, er_validate: ``valid`` and ``invalid_reason``; an unknown relation is valid. The taxonomy has 22 rows."""
    tax = F.broadcast(taxonomy(rel.sparkSession).select("relation", "subjects", "objects"))
    out = rel.withColumn("relation", normal(F.col("relation_type"))).join(tax, "relation", "left")

    def reason(end: str):
        allowed = F.col(f"{end}s")
        said = F.concat(F.lit(f"{end}_type '"), F.coalesce(f"{end}_type", F.lit("")), F.lit("' not in ["), F.array_join(allowed, ", "), F.lit("] for '"), F.col("relation_type"), F.lit("'"))
        return F.when(allowed.isNotNull() & ~F.array_contains(allowed, F.coalesce(normal(F.col(f"{end}_type")), F.lit(""))), said)

    why = F.concat_ws("; ", reason("subject"), reason("object"))
    return out.withColumn("invalid_reason", why).withColumn("valid", F.col("invalid_reason") == "").drop("relation", "subjects", "objects")


def aligned(rel: DataFrame, known_names: DataFrame | None = None, properties: DataFrame | None = None) -> DataFrame:
    """jn_alignment, er_align: ``db_schema_match``, ``cidoc_property`` and ``coverage``. ``known_names``: (relation_name); None takes all."""
    tax = taxonomy(rel.sparkSession).select("relation", "cidoc", "names", "other_type", "other_names")
    if known_names is not None:  # the vocabulary restricts the 22 rows' names; it is joined, never collected
        named = tax.select("relation", F.posexplode("names").alias("i", "relation_name")).join(known_names.distinct(), "relation_name").groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("i", "relation_name"))).alias("n"))
        other = tax.select("relation", F.posexplode("other_names").alias("i", "relation_name")).join(known_names.distinct(), "relation_name").groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("i", "relation_name"))).alias("m"))
        none = F.array().cast("array<string>")
        tax = tax.drop("names", "other_names").join(named, "relation", "left").join(other, "relation", "left").select(
            "relation", "cidoc", "other_type", F.coalesce(F.transform("n", lambda x: x["relation_name"]), none).alias("names"), F.coalesce(F.transform("m", lambda x: x["relation_name"]), none).alias("other_names")
        )
    if properties is not None:
        from quire.functions.text import property_label

        labels = properties.select(F.col("id").alias("cidoc"), property_label(F.col("id"), F.col("name"), F.col("inverse")).alias("label"))
        tax = tax.join(labels, "cidoc", "left").withColumn("cidoc", F.coalesce("label", "cidoc")).drop("label")
    tax = F.broadcast(tax.withColumn("known", F.lit(True)))
    out = rel.withColumn("relation", normal(F.col("relation_type"))).join(tax, "relation", "left")
    names = F.when(F.col("other_type") == normal(F.col("object_type")), F.col("other_names")).otherwise(F.col("names"))
    out = out.withColumn("db_schema_match", F.coalesce(names, F.array().cast("array<string>"))).withColumnRenamed("cidoc", "cidoc_property")
    db, cidoc = F.size("db_schema_match") > 0, F.col("cidoc_property").isNotNull()
    verdict = F.when(F.col("known").isNull(), "novel").when(db & cidoc, "db+cidoc").when(cidoc, "cidoc_only").when(db, "db_only").otherwise("known_gap")
    return out.withColumn("coverage", verdict).drop("relation", "known", "names", "other_type", "other_names")


def deduplicated(rel: DataFrame, order: list[str]) -> DataFrame:
    """ag_dedupe_rels: the first of each (subject, relation, object), ends without regard to case."""
    by = Window.partitionBy("doc_id", F.lower("subject"), "relation_type", F.lower("object")).orderBy(*order)
    return rel.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def merged_entities(found: DataFrame) -> DataFrame:
    """ag_merge_entities: (doc_id, category, chunk, pos, name) to ordered lists; the first spelling of a name stays."""
    first = found.filter(F.btrim("name") != "").groupBy("doc_id", "category", normal(F.col("name")).alias("k")).agg(F.min(F.struct("chunk", "pos", F.btrim("name").alias("name"))).alias("f"))
    return first.groupBy("doc_id", "category").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["name"]).alias("names"))


def coverage(rel: DataFrame, *, order: str = "n", most: int = 3) -> DataFrame:
    """ag_coverage: (coverage, relation_type, n, examples): counts, and the first evidences of what no vocabulary has."""
    shown = Window.partitionBy("coverage", "relation_type").orderBy(order)
    rows = rel.withColumn("_r", F.row_number().over(shown))
    example = F.when((F.col("_r") <= most) & F.col("coverage").isin("novel", "known_gap"), F.struct(order, "evidence"))
    return rows.groupBy("coverage", "relation_type").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(example)), lambda x: x["evidence"]).alias("examples"))


def nodes(rel: DataFrame, order: str = "n") -> DataFrame:
    """jn_nodes: (name, type): of several types, the first seen, a subject before an object."""
    ends = rel.select(F.col("subject").alias("name"), F.col("subject_type").alias("type"), F.col(order).alias("o"), F.lit(0).alias("e")).unionByName(
        rel.select(F.col("object").alias("name"), F.col("object_type").alias("type"), F.col(order).alias("o"), F.lit(1).alias("e"))
    )
    return ends.groupBy("name").agg(F.min(F.struct("o", "e", "type")).alias("f")).select("name", F.col("f.type").alias("type"))


def edges(rel: DataFrame) -> DataFrame:
    return rel.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("relation_type").alias("label"), *[c for c in ("evidence", "page", "valid") if c in rel.columns])


def relation_spans(rel: DataFrame, spans: DataFrame) -> DataFrame:
    """jn_rel_spans: both ends' first span on their page; ``found`` is false where one is missing.

    rel: (doc_id, page, n, subject, relation_type, object); spans: (doc_id, page, name, ordinal, span_id).
    """
    first = spans.groupBy("doc_id", "page", F.lower("name").alias("k")).agg(F.min_by("span_id", "ordinal").alias("span"))
    out = rel
    for end, name in (("subject", "from_span"), ("object", "to_span")):
        out = out.withColumn("k", F.lower(end)).join(first.withColumnRenamed("span", name), ["doc_id", "page", "k"], "left").drop("k")
    return out.withColumn("found", F.col("from_span").isNotNull() & F.col("to_span").isNotNull())

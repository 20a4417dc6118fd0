"""Registered queries of the page operators and of what is around them, each with its SQL.

The tables hold no scans, so ``lineitem`` stands for OCR lines: a part is a page, its items are lines,
and words, boxes and confidences are arithmetic of the keys, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import json_repair
from quire.functions import rules as R
from quire.functions import text as T
from quire.operators import layout, mentions, relations, scoring, segment, stats
from quire.plans.catalog import REL, SENTENCES, TAG, TEXT, query, sales
from quire.sources import sinks

TOKENS = ["Kirche", "von", "12", "Der", "ALTAR", "S.", "1534", "|"]

LINES_SQL = """
base AS (SELECT l_partkey AS page, l_orderkey * 7 + l_linenumber AS k, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS INT) AS line_idx FROM lineitem),
worded AS (SELECT page, k, line_idx, 'v' || (page % 3) AS volume, 2550 AS width, line_idx // 4 AS region_idx, 'r' || (line_idx // 4) AS region, 'l' || line_idx AS line_id, 1 + k % 9 AS n, 100 + (k % 3) * 20 AS x,
  list_transform(range(0, 1 + k % 9), lambda i: {'text': ['Kirche', 'von', '12', 'Der', 'ALTAR', 'S.', '1534', '|'][(k + i) % 8 + 1], 'conf': CASE WHEN (k + i) % 13 = 0 THEN NULL ELSE ((k * 7 + i * 3) % 80 + 20) / 100.0 END,
    'x0': 100 + (k % 3) * 20 + i * 200 + CASE WHEN k % 5 = 0 AND i * 2 >= 1 + k % 9 THEN 150 ELSE 0 END,
    'x1': 100 + (k % 3) * 20 + i * 200 + CASE WHEN k % 5 = 0 AND i * 2 >= 1 + k % 9 THEN 150 ELSE 0 END + 120 + (k + i) % 4 * 20, 'h': 25 + (k * 3 + i) % 20}) AS words FROM base),
lines AS (SELECT *, x - 5 AS x0, words[len(words)].x1 + 5 AS x1, 195 + line_idx * 60 AS y0, 250 + line_idx * 60 AS y1, page % 5 = 0 AS pictured,
  array_to_string(list_transform(words, lambda w: w.text), ' ') AS text, list_avg(list_filter(list_transform(words, lambda w: w.conf), lambda c: c IS NOT NULL)) AS conf,
  list_sort(list_transform(words, lambda w: w.h))[n // 2 + 1] AS med_h FROM worded),
featured AS (SELECT *, x1 - x0 AS line_width, CAST(length(regexp_replace(text, '\\P{L}', '', 'g')) AS INT) AS letters FROM lines),
widths AS (SELECT page, coalesce(median(line_width) FILTER (letters >= 10 AND med_h >= 35 AND conf >= 0.85), median(line_width) FILTER (letters >= 10), 0.7 * 2550) AS column_width FROM featured GROUP BY page),
judged AS (SELECT f.*, column_width, CASE WHEN trim(text) = '' THEN 'empty'
  WHEN regexp_matches(text, '^[\\(\\[]?[\\dIVXLC/,.\\s–—-]*\\b(?:S|Bd|Nr|Fol|Abb|Taf|Anm|Cap|Fasz)\\.') OR regexp_matches(text, '^(?:Um|Von|Nach|Vor|Ende|Anfang|Mitte)?\\s*\\d{3,4}(?:\\s*[/-]\\s*\\d{1,4})?\\.?$') OR (regexp_matches(text, '^\\d{1,2}[ .]\\S') AND letters >= 3) THEN NULL
  WHEN conf < 0.55 AND letters < 12 THEN 'low confidence' WHEN letters = 0 THEN 'no letters' WHEN letters < 4 AND line_width < 0.35 * column_width THEN 'stub'
  WHEN pictured AND (y0 + y1) / 2 BETWEEN 300 AND 900 AND (coalesce(conf, 0) < 0.85 OR letters < 6) THEN 'in image' END AS drop_reason FROM featured f JOIN widths USING (page))"""


#: What a line's words depend on repeats with k in this period, a multiple of all divisors below; only heights follow the line.
PERIOD = 9360


def lines_of(items: DataFrame) -> DataFrame:
    """Lines with words, boxes and images, made from keys: words come from a table of all k of one period, a few MB."""
    by = Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber")
    base = items.select(F.col("l_partkey").alias("page"), "l_orderkey", "l_linenumber").select("page", F.expr("l_orderkey * 7 + l_linenumber").alias("k"), (F.row_number().over(by) - 1).alias("line_idx"))
    shift = "100 + (k % 3) * 20 + i * 200 + CASE WHEN k % 5 = 0 AND i * 2 >= 1 + k % 9 THEN 150 ELSE 0 END"
    tokens = "array(" + ", ".join(f"'{t}'" for t in TOKENS) + ")"
    words = f"""transform(sequence(0L, k % 9), i -> named_struct('text', {tokens}[int((k + i) % 8)], 'conf', CASE WHEN (k + i) % 13 = 0 THEN NULL ELSE ((k * 7 + i * 3) % 80 + 20) / 100D END,
      'x0', int({shift}), 'h', int((k * 3 + i) % 20), 'x1', int({shift} + 120 + (k + i) % 4 * 20)))"""
    periods = items.sparkSession.range(PERIOD).withColumnRenamed("id", "k").select(F.col("k").alias("_k"), F.expr(words).alias("_words"))
    placed = F.transform("_words", lambda w: F.struct(w["text"].alias("text"), w["conf"].alias("conf"), w["x0"].alias("x0"), F.col("_y").alias("y0"), w["x1"].alias("x1"), (F.col("_y") + 25 + w["h"]).alias("y1")))
    lines = base.withColumn("_y", F.expr("int(200 + line_idx * 60)")).join(F.broadcast(periods), F.col("k") % PERIOD == F.col("_k"), "left")
    out = lines.select(
        F.expr("concat('v', page % 3)").alias("volume"), "page", F.lit(2550).alias("width"),
        F.expr("CASE WHEN page % 5 = 0 THEN array(named_struct('x0', 0, 'y0', 300, 'x1', 2550, 'y1', 900)) ELSE array() END").alias("images"),
        F.expr("line_idx div 4").cast("int").alias("region_idx"), F.expr("concat('r', line_idx div 4)").alias("region"), "line_idx", F.expr("concat('l', line_idx)").alias("line_id"),
        F.expr("int(95 + (k % 3) * 20)").alias("x0"), F.expr("195 + line_idx * 60").alias("y0"), F.expr("250 + line_idx * 60").alias("y1"), placed.alias("words"),
    )
    return out.withColumn("x1", F.element_at("words", -1)["x1"] + 5)


@query("lineitem", sql=f"WITH {LINES_SQL} SELECT page, line_idx, text, CAST(line_width AS INT) AS line_width, round(conf, 6) AS conf, CAST(med_h AS INT) AS med_h, letters FROM featured")
def line_features(items):
    return layout.features(lines_of(items)).select("page", "line_idx", "text", "line_width", F.round("conf", 6).alias("conf"), "med_h", "letters")


@query("lineitem", sql=f"WITH {LINES_SQL} SELECT page, round(column_width, 6) AS column_width FROM widths")
def column_width(items):
    return layout.column_width(layout.features(lines_of(items))).select("page", F.round(F.col("column_width").cast("double"), 6).alias("column_width"))


@query("lineitem", sql=f"WITH {LINES_SQL} SELECT page, line_idx, drop_reason FROM judged")
def noise_reasons(items):
    return layout.noise(layout.features(lines_of(items))).select("page", "line_idx", "drop_reason")


STRAY = f"""{LINES_SQL}, strayed AS (SELECT page, line_idx, CASE WHEN drop_reason IS NULL AND len(words) >= 3 THEN list_filter(words, lambda w: NOT (regexp_matches(w.text, '^[.,;:|_]{{1,2}}$') AND coalesce(w.conf < 0.40, false))) ELSE words END AS w FROM judged)"""


@query("lineitem", sql=f"WITH {STRAY} SELECT page, line_idx, array_to_string(list_transform(w, lambda x: x.text), ' ') AS text FROM strayed")
def stray_words(items):
    return layout.without_stray_words(layout.noise(layout.features(lines_of(items)))).select("page", "line_idx", "text")


@query("lineitem", sql=f"""
WITH {LINES_SQL}, able AS (SELECT page, region FROM judged WHERE drop_reason IS NULL GROUP BY page, region HAVING count(*) <= 4 AND max(line_width) >= 0.6 * 2550),
gaps AS (SELECT page, region, unnest(list_transform(range(2, len(words) + 1), lambda i: {{'gap': words[i].x0 - words[i - 1].x1, 'mid': (words[i].x0 + words[i - 1].x1) / 2}})) AS g FROM judged JOIN able USING (page, region) WHERE drop_reason IS NULL),
bounds AS (SELECT page, region, median(g.mid) AS bound FROM gaps WHERE g.gap >= 120 GROUP BY page, region),
sided AS (SELECT j.*, bound, list_filter(words, lambda w: w.x0 < bound) AS l, list_filter(words, lambda w: w.x0 >= bound) AS r FROM judged j LEFT JOIN bounds USING (page, region)),
parts AS (SELECT page, region_idx, line_idx, 0 AS side, line_id, x0, x1, words AS w FROM sided WHERE bound IS NULL
  UNION ALL SELECT page, region_idx, line_idx, 1, CASE WHEN len(l) > 0 AND len(r) > 0 THEN line_id || '_c1' ELSE line_id END, x0, CASE WHEN len(l) > 0 AND len(r) > 0 THEN list_max(list_transform(l, lambda w: w.x1)) ELSE x1 END,
    CASE WHEN len(l) > 0 AND len(r) > 0 THEN l ELSE words END FROM sided WHERE bound IS NOT NULL AND drop_reason IS NULL
  UNION ALL SELECT page, region_idx, line_idx, 2, line_id || '_c2', list_min(list_transform(r, lambda w: w.x0)), x1, r FROM sided WHERE bound IS NOT NULL AND drop_reason IS NULL AND len(l) > 0 AND len(r) > 0)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY region_idx, side, line_idx) - 1 AS INT) AS line_idx, line_id, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1, array_to_string(list_transform(w, lambda x: x.text), ' ') AS text FROM parts""")  # fmt: skip
def split_halves(items):
    return layout.split_columns(layout.noise(layout.features(lines_of(items)))).select("page", "line_idx", "line_id", "x0", "x1", "text")


BLOCKS = f"""{LINES_SQL}, pitched AS (SELECT page, line_idx, text, med_h, len(string_split(text, ' ')) AS n, CASE WHEN line_idx = 0 THEN 0 ELSE 60 END AS pitch,
  lag(len(string_split(text, ' '))) OVER w AS n0, lag(med_h) OVER w AS h0 FROM featured WINDOW w AS (PARTITION BY page ORDER BY line_idx)),
least AS (SELECT page, median(pitch) FILTER (n >= 8 AND n0 >= 8 AND med_h >= 35 AND h0 >= 35) * 0.85 AS least, count(*) AS every FROM pitched GROUP BY page),
ends AS (SELECT page, CAST(coalesce(max(line_idx) FILTER (n >= 5 AND med_h >= 35 AND pitch >= least) + 1, any_value(every)) AS INT) AS body_end FROM pitched JOIN least USING (page) GROUP BY page),
numbers AS (SELECT page, list(CAST(regexp_extract(text, '^(\\d{{1,2}}) ', 1) AS INT) ORDER BY line_idx) AS l FROM pitched JOIN ends USING (page) WHERE line_idx >= body_end AND regexp_matches(text, '^(\\d{{1,2}}) ') GROUP BY page),
blocks AS (SELECT page, body_end, CAST(coalesce(list_reduce(list_concat([0], l), lambda a, x: CASE WHEN a % 2 = 1 THEN a WHEN x > a // 2 + 2 THEN a + 1 WHEN x > a // 2 THEN x * 2 ELSE a END) // 2, 0) AS INT) AS entries FROM ends LEFT JOIN numbers USING (page))"""


@query("lineitem", sql=f"WITH {BLOCKS} SELECT page, body_end, entries FROM blocks")
def footnote_blocks(items):
    return layout.footnote_blocks(layout.features(lines_of(items)))


PROSE = """tall AS (SELECT page, region, count(*) AS n FROM featured WHERE med_h >= 35 GROUP BY page, region),
prose AS (SELECT page, region FROM (SELECT *, max(n) OVER (PARTITION BY page) AS most FROM tall) WHERE n >= 3 OR most < 3)"""


@query("lineitem", sql=f"WITH {LINES_SQL}, {PROSE} SELECT page, region FROM prose")
def prose_regions(items):
    return layout.prose_regions(layout.features(lines_of(items)))


STRATA = f"""{BLOCKS}, {PROSE}, opened AS (SELECT f.*, body_end, regexp_extract(f.text, '^(\\d{{1,2}}) ', 1) AS entry, min(line_idx) OVER (PARTITION BY page, region) AS first_in,
  first_value(f.text) OVER (PARTITION BY page, region ORDER BY line_idx) AS opening FROM featured f JOIN blocks USING (page)),
feet AS (SELECT page, coalesce(least(min(line_idx) FILTER (line_idx > 0 AND line_idx < body_end AND entry = '1' AND med_h < 35), min(line_idx) FILTER (line_idx >= body_end AND (entry <> '' OR first_in >= body_end))), 1 << 30) AS foot FROM opened GROUP BY page),
strata AS (SELECT o.volume, o.page, o.line_idx, o.text, o.region, o.line_id, o.x0, o.x1, CASE WHEN line_idx = 0 THEN 'header' WHEN regexp_matches(opening, '^Abb\\.') THEN 'caption' WHEN line_idx >= foot THEN 'footnote' WHEN p.page IS NOT NULL THEN 'body' ELSE 'caption' END AS stratum
  FROM opened o JOIN feet USING (page) LEFT JOIN prose p ON p.page = o.page AND p.region = o.region)"""


def strata_of(items: DataFrame) -> DataFrame:
    return layout.strata(layout.features(lines_of(items)))


@query("lineitem", sql=f"WITH {STRATA} SELECT page, line_idx, stratum FROM strata")
def line_strata(items):
    return strata_of(items).select("page", "line_idx", "stratum")


RUNS = f"""{STRATA}, changed AS (SELECT *, CASE WHEN lag(stratum) OVER w IS DISTINCT FROM stratum OR lag(region) OVER w IS DISTINCT FROM region THEN 1 ELSE 0 END AS new FROM strata WHERE trim(text) <> '' WINDOW w AS (PARTITION BY page ORDER BY line_idx)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page ORDER BY line_idx) - 1 AS BIGINT) AS para_idx FROM changed),
paras AS (SELECT volume, page, para_idx, stratum, region, list(text ORDER BY line_idx) AS lines, list(line_id ORDER BY line_idx) AS line_ids, bool_and(regexp_matches(text, '\\p{{L}}.*\\p{{L}}') AND upper(text) = text AND abs((x0 + x1) / 2 - 1275) <= 76.5) AS centred FROM numbered GROUP BY ALL)"""


@query("lineitem", sql=f"WITH {RUNS} SELECT page, para_idx, stratum, array_to_string(line_ids, ',') AS line_ids FROM paras")
def paragraph_runs(items):
    return layout.paragraphs(strata_of(items)).select("page", "para_idx", "stratum", F.array_join("line_ids", ",").alias("line_ids"))


@query("lineitem", sql=f"WITH {RUNS} SELECT volume, stratum, CAST(count(*) AS BIGINT) AS n FROM paras GROUP BY ALL")
def stratum_counts(items):
    return layout.stratum_counts(layout.paragraphs(strata_of(items)))


@query("lineitem", sql=f"WITH {RUNS} SELECT page, para_idx, CASE WHEN stratum IN ('body', 'caption') AND centred THEN 'title' WHEN stratum IN ('body', 'caption') AND regexp_matches(lines[1], '^\\d{{1,3}} - Kunstdenkmäler\\b') THEN 'signature' ELSE stratum END AS stratum FROM paras")
def titled_paragraphs(items):
    return layout.titled(layout.paragraphs(strata_of(items))).select("page", "para_idx", "stratum")


@query("lineitem", sql=f"WITH {RUNS} SELECT page, coalesce(max(regexp_extract(array_to_string(lines, ' '), '\\b(\\d{{2,4}})\\b', 1)) FILTER (stratum = 'header' AND regexp_matches(array_to_string(lines, ' '), '\\b(\\d{{2,4}})\\b')), CAST(page AS VARCHAR)) AS folio FROM paras GROUP BY page")
def page_folios(items):
    paras = layout.paragraphs(strata_of(items)).withColumn("text", F.array_join("lines", " "))
    return layout.folios(paras)


@query("lineitem", sql=f"WITH {LINES_SQL} SELECT page, line_idx, CAST(greatest(0, x0 - 12) AS INT) AS bx0, CAST(greatest(0, y0 - 12) AS INT) AS by0, CAST(least(2550, x1 + 12) AS INT) AS bx1, CAST(y1 + 12 AS INT) AS by1 FROM featured WHERE text LIKE '%ALTAR%'")
def line_lookup(items):
    return layout.found_lines(layout.features(lines_of(items)), pattern="ALTAR").select("page", "line_idx", *[F.col(f"box.{c}").alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])


PARAS = f"""paras AS (SELECT lang AS volume, doc_id AS page, i - 1 AS para_idx, CASE i % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'footnote' ELSE 'body' END AS stratum, l[i] AS text
  FROM (SELECT lang, doc_id, string_split({TEXT}, chr(10)) AS l, unnest(range(1, len(string_split({TEXT}, chr(10))) + 1)) AS i FROM documents) WHERE trim(l[i]) <> ''),
opened AS (SELECT *, regexp_replace(text, '[»«"''’‘“”)\\]⁰¹²³⁴⁵⁶⁷⁸⁹\\s]+$', '') AS bare FROM paras), marked AS (SELECT *, bare <> '' AND NOT regexp_matches(bare, '[.!?:;]$') AS open FROM opened)"""


def paras_of(docs: DataFrame) -> DataFrame:
    """Lines of documents as paragraphs: a language is a volume, a document is a page."""
    rows = docs.select(F.col("lang").alias("volume"), F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("para_idx", "text")).filter("trim(text) <> ''")
    i = (F.col("para_idx") + 1) % 5
    return rows.withColumn("stratum", F.when(i == 0, "title").when(i == 1, "footnote").otherwise("body"))


@query("documents", sql=f"""
WITH {PARAS}, s AS (SELECT *, CASE WHEN coalesce(lag(open AND stratum = 'body') OVER (PARTITION BY volume ORDER BY page, para_idx), false) THEN 0 ELSE 1 END AS new FROM marked WHERE stratum IN ('body', 'title')),
u AS (SELECT *, sum(new) OVER (PARTITION BY volume ORDER BY page, para_idx) AS unit FROM s WHERE stratum = 'body')
SELECT volume, CAST(unit AS BIGINT) AS unit, min(page) AS page, md5(string_agg(text, ' ' ORDER BY page, para_idx)) AS text_md5 FROM u GROUP BY volume, unit""")  # fmt: skip
def body_units(docs):
    return layout.joined_body(paras_of(docs)).select("volume", "unit", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("documents", sql=f"""
WITH {PARAS}, n AS (SELECT volume, page, para_idx, CASE WHEN para_idx % 2 = 0 THEN (para_idx % 90 + 1) || ' ' || text ELSE text END AS text, open FROM marked WHERE stratum = 'footnote'),
s AS (SELECT *, CASE WHEN regexp_matches(text, '^(\\d{{1,2}}) ') AND NOT coalesce(lag(open) OVER w, false) THEN 1 ELSE 0 END AS new FROM n WINDOW w AS (PARTITION BY volume ORDER BY page, para_idx)),
u AS (SELECT *, sum(new) OVER (PARTITION BY volume ORDER BY page, para_idx) AS unit FROM s)
SELECT volume, CAST(unit AS BIGINT) AS unit, min(page) AS page, md5(string_agg(text, ' ' ORDER BY page, para_idx)) AS text_md5 FROM u GROUP BY volume, unit""")  # fmt: skip
def note_units(docs):
    rows = paras_of(docs).withColumn("text", F.when(F.col("para_idx") % 2 == 0, F.concat((F.col("para_idx") % 90 + 1).cast("string"), F.lit(" "), "text")).otherwise(F.col("text")))
    return layout.joined_notes(rows).select("volume", "unit", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("documents", sql=f"WITH {PARAS} SELECT page, CAST(para_idx AS INT) AS para_idx, open FROM marked")
def open_sentences(docs):
    return paras_of(docs).select("page", "para_idx", T.open_sentence(F.col("text")).alias("open"))


@query("documents", sql=f"""
WITH {PARAS}, own AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY para_idx) - 1 AS line_no FROM paras), proof AS (SELECT page, line_no, 'read: ' || text AS text FROM own WHERE page % 3 <> 0 OR line_no > 0),
size AS (SELECT page, n, coalesce(m, 0) AS m FROM (SELECT page, count(*) AS n FROM own GROUP BY page) LEFT JOIN (SELECT page, count(*) AS m FROM proof GROUP BY page) USING (page))
SELECT o.page, CAST(o.para_idx AS INT) AS para_idx, CASE WHEN n <> m THEN n || ' paragraphs, ' || m || ' lines' END AS error, md5(CASE WHEN n = m THEN p.text ELSE o.text END) AS text_md5 FROM own o JOIN size USING (page) LEFT JOIN proof p ON p.page = o.page AND p.line_no = o.line_no""")  # fmt: skip
def reflow_align(docs):
    own = paras_of(docs)
    no = F.row_number().over(Window.partitionBy("page").orderBy("para_idx")) - 1
    proof = own.withColumn("line_no", no).filter("page % 3 <> 0 OR line_no > 0").select("page", "line_no", F.concat(F.lit("read: "), "text").alias("text"))
    out = layout.aligned_lines(own.select("page", "para_idx", "text"), proof)
    return out.select("page", "para_idx", "error", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("events", sql="""
WITH c AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN '(' WHEN 1 THEN ')' ELSE 'x' END AS ch FROM events), s AS (SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM c),
d AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s)
SELECT user_id AS page, event_id AS pos FROM d WHERE ch = ')' AND s + 1 > low""")  # fmt: skip
def bracket_closers(events):
    ch = F.when(F.col("event_id") % 3 == 0, "(").when(F.col("event_id") % 3 == 1, ")").otherwise("x")
    return layout.real_closers(events.select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), ch.alias("ch")), "(", ")")


KINDS = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in (("click", "noise"), ("view", "rule"), ("purchase", "name"), ("signup", "hyphen"))) + " ELSE 'caps' END"


@query("events", sql=f"SELECT user_id AS page, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, {KINDS} AS kind FROM events) GROUP BY GROUPING SETS ((user_id, kind), (kind))")
def correction_report(events):
    return layout.report(events.select(F.col("user_id").alias("page"), F.expr(KINDS).alias("kind")))


STRIPPED = R.HYPHEN_STRIP.replace("'", "''")


@query("documents", sql=f"""
SELECT doc_id, md5(array_to_string(list_transform(string_split({TEXT}, ' '), lambda t: CASE trim(t, '{STRIPPED}') WHEN 'the' THEN regexp_replace(t, 'the', 'THE') WHEN 'und' THEN regexp_replace(t, 'und', 'UND') WHEN 'de' THEN regexp_replace(t, 'de', 'DE') ELSE t END), ' ')) AS text_md5 FROM documents""")  # fmt: skip
def gazetteer_names(docs):
    return docs.select("doc_id", F.md5(T.gazetteer(F.coalesce("text", F.lit("")), {"the": "THE", "und": "UND", "de": "DE"}).cast("binary")).alias("text_md5"))


@query("documents", sql=f"SELECT doc_id, trim(regexp_replace(left({TEXT}, 200), '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS name FROM documents")
def sanitized_names(docs):
    return docs.select("doc_id", T.sanitized(F.left(F.coalesce("text", F.lit("")), F.lit(200))).alias("name"))


@query("documents", sql=f"SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '…' ELSE t END AS cell FROM (SELECT doc_id, replace(replace({TEXT}, '|', '\\|'), chr(10), ' ') AS t FROM documents)")
def evidence_cells(docs):
    return docs.select("doc_id", T.evidence_trimmed(F.coalesce("text", F.lit(""))).alias("cell"))


@query("documents", sql="SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'it' THEN 'ita' ELSE 'deu+eng' END AS code FROM documents")
def language_codes(docs):
    name = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").when(F.col("lang") == "fr", "French").when(F.col("lang") == "it", "Italian").otherwise("other")
    return docs.select("doc_id", T.language_code(name).alias("code"))


@query("part", sql="SELECT p_partkey, p_partkey || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_brand || ')' ELSE '' END AS label FROM part")
def property_labels(part):
    return part.select("p_partkey", T.property_label(F.col("p_partkey").cast("string"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("label"))


@query("documents", sql=f"SELECT doc_id, CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\\s*(\\d{{1,3}}[\\.]\\)\\s|\\[\\d{{1,3}}\\]\\s|[¹²³⁴⁵⁶⁷⁸⁹⁰]\\s|\\*+\\s)'))) AS INT) AS n FROM (SELECT doc_id, replace({TEXT}, chr(10) || 'a', chr(10) || '[3] a') AS t FROM documents)")
def footnote_count(docs):
    return docs.select("doc_id", T.footnote_lines(F.replace(F.coalesce("text", F.lit("")), F.lit("\na"), F.lit("\n[3] a"))).alias("n"))


@query("events", sql="""
SELECT event_id, CASE WHEN starts_with(t, '```') THEN trim(regexp_replace(string_split(t, '```')[2], '^json', ''), ' ' || chr(9) || chr(13) || chr(10)) ELSE t END AS answer FROM (
  SELECT event_id, trim(CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '``` and more' WHEN 1 THEN ' ```' || props || '```' ELSE '  ' || props END, ' ' || chr(9) || chr(13) || chr(10)) AS t FROM events WHERE props IS NOT NULL)""")  # fmt: skip
def fenceless_answers(events):
    k, p = F.col("event_id") % 3, F.col("props")
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n``` and more"))).when(k == 1, F.concat(F.lit(" ```"), p, F.lit("```"))).otherwise(F.concat(F.lit("  "), p))
    return events.filter("props is not null").select("event_id", json_repair.fenceless(raw).alias("answer"))


@query("events", sql="SELECT event_id, md5(props) AS props_md5 FROM events WHERE props LIKE '{%}'")
def repaired_answers(events):
    """Objects that lost their last bracket come back whole."""
    cut = F.left("props", F.length("props") - 1)
    return events.filter("props like '{%}'").select("event_id", F.md5(json_repair.repair_json(cut).cast("binary")).alias("props_md5"))


ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("documents", sql=f"""
SELECT doc_id, md5({ESC.format("left(t, 4)")} || '<mark title="A">' || {ESC.format("substring(t, 5, 6)")} || '</mark>' || {ESC.format("substring(t, 11, 10)")} || '<mark title="B">' || {ESC.format("substring(t, 21, 5)")} || '</mark>' || {ESC.format("substring(t, 26)")}) AS html_md5
FROM (SELECT doc_id, text AS t FROM documents WHERE length(text) > 30)""")  # fmt: skip
def highlighted_texts(docs):
    span = lambda a, b, n: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("label"))
    html = T.highlighted(F.col("text"), F.array(span(20, 25, "B"), span(4, 10, "A")))
    return docs.filter("length(text) > 30").select("doc_id", F.md5(html.cast("binary")).alias("html_md5"))


GROUPED = "SELECT user_id, day, list(event_type ORDER BY value DESC, event_type) AS labels, list(value ORDER BY value DESC, event_type) AS v FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value FROM events) GROUP BY user_id, day"


def grouped(events: DataFrame) -> DataFrame:
    return mentions.groups(events.select("user_id", F.to_date("ts").alias("day"), "event_type", "value"), ["user_id", "day"], label="event_type", score="value")


@query("events", sql=f"SELECT user_id, day, round(v[1] - v[2], 6) AS gap FROM ({GROUPED}) WHERE len(labels) > 1 ORDER BY v[1] - v[2], user_id, day LIMIT 20")
def ambiguous_groups(events):
    return mentions.ambiguous(grouped(events), ["user_id", "day"]).select("user_id", "day", F.round("gap", 6).alias("gap"))


@query("events", sql=f"SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(min(v[1]), 6) AS least, round(max(v[1]), 6) AS most FROM ({GROUPED}) GROUP BY user_id HAVING count(*) > 1")
def repeat_scores(events):
    out = mentions.repeat_scores(grouped(events), "user_id")
    return out.select("user_id", F.size("scores").cast("long").alias("n"), F.round(F.get("scores", F.lit(0)), 6).alias("least"), F.round(F.element_at("scores", -1), 6).alias("most"))


@query("events", sql=f"SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT {TAG} AS tag FROM events) GROUP BY tag")
def tag_counts(events):
    return mentions.counts(events.select(F.expr(TAG).alias("tag")), "tag")


@query("events", sql="SELECT event_type AS label, CAST(event_id AS VARCHAR) AS text, value AS score FROM events ORDER BY value DESC, event_type, CAST(event_id AS VARCHAR) LIMIT 50")
def highest_scores(events):
    rows = events.select(F.col("event_type").alias("label"), F.col("event_id").cast("string").alias("text"), F.col("value").alias("score"))
    return mentions.by_score(rows, ascending=False, most=50)


@query("events", sql="SELECT event_type AS label, CAST(event_id AS VARCHAR) AS text, value AS score FROM events ORDER BY value, event_type, CAST(event_id AS VARCHAR) LIMIT 10")
def lowest_scores(events):
    rows = events.select(F.col("event_type").alias("label"), F.col("event_id").cast("string").alias("text"), F.col("value").alias("score"))
    return mentions.by_score(rows, most=10)


SPANS = "SELECT l_orderkey, l_linenumber AS n, CAST(l_partkey % 40 AS INT) AS start, CAST(l_partkey % 40 + 1 + l_suppkey % 25 AS INT) AS stop FROM lineitem"


@query("lineitem", sql=f"""
SELECT DISTINCT a.l_orderkey, a.n, a.start, a.stop FROM ({SPANS}) a WHERE NOT EXISTS (SELECT 1 FROM ({SPANS}) b WHERE b.l_orderkey = a.l_orderkey AND b.stop >= a.stop
  AND (b.start < a.start OR (b.start = a.start AND (b.stop > a.stop OR (b.stop = a.stop AND b.n < a.n)))))""")  # fmt: skip
def flat_spans(items):
    rows = items.select("l_orderkey", F.col("l_linenumber").alias("label"), F.expr("int(l_partkey % 40)").alias("start"), F.expr("int(l_partkey % 40 + 1 + l_suppkey % 25)").alias("end"))
    return mentions.outermost(rows, ["l_orderkey"]).select("l_orderkey", F.col("label").alias("n"), "start", F.col("end").alias("stop"))


LENIENT = " UNION ALL ".join(f"""SELECT '{side}' AS side, user_id, min(event_id) AS a, max(event_id) AS b, any_value(tag[3:]) AS type FROM (
  SELECT *, sum(CASE WHEN tag <> 'O' AND (tag[1] = 'B' OR before = 'O' OR before[3:] <> tag[3:]) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
    SELECT user_id, event_id, {side} AS tag, lag({side}, 1, 'O') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM n)) WHERE tag <> 'O' GROUP BY user_id, run""" for side in ("gold", "pred"))


@query("events", sql=f"""
WITH n AS (SELECT user_id, event_id, {TAG} AS gold, CASE WHEN event_id % 11 = 0 THEN 'O' ELSE {TAG} END AS pred FROM events), s AS ({LENIENT}),
j AS (SELECT coalesce(g.type, p.type) AS type, g.a AS x, p.a AS y FROM (SELECT * FROM s WHERE side = 'gold') g FULL JOIN (SELECT * FROM s WHERE side = 'pred') p ON g.user_id = p.user_id AND g.a = p.a AND g.b = p.b AND g.type = p.type)
SELECT type, CAST(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS fn FROM j GROUP BY type""")  # fmt: skip
def tag_scores_lenient(events):
    gold = F.expr(TAG)
    tokens = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), gold.alias("gold"), F.when(F.col("event_id") % 11 == 0, "O").otherwise(gold).alias("pred"), F.lit(False).alias("ignored"))
    return scoring.span_scores(tokens).select("type", "tp", "fp", "fn")


@query("orders", "customer", sql=f"""
WITH r AS ({REL}), s AS (SELECT doc_id, n % 2 AS page, lower(name) AS k, min(n) AS span FROM (SELECT doc_id, n, subject AS name FROM r WHERE n % 3 > 0 UNION ALL SELECT doc_id, n, object FROM r WHERE n % 5 > 0) GROUP BY ALL)
SELECT r.doc_id, r.n, a.span AS from_span, b.span AS to_span, a.span IS NOT NULL AND b.span IS NOT NULL AS found FROM r
LEFT JOIN s a ON a.doc_id = r.doc_id AND a.page = r.n % 2 AND a.k = lower(r.subject) LEFT JOIN s b ON b.doc_id = r.doc_id AND b.page = r.n % 2 AND b.k = lower(r.object)""")  # fmt: skip
def relation_spans(orders, customers):
    rel = sales(orders, customers).withColumn("page", F.col("n") % 2)
    ends = [rel.filter(F.col("n") % m > 0).select("doc_id", "page", F.col(c).alias("name"), F.col("n").alias("ordinal"), F.col("n").alias("span_id")) for c, m in (("subject", 3), ("object", 5))]
    return relations.relation_spans(rel, ends[0].unionByName(ends[1])).select("doc_id", "n", "from_span", "to_span", "found")


@query("orders", "customer", sql=f"SELECT n, '| ' || subject || ' | ' || relation_type || ' | ' || object || ' | ' || evidence || ' |' AS value FROM ({REL}) UNION ALL SELECT -2, '| subject | relation | object | evidence |' UNION ALL SELECT -1, '|-|-|-|-|'")
def relation_table(orders, customers):
    return sinks.relation_rows(sales(orders, customers))


@query("orders", "customer", sql=f"SELECT subject AS source, object AS target, relation_type AS label, evidence FROM ({REL})")
def graph_edges(orders, customers):
    return relations.edges(sales(orders, customers))


FOUND = "SELECT l_orderkey AS doc_id, CASE WHEN l_suppkey % 2 = 0 THEN 'persons' ELSE 'places' END AS category, l_linenumber AS pos, 'Name ' || (l_partkey % 5) AS name FROM lineitem"
MERGED = f"SELECT doc_id, category, list(name ORDER BY pos, name) AS names FROM (SELECT doc_id, category, name, min(pos) AS pos FROM ({FOUND}) GROUP BY ALL) GROUP BY doc_id, category"


def merged(items: DataFrame) -> DataFrame:
    found = items.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_suppkey") % 2 == 0, "persons").otherwise("places").alias("category"), F.lit(0).alias("chunk"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("Name "), F.col("l_partkey") % 5).alias("name"))
    return relations.merged_entities(found)


@query("lineitem", sql=f"SELECT doc_id, category, array_to_string(names[1:2], ', ') || CASE WHEN len(names) > 2 THEN ' … and ' || (len(names) - 2) || ' more' ELSE '' END AS shown FROM ({MERGED})")
def entity_preview(items):
    return sinks.entity_preview(merged(items), most=2)


@query("lineitem", "orders", sql=f"""
SELECT doc_id, CAST(coalesce(entities, 0) AS BIGINT) AS entities, persons, CAST(coalesce(valid, 0) AS BIGINT) AS valid, CAST(coalesce(flagged, 0) AS BIGINT) AS flagged
FROM (SELECT doc_id, sum(len(names)) AS entities, CAST(sum(len(names)) FILTER (category = 'persons') AS INT) AS persons FROM ({MERGED}) GROUP BY doc_id)
FULL JOIN (SELECT o_orderkey AS doc_id, count(*) FILTER (o_orderstatus = 'F') AS valid, count(*) FILTER (o_orderstatus <> 'F') AS flagged FROM orders GROUP BY 1) USING (doc_id)""")  # fmt: skip
def document_statistics(items, orders):
    rel = orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "F").alias("valid"))
    return sinks.statistics(merged(items), rel).select("doc_id", "entities", F.element_at("by_category", "persons").alias("persons"), "valid", "flagged")


@query("documents", sql="""
WITH c AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS category), d AS (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '\\p{Lu}\\p{Ll}+')),
g AS (SELECT DISTINCT doc_id, lang AS category, replace(lower(unnest(regexp_extract_all(coalesce(text, ''), '\\p{Lu}\\p{Ll}+'))), 'ß', 'ss') AS k FROM documents),
s AS (SELECT d.doc_id, c.category, count(k) FILTER (length(k) % 3 <> 0) AS tp, count(k) FILTER (length(k) % 3 = 0) AS fn FROM d CROSS JOIN c LEFT JOIN g ON g.doc_id = d.doc_id AND g.category = c.category GROUP BY ALL)
SELECT doc_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fn), 0), 0), 5) AS micro_f1, round(sum(coalesce(2 * tp / nullif(2 * tp + fn, 0), 0)) / 4, 5) AS macro_f1 FROM s GROUP BY doc_id""")  # fmt: skip
def macro_micro(docs):
    gold = docs.select("doc_id", F.col("lang").alias("category"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{Lu}\p{Ll}+)"), 1)).alias("name"))
    pred = gold.filter(F.length(T.norm_strict(F.col("name"))) % 3 != 0)
    out = scoring.totals(scoring.entity_scores(gold, pred, categories=["en", "fr", "de", "es"]), ["doc_id"])
    return out.select("doc_id", "tp", "fn", F.round("f1", 5).alias("micro_f1"), F.round("macro_f1", 5).alias("macro_f1"))


@query("documents", "conversations", sql=f"""
WITH s AS ({SENTENCES}), w AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), g AS (SELECT doc_id, count(*) AS sentences, sum(len(string_split(s, ' '))) AS tokens FROM s GROUP BY doc_id)
SELECT CAST(w.doc_id AS VARCHAR) AS path, sentences IS NOT NULL AS found, CAST(coalesce(sentences, 0) AS BIGINT) AS sentences, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM w LEFT JOIN g USING (doc_id)""")  # fmt: skip
def corpus_manifest(docs, turns):
    s = segment.sentences(docs).select(F.col("doc_id").cast("string").alias("path"), F.split("sentence", " ", -1).alias("tokens"))
    return sinks.manifest(turns.select(F.col("conv_id").cast("string").alias("path")).distinct(), s).select("path", "found", "sentences", "tokens")


@query("conversations", sql="SELECT conv_id AS batch, md5(string_agg('=== ' || turn || ' ===' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def batch_texts(turns):
    rows = turns.select(F.col("conv_id").alias("batch"), F.col("turn").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return sinks.batch_text(rows, "text").select("batch", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("events", "conversations", sql="SELECT event_id, md5(coalesce(text, '')) AS text_md5 FROM events LEFT JOIN conversations ON conv_id = user_id AND turn = event_id % 9")
def event_page_texts(events, turns):
    rows = events.select("event_id", F.col("user_id").alias("conv_id"), (F.col("event_id") % 9).cast("int").alias("turn"))
    out = segment.page_texts(rows, turns.select("conv_id", F.col("turn").cast("int").alias("turn"), "text"), on=["conv_id", "turn"])
    return out.select("event_id", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


@query("documents", sql=f"SELECT doc_id, CAST(i - 1 AS INT) AS n, m[i] AS preview FROM (SELECT doc_id, m, unnest(range(1, least(len(m), 20) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(replace({TEXT}, chr(10), ' '), '.{{0,40}}(?:[12][0-9]{{3}}).{{0,40}}') AS m FROM documents))")
def year_previews(docs):
    return segment.regex_preview(docs.withColumn("text", F.coalesce("text", F.lit(""))), "[12][0-9]{3}", never="[^0-9]")


@query("part", sql="SELECT term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS term FROM part) WHERE length(term) >= 4 AND term NOT IN ('aber', 'part') GROUP BY term")
def terms_without_stopwords(part):
    terms = part.select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]+)"), 1)).alias("term"))
    return stats.without_stopwords(terms, ["aber", "part"], least=4).groupBy("term").agg(F.count("*").alias("n"))


WORDLIST = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(left(coalesce(text, ''), 60)), '[a-z]{5,8}')) AS word FROM documents WHERE lang = 'en') GROUP BY word"


@query("documents", sql=f"""
WITH l AS ({WORDLIST}), t AS (SELECT DISTINCT left(word, 2) || 'q' || substring(word, 4) AS term FROM l),
d AS (SELECT term, word, row_number() OVER (PARTITION BY term ORDER BY levenshtein(term, word), n DESC, word) AS r FROM t, l WHERE abs(length(term) - length(word)) <= 2 AND levenshtein(term, word) <= 2)
SELECT t.term, word AS corrected FROM t LEFT JOIN d ON d.term = t.term AND r = 1""")  # fmt: skip
def spelled_terms(docs):
    words = docs.filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower(F.left(F.coalesce("text", F.lit("")), F.lit(60))), F.lit("([a-z]{5,8})"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    terms = words.select(F.concat(F.left("word", F.lit(2)), F.lit("q"), F.substring("word", 4, 100)).alias("term"))
    return stats.spelled(terms, words)


@query("events", sql=f"""
WITH t AS (SELECT user_id, event_id, {TAG} AS tag, value FROM events), r AS (SELECT *, sum(CASE WHEN tag[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM t),
b AS (SELECT *, first_value(tag[3:]) OVER (PARTITION BY user_id, run ORDER BY event_id) AS type FROM r WHERE run > 0),
c AS (SELECT *, max(CASE WHEN tag = 'O' OR (tag[1] = 'I' AND tag[3:] <> type) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS broken FROM b)
SELECT user_id AS sentence_id, type AS label, CAST(min(event_id) * 2 AS BIGINT) AS start, CAST(max(event_id) * 2 + 1 AS BIGINT) AS stop, round_even(avg(value), 4) AS score FROM c WHERE broken = 0 GROUP BY user_id, run, type""")  # fmt: skip
def tag_mentions(events):
    tokens = events.select(F.col("user_id").alias("sentence_id"), F.col("event_id").alias("n"), (F.col("event_id") * 2).alias("start"), (F.col("event_id") * 2 + 1).alias("end"), F.expr(TAG).alias("tag"), F.col("value").alias("prob"), F.lit("").alias("sentence"))
    tokens = tokens.withColumn("start", F.col("start").cast("int")).withColumn("end", F.col("end").cast("int"))
    return mentions.tags_to_mentions(tokens).select("sentence_id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "score")

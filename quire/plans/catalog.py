"""The registered queries over the parquet tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions import text as T
from quire.operators import layout, mentions, relations, scoring, segment, stats
from quire.plans import documents as D
from quire.session import ship, table
from quire.sources import readers, sinks
from quire.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*names: str, sql: str | None = None):
    """Register a function of one DataFrame for each table that is named."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(*[table(spark, sf_dir, n) for n in names])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TEXT = "coalesce(text, '')"


@query("documents", sql=f"""
SELECT lang, label, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT lang, unnest(list_concat(
    list_transform(regexp_extract_all(s, '{mentions.RULES[0][1]}'), lambda x: 'MAIL'), list_transform(regexp_extract_all(s, '{mentions.RULES[1][1]}'), lambda x: 'YEAR'),
    list_transform(regexp_extract_all(s, '{mentions.RULES[2][1]}'), lambda x: 'NAME'), list_transform(regexp_extract_all(s, '{mentions.RULES[3][1]}'), lambda x: 'CAPS'))) AS label
  FROM (SELECT lang, unnest(string_split(regexp_replace(t, '([.!?]) +([\\p{{Lu}}«„"])', '\\1' || chr(10) || '\\2', 'g'), chr(10))) AS s
        FROM (SELECT lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          {TEXT}, '([\\p{{L}}\\p{{N}}_»)])\\*', '\\1', 'g'), '\\s?[!?*]+([.,])', '\\1', 'g'), '([a-zäöüß])\\?(\\s[a-zäöüß])', '\\1\\2', 'g'), '([a-zäöüß])\\?(\\s[a-zäöüß])', '\\1\\2', 'g'),
          '[¹²³⁴⁵⁶⁷⁸⁹⁰]+', '', 'g'), '([\\p{{L}}\\p{{N}}_])[‘''`°]([.,])', '\\1\\2', 'g'), '[ \\t]{{2,}}', ' ', 'g') AS t FROM documents))
) GROUP BY ALL""")  # fmt: skip
def mention_counts(docs):
    return D.mention_counts(docs)


def noisy(docs: DataFrame) -> DataFrame:
    """Documents with footnote residue put in, as SQL does."""
    t = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("and "), F.lit("and* ")), F.lit("on."), F.lit("on?!.")), F.lit("the "), F.lit("the¹ "))
    return docs.withColumn("text", F.replace(t, F.lit("er,"), F.lit("er°,")))


NOISY = f"replace(replace(replace(replace({TEXT}, 'and ', 'and* '), 'on.', 'on?!.'), 'the ', 'the¹ '), 'er,', 'er°,')"


@query("documents", sql=f"""
SELECT doc_id, md5(t) AS clean_md5, CAST(length(raw) - length(t) AS BIGINT) AS removed FROM (
  SELECT doc_id, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          raw, '([\\p{{L}}\\p{{N}}_»)])\\*', '\\1', 'g'), '\\s?[!?*]+([.,])', '\\1', 'g'), '([a-zäöüß])\\?(\\s[a-zäöüß])', '\\1\\2', 'g'), '([a-zäöüß])\\?(\\s[a-zäöüß])', '\\1\\2', 'g'),
          '[¹²³⁴⁵⁶⁷⁸⁹⁰]+', '', 'g'), '([\\p{{L}}\\p{{N}}_])[‘''`°]([.,])', '\\1\\2', 'g'), '[ \\t]{{2,}}', ' ', 'g') AS t FROM (SELECT doc_id, {NOISY} AS raw FROM documents))""")  # fmt: skip
def footnote_clean(docs):
    rows = noisy(docs)
    clean = T.footnote_clean(F.col("text"))
    return rows.select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), (F.length("text") - F.length(clean)).cast("long").alias("removed"))


@query("documents", sql=f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace({TEXT}, '[^a-zäöüßA-ZÄÖÜ\\n\\t\\r\\f]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS letters_md5 FROM documents")
def letters_only(docs):
    return docs.select("doc_id", F.md5(T.letters_only(F.coalesce("text", F.lit(""))).cast("binary")).alias("letters_md5"))


STRICT = "replace(lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"
RELAXED = "trim(regexp_replace(trim(" + STRICT + ", '\"''„“”»« '), '^(?:" + "|".join(R.LEADING) + ")(?: |$)', ''))"


@query("documents", sql=f"SELECT doc_id, md5({STRICT.format('text')}) AS strict_md5, md5({RELAXED.format('text')}) AS relaxed_md5 FROM documents")
def norm_names(docs):
    return docs.select("doc_id", F.md5(T.norm_strict(F.col("text")).cast("binary")).alias("strict_md5"), F.md5(T.norm_relaxed(F.col("text")).cast("binary")).alias("relaxed_md5"))


def capped_sql(source: str) -> str:
    """(doc_id, t) of ``source`` with capitals put right."""
    letters, capitals = "regexp_replace({}, '\\P{{L}}', '', 'g')", "regexp_replace({}, '\\P{{Lu}}', '', 'g')"
    a, u = f"length({letters.format('w[i]')})", f"length({capitals.format('w[i]')})"
    later = f"length({capitals.format('substring(' + letters.format('w[i]') + ', 2)')})"
    first = "CASE WHEN left(w[i], 1) = 'ß' THEN 'SS' ELSE upper(left(w[i], 1)) END"
    word = f"CASE WHEN length(w[i]) >= 2 AND ({u} = {a} OR ({a} >= 3 AND {u} / {a} >= 0.6) OR {later} >= 2) THEN {first} || lower(substring(w[i], 2)) ELSE w[i] END"
    return f"""SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce({word}, '')), '') AS t
FROM (SELECT doc_id, regexp_split_to_array(t, '[A-Za-zÀ-ɏ]+') AS gaps, regexp_extract_all(t, '[A-Za-zÀ-ɏ]+') AS w FROM (SELECT doc_id, replace(t, 'ı', 'i') AS t FROM ({source})))"""


@query("documents", sql=f"SELECT doc_id, md5(t) AS fixed_md5 FROM ({capped_sql(f"SELECT doc_id, replace(replace({TEXT}, 'on', 'ON'), 'ea', 'EıA') AS t FROM documents")})")
def small_caps_fix(docs):
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("on"), F.lit("ON")), F.lit("ea"), F.lit("EıA"))
    return docs.select("doc_id", F.md5(T.small_caps(t).cast("binary")).alias("fixed_md5"))


SENTENCES = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS sentence_id, s FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, trim(l[n]) AS s FROM (SELECT doc_id, string_split(regexp_replace({TEXT}, '([.!?]) +([\\p{{Lu}}«„\"])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS l FROM documents)) WHERE s <> ''"


@query("documents", sql=f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(max(length(s)) AS BIGINT) AS longest, CAST(sum(CASE WHEN length(s) < 25 THEN 1 ELSE 0 END) AS BIGINT) AS short FROM ({SENTENCES}) GROUP BY doc_id")
def sentence_counts(docs):
    s = segment.sentences(docs)
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"), F.count_if(F.length("sentence") < 25).alias("short"))


@query("documents", sql=f"SELECT doc_id, CAST(sentence_id AS INT) AS sentence_id, s AS sentence FROM ({SENTENCES}) WHERE length(s) < 25 ORDER BY doc_id, sentence_id LIMIT 15")
def short_sentences(docs):
    return segment.short_sentences(segment.sentences(docs))


@query("documents", sql="""
SELECT doc_id, CAST(start AS INT) AS start, CAST(length(c) AS INT) AS n, md5(c) AS chunk_md5 FROM (
  SELECT doc_id, start, substring(text, start + 1, 8000) AS c FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, length(text) - 501) + 1 AS BIGINT), 7500)) AS start FROM documents WHERE text IS NOT NULL))""")  # fmt: skip
def chunk_overlap(docs):
    return segment.chunks(docs).select("doc_id", "start", F.length("chunk").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("documents", sql=f"""
WITH RECURSIVE s AS (SELECT doc_id, CAST(sentence_id AS BIGINT) AS i, length(s) AS n FROM ({SENTENCES})),
c AS (SELECT doc_id, i, 0 AS chunk, n + 1 AS size FROM s WHERE i = 0
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN c.size + s.n > 800 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.size + s.n > 800 THEN s.n + 1 ELSE c.size + s.n + 1 END FROM c JOIN s ON s.doc_id = c.doc_id AND s.i = c.i + 1)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(max(size) - 1 AS INT) AS n FROM c GROUP BY doc_id, chunk""")  # fmt: skip
def chunk_greedy(docs):
    parts = T.chunk_greedy(T.split_sentences(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", F.posexplode(parts).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").alias("n"))


def paged(turns: DataFrame) -> DataFrame:
    """A conversation as one text with its turns as marked pages."""
    part = F.concat(F.lit("[[PAGE "), F.col("turn").cast("string"), F.lit("]] "), F.coalesce("text", F.lit("")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), " ").alias("text"))


@query("conversations", sql="SELECT conv_id, CAST(turn AS INT) AS page, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM conversations")
def page_split(turns):
    return segment.split_pages(paged(turns), key="conv_id").select("conv_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("conversations", sql="""
WITH parts AS (SELECT conv_id, turn, '[[PAGE ' || turn || ']] ' || coalesce(text, '') AS t FROM conversations),
placed AS (SELECT conv_id, turn, length(t) AS n, coalesce(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM parts),
whole AS (SELECT conv_id, sum(n + 1) - 1 AS total FROM placed GROUP BY conv_id),
starts AS (SELECT conv_id, unnest(range(0, CAST(greatest(0, total - 101) + 1 AS BIGINT), 300)) AS start FROM whole)
SELECT s.conv_id, CAST(s.start AS INT) AS start, CAST(coalesce(max(p.turn), 1) AS INT) AS page FROM starts s LEFT JOIN placed p ON p.conv_id = s.conv_id AND p.at <= s.start GROUP BY s.conv_id, s.start""")  # fmt: skip
def page_asof(turns):
    docs = paged(turns)
    starts = segment.chunks(docs, size=400, overlap=100, key="conv_id").select("conv_id", "start")
    return segment.page_asof(starts, segment.page_index(docs, key="conv_id"), key="conv_id")


@query("documents", sql=f"""
SELECT label, text, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'NAME' AS label, unnest(regexp_extract_all(s, '{mentions.RULES[2][1]}')) AS text FROM ({SENTENCES})) GROUP BY ALL ORDER BY n DESC, label, text LIMIT 15""")  # fmt: skip
def top_mentions(docs):
    return mentions.top_entities(mentions.rule_mentions(segment.sentences(docs), [mentions.RULES[2]]))


@query("documents", sql=f"""
SELECT doc_id, entity, CAST(len(p) - 1 AS BIGINT) AS n, CAST(length(p[1]) AS INT) AS first_start, CAST(length(text) - length(entity) - length(p[len(p)]) AS INT) AS last_start
FROM (SELECT doc_id, text, entity, string_split(text, entity) AS p FROM (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]+') AS entity FROM documents) WHERE entity <> '')""")  # fmt: skip
def span_find(docs):
    entities = docs.select("doc_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("entity"))
    return mentions.span_find(entities, docs.select("doc_id", "text"), on=["doc_id"]).groupBy("doc_id", "entity").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))


@query("pages", sql="SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading, CAST(length(html) AS INT) AS n FROM pages")
def html_headings(pages):
    return pages.select("page_id", F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("heading"), F.length("html").alias("n"))


@query("conversations", sql="SELECT role, CAST(count(*) AS BIGINT) AS turns, CAST(sum(len(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]) +([\\p{Lu}«„\"])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS BIGINT) AS sentences FROM conversations GROUP BY role")
def dialogue_sentences(turns):
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size(T.split_sentences(F.coalesce("text", F.lit(""))))).alias("sentences"))


TAG = "CASE event_type WHEN 'signup' THEN 'B-A' WHEN 'view' THEN 'I-A' WHEN 'purchase' THEN 'B-B' WHEN 'click' THEN 'I-B' ELSE 'O' END"


@query("events", sql=f"""
WITH t AS (SELECT user_id, event_id, {TAG} AS tag FROM events),
r AS (SELECT *, sum(CASE WHEN tag[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM t),
b AS (SELECT *, first_value(tag[3:]) OVER (PARTITION BY user_id, run ORDER BY event_id) AS type FROM r WHERE run > 0),
c AS (SELECT *, max(CASE WHEN tag = 'O' OR (tag[1] = 'I' AND tag[3:] <> type) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS broken FROM b)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, type, CAST(count(*) AS BIGINT) AS tokens FROM c WHERE broken = 0 GROUP BY user_id, run, type""")  # fmt: skip
def bio_islands(events):
    return mentions.bio_spans(events.select("user_id", "event_id", F.expr(TAG).alias("tag")), key="user_id", order="event_id")


@query("events", sql="SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour FROM events")
def requests_last_hour(events):
    return limiter.requests_last_hour(events).select("event_id", "user_id", "last_hour")


@query("events", sql="""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
f AS (SELECT user_id, event_id, ts, i, true AS allowed, [t] AS recent FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, ts, i, len(r) < 10, CASE WHEN len(r) < 10 THEN list_append(r, t) ELSE r END FROM (
    SELECT e.user_id, e.event_id, e.ts, e.i, e.t, list_filter(f.recent, lambda x: e.t - x < 3600000000) AS r FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, event_id, ts, allowed FROM f""")  # fmt: skip
def rate_limit(events):
    return limiter.limited(events)


@query("lineitem", sql="""
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges FROM (
  SELECT l_orderkey, min(n) AS a, max(n) AS b FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)) GROUP BY l_orderkey, g) GROUP BY l_orderkey""")  # fmt: skip
def page_ranges(items):
    return segment.page_ranges(items, ["l_orderkey"], "l_linenumber")


@query("events", sql="""
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, event_id % 7 = 0 AS pinned FROM events),
p AS (SELECT user_id, i, n, n + 2 AS total, CASE WHEN pinned THEN i + 2 END AS pin FROM c),
b AS (SELECT *, i + greatest(1, coalesce(max(pin - i) OVER (PARTITION BY user_id ORDER BY i), 1)) AS lo,
  i + least(total - n + 1, min(coalesce(pin, total) - i) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS hi FROM p)
SELECT user_id, CAST(count(*) AS BIGINT) AS candidates, CAST(sum(CASE WHEN lo = hi THEN 1 ELSE 0 END) AS BIGINT) AS settled, CAST(sum(lo) AS BIGINT) AS low, CAST(sum(hi) AS BIGINT) AS high FROM b GROUP BY user_id""")  # fmt: skip
def marker_bounds(events):
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.select(F.col("user_id").alias("page"), (F.row_number().over(by) - 1).alias("i"), "event_id")
    cands = rows.select("page", "i", F.when(F.col("event_id") % 7 == 0, F.col("i") + 2).alias("pin"))
    totals = rows.groupBy("page").agg((F.count("*") + 2).alias("total"))
    out = layout.assigned(cands, totals)
    return out.groupBy(F.col("page").alias("user_id")).agg(F.count("*").alias("candidates"), F.count("number").alias("settled"), F.sum("lo").cast("long").alias("low"), F.sum("hi").cast("long").alias("high"))


@query("documents", sql=f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({TEXT}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id)
SELECT term, round(sum(w / l) / max(n), 6) AS mean_weight FROM w JOIN l USING (doc_id), n GROUP BY term ORDER BY sum(w / l) DESC, term LIMIT 20""")  # fmt: skip
def tfidf_top(docs):
    return stats.top_terms(stats.tfidf(docs), docs).withColumn("mean_weight", F.round("mean_weight", 6))


@query("events", sql="""
SELECT user_id, day, array_to_string(list(event_type ORDER BY value DESC, event_type), ',') AS labels, round(CASE WHEN count(*) > 1 THEN list(value ORDER BY value DESC, event_type)[1] - list(value ORDER BY value DESC, event_type)[2] ELSE 1.0 END, 6) AS gap
FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value FROM events) GROUP BY user_id, day""")  # fmt: skip
def gap_ambiguity(events):
    out = mentions.groups(events.select("user_id", F.to_date("ts").alias("day"), "event_type", "value"), ["user_id", "day"], label="event_type", score="value")
    return out.select("user_id", "day", F.array_join("labels", ",").alias("labels"), F.round("gap", 6).alias("gap"))


NAMES = "SELECT doc_id, lang AS category, unnest(regexp_extract_all(coalesce(text, ''), '\\p{Lu}\\p{Ll}+')) AS name FROM documents"


def capitalised(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of each document as gold, and as predictions with some lost and some with an article."""
    gold = docs.select("doc_id", F.col("lang").alias("category"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{Lu}\p{Ll}+)"), 1)).alias("name"))
    n = F.length("name")
    return gold, gold.filter(n % 3 != 0).withColumn("name", F.when(n % 5 == 0, F.concat(F.lit("der "), "name")).otherwise(F.col("name")))


def _scores_sql(norm: str) -> str:
    return f"""
WITH g AS ({NAMES}), p AS (SELECT doc_id, category, CASE WHEN length(name) % 5 = 0 THEN 'der ' || name ELSE name END AS name FROM g WHERE length(name) % 3 <> 0),
a AS (SELECT DISTINCT doc_id, category, {norm.format('name')} AS k FROM g), b AS (SELECT DISTINCT doc_id, category, {norm.format('name')} AS k FROM p),
j AS (SELECT coalesce(a.category, b.category) AS category, a.k AS x, b.k AS y FROM (SELECT * FROM a WHERE k <> '') a FULL JOIN (SELECT * FROM b WHERE k <> '') b ON a.doc_id = b.doc_id AND a.category = b.category AND a.k = b.k),
s AS (SELECT category, CAST(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS fn FROM j GROUP BY category)
SELECT category, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s"""


def _scores(docs: DataFrame, view: str) -> DataFrame:
    gold, pred = capitalised(docs)
    out = scoring.corpus_totals(scoring.entity_scores(gold, pred, view, categories=["en", "fr", "de", "es"]), "category")
    return out.select("category", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("documents", sql=_scores_sql(STRICT))
def entity_scores_strict(docs):
    return _scores(docs, "strict")


@query("documents", sql=_scores_sql(RELAXED))
def entity_scores_relaxed(docs):
    return _scores(docs, "relaxed")


@query("documents", sql=f"""
WITH g AS ({NAMES}), p AS (SELECT doc_id, category, CASE WHEN length(name) % 5 = 0 THEN 'der ' || name ELSE name END AS name FROM g WHERE length(name) % 3 <> 0),
a AS (SELECT doc_id, category, list(DISTINCT replace(lower(name), 'ß', 'ss')) AS x FROM g GROUP BY ALL), b AS (SELECT doc_id, category, list(DISTINCT replace(lower(name), 'ß', 'ss')) AS y FROM p GROUP BY ALL)
SELECT doc_id, category, array_to_string(list_sort(list_filter(coalesce(y, []), lambda k: NOT list_contains(coalesce(x, []), k))), ',') AS fp_names,
  array_to_string(list_sort(list_filter(coalesce(x, []), lambda k: NOT list_contains(coalesce(y, []), k))), ',') AS fn_names FROM a FULL JOIN b USING (doc_id, category)""")  # fmt: skip
def entity_misses(docs):
    gold, pred = capitalised(docs)
    return scoring.misses(gold, pred).select("doc_id", "category", F.array_join("fp_names", ",").alias("fp_names"), F.array_join("fn_names", ",").alias("fn_names"))


REL = """SELECT o_orderkey AS n, o_custkey AS doc_id, c_name AS subject, CASE c_mktsegment WHEN 'BUILDING' THEN 'place' WHEN 'MACHINERY' THEN 'group' ELSE 'person' END AS subject_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'created' WHEN '2-HIGH' THEN 'married_to' WHEN '3-MEDIUM' THEN 'worked_in' WHEN '4-NOT SPECIFIED' THEN 'has_author' ELSE 'sold_to' END AS relation_type,
  'Item ' || (o_orderkey % 7) AS object, CASE o_orderkey % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'person' ELSE 'visual_item' END AS object_type, 'order ' || o_orderkey AS evidence
  FROM orders JOIN customer ON o_custkey = c_custkey"""
TURNED = f"""SELECT n, doc_id, CASE WHEN relation_type = 'has_author' THEN object ELSE subject END AS subject, CASE WHEN relation_type = 'has_author' THEN object_type ELSE subject_type END AS subject_type,
  CASE WHEN relation_type = 'has_author' THEN 'created' ELSE relation_type END AS relation_type, CASE WHEN relation_type = 'has_author' THEN subject ELSE object END AS object,
  CASE WHEN relation_type = 'has_author' THEN subject_type ELSE object_type END AS object_type, evidence FROM ({REL})"""
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
TAXONOMY = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', {_LIST(sorted(s))}, {_LIST(sorted(o))}, {repr(c) if c else 'NULL'}, {_LIST(n.split())}, {repr(next(iter(x))) if x else 'NULL'}, {_LIST(next(iter(x.values()), '').split())})" for r, s, o, c, n, x in R.RELATIONS
) + ") AS t(relation, subjects, objects, cidoc, names, other_type, other_names)"


def sales(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders as relations of customers and items."""
    segment_type = F.when(F.col("c_mktsegment") == "BUILDING", "place").when(F.col("c_mktsegment") == "MACHINERY", "group").otherwise("person")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "created").when(p == "2-HIGH", "married_to").when(p == "3-MEDIUM", "worked_in").when(p == "4-NOT SPECIFIED", "has_author").otherwise("sold_to")
    k = F.col("o_orderkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("n"), F.col("o_custkey").alias("doc_id"), F.col("c_name").alias("subject"), segment_type.alias("subject_type"), kind.alias("relation_type"),
        F.concat(F.lit("Item "), (k % 7).cast("string")).alias("object"), F.when(k % 3 == 0, "place").when(k % 3 == 1, "person").otherwise("visual_item").alias("object_type"), F.concat(F.lit("order "), k.cast("string")).alias("evidence"),
    )


@query("orders", "customer", sql=f"""
SELECT relation_type, invalid_reason, invalid_reason = '' AS valid, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT relation_type, concat_ws('; ', CASE WHEN subjects IS NOT NULL AND NOT list_contains(subjects, subject_type) THEN 'subject_type ''' || subject_type || ''' not in [' || array_to_string(subjects, ', ') || '] for ''' || relation_type || '''' END,
    CASE WHEN objects IS NOT NULL AND NOT list_contains(objects, object_type) THEN 'object_type ''' || object_type || ''' not in [' || array_to_string(objects, ', ') || '] for ''' || relation_type || '''' END) AS invalid_reason
  FROM ({TURNED}) LEFT JOIN ({TAXONOMY}) ON relation = relation_type) GROUP BY ALL""")  # fmt: skip
def relation_validation(orders, customers):
    return relations.validated(relations.inverted(sales(orders, customers))).groupBy("relation_type", "invalid_reason", "valid").agg(F.count("*").alias("n"))


@query("orders", "customer", sql=f"""
SELECT relation_type, object_type, array_to_string(m, ',') AS db_schema_match, cidoc AS cidoc_property,
  CASE WHEN relation IS NULL THEN 'novel' WHEN len(m) > 0 AND cidoc IS NOT NULL THEN 'db+cidoc' WHEN cidoc IS NOT NULL THEN 'cidoc_only' WHEN len(m) > 0 THEN 'db_only' ELSE 'known_gap' END AS coverage, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, coalesce(CASE WHEN other_type = object_type THEN other_names ELSE names END, []) AS m FROM ({TURNED}) LEFT JOIN ({TAXONOMY}) ON relation = relation_type) GROUP BY ALL""")  # fmt: skip
def relation_alignment(orders, customers):
    out = relations.aligned(relations.inverted(sales(orders, customers)))
    return out.groupBy("relation_type", "object_type", F.array_join("db_schema_match", ",").alias("db_schema_match"), "cidoc_property", "coverage").agg(F.count("*").alias("n"))


@query("orders", "customer", sql=f"""
SELECT coverage, relation_type, CAST(count(*) AS BIGINT) AS n, coalesce(array_to_string(list(evidence ORDER BY k) FILTER (r <= 3 AND coverage IN ('novel', 'known_gap')), ','), '') AS examples FROM (
  SELECT *, n AS k, row_number() OVER (PARTITION BY coverage, relation_type ORDER BY n) AS r FROM (
    SELECT n, relation_type, evidence, CASE WHEN relation IS NULL THEN 'novel' WHEN len(m) > 0 AND cidoc IS NOT NULL THEN 'db+cidoc' WHEN cidoc IS NOT NULL THEN 'cidoc_only' WHEN len(m) > 0 THEN 'db_only' ELSE 'known_gap' END AS coverage
    FROM (SELECT *, coalesce(CASE WHEN other_type = object_type THEN other_names ELSE names END, []) AS m FROM ({TURNED}) LEFT JOIN ({TAXONOMY}) ON relation = relation_type))) GROUP BY ALL""")  # fmt: skip
def relation_coverage(orders, customers):
    out = relations.coverage(relations.aligned(relations.inverted(sales(orders, customers))))
    return out.withColumn("examples", F.array_join("examples", ","))


@query("orders", "customer", sql=f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(subject), relation_type, lower(object) ORDER BY n) AS r FROM ({TURNED})) WHERE r = 1")
def relation_dedupe(orders, customers):
    return relations.deduplicated(relations.inverted(sales(orders, customers)), ["n"])


@query("orders", "customer", sql=f"SELECT name, type FROM (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY n, e) AS r FROM (SELECT n, 0 AS e, subject AS name, subject_type AS type FROM ({REL}) UNION ALL SELECT n, 1, object, object_type FROM ({REL}))) WHERE r = 1")
def graph_nodes(orders, customers):
    return relations.nodes(sales(orders, customers))


@query("orders", "customer", sql=f"""
WITH g AS (SELECT DISTINCT doc_id, lower(subject) AS s, subject_type AS st, relation_type AS r, lower(object) AS o, object_type AS ot FROM ({REL})),
p AS (SELECT DISTINCT doc_id, s, st, CASE WHEN n % 4 = 0 THEN 'sold_to' ELSE r END AS r, o, ot FROM (SELECT n, doc_id, lower(subject) AS s, subject_type AS st, relation_type AS r, lower(object) AS o, object_type AS ot FROM ({REL})) WHERE n % 5 <> 0),
j AS (SELECT coalesce(g.r, p.r) AS relation_type, g.doc_id AS x, p.doc_id AS y FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.s = p.s AND g.st = p.st AND g.r = p.r AND g.o = p.o AND g.ot = p.ot)
SELECT relation_type, CAST(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS fn FROM j GROUP BY ALL""")  # fmt: skip
def triple_scores(orders, customers):
    gold = sales(orders, customers)
    pred = gold.filter(F.col("n") % 5 != 0).withColumn("relation_type", F.when(F.col("n") % 4 == 0, "sold_to").otherwise(F.col("relation_type")))
    return scoring.corpus_totals(scoring.triple_scores(gold, pred), "relation_type").select("relation_type", "tp", "fp", "fn")


@query("orders", "customer", sql=f"""
WITH g AS (SELECT doc_id, subject_type AS st, relation_type AS gold, lower(object) AS o, object_type AS ot, n FROM ({REL})),
p AS (SELECT doc_id, st, o, ot, list(r ORDER BY n) AS predicted FROM (SELECT doc_id, st, o, ot, n, CASE WHEN n % 2 = 0 THEN 'sold_to' ELSE gold END AS r FROM g) GROUP BY ALL)
SELECT gold, array_to_string(predicted, ',') AS predicted, CAST(count(*) AS BIGINT) AS n FROM g JOIN p USING (doc_id, st, o, ot) WHERE NOT list_contains(predicted, gold) GROUP BY ALL""")  # fmt: skip
def relation_confusions(orders, customers):
    gold = sales(orders, customers)
    pred = gold.withColumn("relation_type", F.when(F.col("n") % 2 == 0, "sold_to").otherwise(F.col("relation_type")))
    return scoring.confusions(gold, pred).groupBy("gold", F.array_join("predicted", ",").alias("predicted")).agg(F.count("*").alias("n"))


@query("documents", sql=f"""
WITH l AS (SELECT doc_id, lang AS category, i, trim(x[i]) AS name FROM (SELECT doc_id, lang, string_split({TEXT}, chr(10)) AS x, unnest(range(1, len(string_split({TEXT}, chr(10))) + 1)) AS i FROM documents)),
f AS (SELECT doc_id, category, name, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category, lower(name) ORDER BY i) AS r FROM l WHERE name <> '') WHERE r = 1)
SELECT doc_id, category, CAST(count(*) AS BIGINT) AS n, md5(string_agg(name, chr(10) ORDER BY i)) AS names_md5 FROM f GROUP BY ALL""")  # fmt: skip
def merge_first_wins(docs):
    found = docs.select("doc_id", F.col("lang").alias("category"), F.lit(0).alias("chunk"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "name"))
    out = relations.merged_entities(found)
    return out.select("doc_id", "category", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", "\n").cast("binary")).alias("names_md5"))


@query("labels", sql="""
SELECT p AS predicted, p - w AS tp, round((p - w) / p, 6) AS precision, round((p - w) / (p - w + m), 6) AS recall FROM (
  SELECT CAST(sum(toxic + 1) AS BIGINT) AS p, CAST(sum(toxic) AS BIGINT) AS w, CAST(sum(1 - quality) AS BIGINT) AS m FROM labels)""")  # fmt: skip
def review_scores(labels):
    review = labels.select((F.col("toxic") + 1).cast("string").alias("n_predicted"), F.col("toxic").cast("string").alias("n_wrong"), (1 - F.col("quality")).cast("string").alias("n_missed"))
    return mentions.review_scores(review).select("predicted", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("documents", sql=f"SELECT doc_id, CAST(length({TEXT}) AS INT) AS chars, CAST(CASE WHEN regexp_replace({TEXT}, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({TEXT}, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS INT) AS tokens FROM documents")
def text_stats(docs):
    return docs.select("doc_id", T.text_stats(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")


@query("events", sql="SELECT event_type, round(coalesce(avg(value) FILTER (value > 0), 0), 6) AS ocr_confidence FROM events GROUP BY event_type")
def positive_confidence(events):
    return readers.ocr_confidence(events.withColumn("conf", F.col("value")), "event_type").withColumn("ocr_confidence", F.round("ocr_confidence", 6))


@query("events", sql="SELECT user_id, CAST(count(*) FILTER (b IS NULL OR b <> w) AS BIGINT) AS labelled, CAST(count(*) AS BIGINT) AS pieces FROM (SELECT user_id, event_id // 200 AS w, lag(event_id // 200) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY user_id")
def subword_labels(events):
    rows = events.select("user_id", "event_id", F.expr("event_id div 200").alias("word_id"), F.lit(1).alias("label"))
    out = mentions.first_subwords(rows, key="user_id", order="event_id")
    return out.groupBy("user_id").agg(F.count_if(F.col("aligned") != -100).alias("labelled"), F.count("*").alias("pieces"))


@query("events", sql="""
WITH t AS (SELECT DISTINCT upper(event_type) AS t FROM events), l AS (SELECT list_concat(['O'], flatten(list_transform(list_sort(list(t)), lambda x: ['B-' || x, 'I-' || x]))) AS l FROM t)
SELECT CAST(i - 1 AS INT) AS id, l[i] AS label FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM l)""")  # fmt: skip
def label_list(events):
    return mentions.label_list(events.select(F.concat(F.lit("B-"), "event_type").alias("tag")))


@query("documents", sql=f"""
SELECT doc_id, md5(replace(regexp_replace(t, '(ion)-' || chr(10) || '(\\p{{Ll}})', '\\1\\2', 'g'), chr(10), ' ')) AS text_md5 FROM (
  SELECT doc_id, regexp_replace(x, '(ion) (\\p{{Ll}}+ \\p{{Ll}}+ )', '\\1-' || chr(10) || '\\2', 'g') AS t FROM (SELECT doc_id, trim(regexp_replace(replace({TEXT}, '-', ''), '\\s+', ' ', 'g')) AS x FROM documents))""")  # fmt: skip
def hyphen_reflow(docs):
    x = F.btrim(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("-"), F.lit("")), r"\s+", " "))
    lines = F.split(F.regexp_replace(x, r"(ion) (\p{Ll}+ \p{Ll}+ )", "$1-\n$2"), "\n", -1)
    # The fold runs over a column: an expression in its place would be evaluated for each line.
    return docs.select("doc_id", lines.alias("lines")).select("doc_id", F.md5(F.array_join(T.close_hyphens(F.col("lines")), " ").cast("binary")).alias("text_md5"))


def replaced_sql(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
    return text


STRIPPED_SQL = f"""SELECT doc_id, array_to_string(list_filter(CASE WHEN cut > 0 THEN l[1:cut - 1] ELSE l END, lambda x: NOT regexp_matches(x, '{R.FOOTNOTE_ENTRY}')), chr(10)) AS t
FROM (SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '{R.FOOTNOTE_LINE}')), true), 0) AS cut FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS l FROM documents))"""
EVEN_SQL = "replace(replace(replace(replace(" + replaced_sql("t", [("[¹²³⁰-⁹]+", "''"), ("\\^\\d+", "''"), ("([\\p{L}\\p{N}_])\\s*\\[\\d+\\]", "'\\1'")]) + ", chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n', chr(10)), '\\t', ' ')"
CLEAN_SQL = replaced_sql(EVEN_SQL, [
    ("[\\f\\v\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+", "' '"), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "''"),
    ("([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])", "'\\1\\2'"), ("[ \\t]{2,}", "' '"), ("\\n{3,}", "chr(10) || chr(10)"), ("(?m)^[^a-zA-ZÀ-ɏ\\n]{0,3}$\\n?", "''"),
])


@query("documents", sql=f"SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS text FROM ({capped_sql(f"SELECT doc_id, replace({CLEAN_SQL}, 'ſ', 's') AS t FROM ({STRIPPED_SQL})")})")
def clean_ocr(docs):
    return docs.select("doc_id", T.clean_ocr(F.coalesce("text", F.lit(""))).alias("text"))


CORE = lambda c: f"trim({c}, '" + R.HYPHEN_STRIP.replace("'", "''") + "')"
CAPS = "(length({0}) >= 2 AND upper({0}) = {0} AND lower({0}) <> {0})"


@query("documents", sql=f"""
WITH t AS (SELECT doc_id, string_split(upper(replace({TEXT}, 'ß', 'ss')), ' ') AS t FROM documents),
e AS (SELECT doc_id, i, t[i] AS token, {CORE("t[i]")} AS c, coalesce({CORE("t[i - 1]")}, '') AS before FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)),
n AS (SELECT doc_id, i, CASE WHEN NOT {CAPS.format("c")} OR list_contains({R.CAPS_KEEP}, c) OR regexp_matches(c, '{R.ROMAN}') THEN token ELSE
  left(token, instr(token, c) - 1) || CASE WHEN {CAPS.format("before")} AND list_contains({R.CAPS_LOWER}, c) THEN lower(c) ELSE array_to_string(list_transform(string_split(c, '-'), lambda p: upper(left(p, 1)) || lower(substring(p, 2))), '-') END || substring(token, instr(token, c) + length(c)) END AS w FROM e)
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM n GROUP BY doc_id""")  # fmt: skip
def recased(docs):
    return docs.select("doc_id", T.recased(F.upper(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss")))).alias("text"))


@query("documents", sql=f"""
WITH s AS (SELECT doc_id || ':' || CAST(sentence_id AS INT) AS sentence_id, s AS sentence FROM ({SENTENCES})), d AS (SELECT * FROM s ORDER BY md5(sentence_id || '/42'), sentence_id LIMIT 150)
SELECT sentence_id, sentence, array_to_string(list_transform(list_sort(y), lambda x: 'YEAR: ' || x), ' | ') AS predicted, CAST(len(y) AS INT) AS n_predicted, '' AS n_wrong, '' AS n_missed, '' AS notes
FROM (SELECT *, regexp_extract_all(sentence, '[12][0-9]{{3}}') AS y FROM d)""")  # fmt: skip
def review_sample(docs):
    s = segment.sentences(docs).select(F.concat_ws(":", "doc_id", "sentence_id").alias("sentence_id"), "sentence")
    found = s.select("sentence_id", F.explode(F.regexp_extract_all("sentence", F.lit("([12][0-9]{3})"), 1)).alias("text")).select("sentence_id", "text", F.lit("YEAR").alias("label"), F.lit(0).alias("start"))
    return mentions.review_sample(s, found)


@query("documents", sql=f"""
SELECT s.doc_id, CAST(s.sentence_id AS INT) AS sentence_id, '{{"text":' || to_json(s.s) || ',"label":[' || coalesce(string_agg('[0,' || length(s.s) || ',"' || 'YEAR"]', ',') FILTER (regexp_matches(s.s, '^[12][0-9]{{3}}$')), '') || ']}}' AS value FROM ({SENTENCES}) s GROUP BY s.doc_id, s.sentence_id, s.s""")  # fmt: skip
def doccano_lines(docs):
    s = segment.sentences(docs).withColumn("key", F.struct("doc_id", "sentence_id"))
    years = s.filter(F.col("sentence").rlike("^[12][0-9]{3}$")).select("key", F.lit(0).alias("start"), F.length("sentence").alias("end"), F.lit("YEAR").alias("label"))
    lines = mentions.doccano(s.select("key", "sentence"), years, key="key", keep=True)
    return lines.select("key.doc_id", "key.sentence_id", "value")


@query("events", sql="SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (event_type = 'success') AS BIGINT) AS successful, CAST(count(*) FILTER (event_type <> 'success') AS BIGINT) AS failed FROM (SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS event_type FROM events)")
def batch_summary(events):
    return sinks.batch_summary(events.select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status")))


@query("events", sql="SELECT event_type AS label, CAST(event_id AS VARCHAR) AS text, value AS score FROM events WHERE value < 0.8 ORDER BY value, event_type, CAST(event_id AS VARCHAR) LIMIT 15")
def low_confidence(events):
    rows = events.select(F.col("event_type").alias("label"), F.col("event_id").cast("string").alias("text"), F.col("value").alias("score"))
    return mentions.by_score(rows, below=0.8)


@query("events", sql=f"""
WITH t AS (SELECT user_id, event_id, value, {TAG} AS tag FROM events), n AS (SELECT user_id, event_id, tag AS gold, CASE WHEN event_id % 11 = 0 THEN 'O' ELSE tag END AS pred FROM t),
s AS ({" UNION ALL ".join(f'''SELECT '{side}' AS side, user_id, min(event_id) AS a, max(event_id) AS b, type FROM (
  SELECT *, max(CASE WHEN tag = 'O' OR (tag[1] = 'I' AND tag[3:] <> type) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS broken FROM (
    SELECT *, first_value(tag[3:]) OVER (PARTITION BY user_id, run ORDER BY event_id) AS type FROM (
      SELECT user_id, event_id, {side} AS tag, sum(CASE WHEN {side}[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n) WHERE run > 0)) WHERE broken = 0 GROUP BY user_id, run, type''' for side in ("gold", "pred"))}),
j AS (SELECT coalesce(g.type, p.type) AS type, g.a AS x, p.a AS y FROM (SELECT * FROM s WHERE side = 'gold') g FULL JOIN (SELECT * FROM s WHERE side = 'pred') p ON g.user_id = p.user_id AND g.a = p.a AND g.b = p.b AND g.type = p.type)
SELECT type, CAST(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS fn FROM j GROUP BY type""")  # fmt: skip
def tag_scores(events):
    gold = F.expr(TAG)
    tokens = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), gold.alias("gold"), F.when(F.col("event_id") % 11 == 0, "O").otherwise(gold).alias("pred"), F.lit(False).alias("ignored"))
    return scoring.span_scores(tokens, lenient=False).select("type", "tp", "fp", "fn")


from quire.plans import page_catalog  # noqa: E402,F401  (registers its queries here)

"""Line dedup: suffix ranks over line sequences by distributed prefix doubling. DataFrame functions only.

A document is the sequence of its lines that aren't blank, without spaces, tabs and carriage returns
around them. A line goes where it lies in a run of consecutive lines, of ``min_words`` words or more
in total, that also starts earlier, by (key, line); runs are judged on the input, copies may overlap,
and none crosses documents. With ``widely``, a line that is in so many places is a run of its own,
however short. Words are counted by ``words``: ``by_spaces``, as the SQL of the query does, or
``by_script``, by any white space, and by characters in scripts and stretches that have none.

Lines that are nowhere else end runs and leave at once. Of all others, a suffix is ranked by its
first line, then by its first two, four and so on: the ranks of 2h lines are those of the sorted
distinct pairs (rank of h lines here, rank of h lines h further on). Suffixes of one rank are an
interval of the suffix array with a common prefix of 2h lines. A window of any length between has
two ranks that overlap. Every repeated run of ``min_words`` words is the union of its least
windows, those that fall below ``min_words`` without their first or last line; so only windows of
``min_words`` lines at most are looked up, and doubling ends there. All windows of an interval but
the first are later copies, and their lines go.

Defined results: null and empty texts have no lines; blank lines never go; rows of one key are
documents of their own, in the order of their texts' hashes, null keys first; a wholly repeated row
is a later copy; an empty table gives no rows; other columns are ignored, or kept as they are by
``without_repeated_lines``, which leaves out documents that had lines and lost all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import joined_spread, keyed, renamed
from quire.session import discard, materialize

UNPARTED = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def by_spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def by_script(line: Column) -> Column:
    """Words by white space, one more for each 20 characters of a stretch without; in scripts that don't part words, 2 characters are a word."""
    return F.greatest(F.lit(1), F.regexp_count(line, F.lit(rf"(?U)[{UNPARTED}]{{1,2}}|[^\s{UNPARTED}]{{1,20}}")))


def lines_of(rows: DataFrame, words: Callable[[Column], Column] = by_spaces) -> DataFrame:
    """(k, n, id, words): the n-th line that isn't blank."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), trimmed), lambda x: x != "")
    line = F.col("line")
    return rows.select("k", F.posexplode(lines).alias("n", "line")).select(
        "k", "n", F.unhex(F.md5(line.cast("binary"))).alias("id"), words(line).alias("words")
    )


def ranked(distinct: DataFrame, names: list[str], rank: str) -> DataFrame:
    """A rising number for each row in the rows' order, without one task that sees them all."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(distinct.repartitionByRange(parts, *names).sortWithinPartitions(*names).withColumn(rank, F.monotonically_increasing_id()), rank)


def ranks(rows: DataFrame, longest: int, widely: int | None, words: Callable[[Column], Column]) -> tuple[DataFrame, list[int]]:
    """(k, n, words, wide, r0, r1, r2, ...) of the lines that occur twice: ranks of the suffix's first 1, 2, 4, ... lines, null where these aren't repeated."""
    lines = lines_of(rows, words)
    wide = F.lit(False) if widely is None else F.col("count") >= widely
    shared = ranked(lines.groupBy("id").count().filter("count > 1").select("id", wide.alias("wide")), ["id"], "r0")
    table = materialize(lines.join(shared, "id").select("k", "n", "words", "wide", "r0"), "ranks0")
    discard(shared)
    heights, h = [1], 1
    while 2 * h <= longest:
        own, level = f"r{len(heights) - 1}", f"r{len(heights)}"
        order = Window.partitionBy("k").orderBy("n")
        ahead = F.when(F.lead("n", h).over(order) == F.col("n") + h, F.lead(own, h).over(order))
        # Distinct names of the pair keep a rank that is null on either side out of the join.
        paired = materialize(table.withColumn("ahead", F.when(F.col(own).isNotNull(), ahead)), "paired")
        pairs = paired.filter("ahead is not null").groupBy(own, "ahead").count().filter("count > 1").select(own, "ahead")
        named = ranked(pairs, [own, "ahead"], level)
        whole = paired.filter("ahead is not null").join(named, [own, "ahead"], "left").drop("ahead")
        rest = paired.filter("ahead is null").drop("ahead").withColumn(level, F.lit(None).cast("long"))
        doubled = materialize(whole.unionByName(rest), "ranks")
        for old in (paired, named, table):
            discard(old)
        table, h = doubled, 2 * h
        heights.append(h)
    return table, heights


def windows(table: DataFrame, heights: list[int], min_words: int) -> DataFrame:
    """(k, n, lines, a, b): the least windows of ``min_words`` words from each line on, and each wide line, with their two ranks."""
    ranks_here = [f"r{i}" for i in range(len(heights))]
    frame = Window.partitionBy("k").orderBy("n").rowsBetween(0, min_words - 1)
    following = F.collect_list(F.struct("n", "words", *ranks_here)).over(frame)
    # What follows without a gap, and its words up to each line.
    near = F.filter(following, lambda x, i: x["n"] == F.col("n") + i)
    at = table.select("k", "n", "wide", near.alias("near")).withColumn("sums", F.transform("near", lambda x, i: F.aggregate(F.slice("near", F.lit(1), i + 1), F.lit(0), lambda s, y: s + y["words"].cast("int"))))
    m = F.lit(min_words)
    before = lambda i: F.when(i > 0, F.get("sums", i - 1)).otherwise(0)
    least = F.filter(
        F.sequence(F.lit(1), F.size("sums")),
        lambda j: (F.get("sums", j - 1) >= m) & ((before(j - 1) < m) | (F.get("sums", j - 1) - F.get("sums", F.lit(0)) < m)) | (F.col("wide") & (j == 1)),
    )
    each = at.select("k", "n", "near", F.explode(least).alias("lines"))
    first = second = None
    for r, h in zip(ranks_here, heights):
        fits = (F.col("lines") >= h) & (F.col("lines") < 2 * h)
        a, b = F.get("near", F.lit(0))[r], F.get("near", F.col("lines") - h)[r]
        first, second = (F.when(fits, a), F.when(fits, b)) if first is None else (first.when(fits, a), second.when(fits, b))
    return each.select("k", "n", "lines", first.alias("a"), second.alias("b")).filter("a is not null and b is not null")


def later_copies(rows: DataFrame, min_words: int, widely: int | None, words: Callable[[Column], Column]) -> DataFrame:
    """(k, gone): the numbers of the lines that go, in order."""
    table, heights = ranks(rows, min_words, widely, words)
    found = materialize(windows(table, heights, min_words), "windows")
    discard(table)
    interval = ["lines", "a", "b"]
    firsts = found.groupBy(*interval).agg(F.min(F.struct("k", "n")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    later = joined_spread(found, firsts, interval, "k").filter(F.struct("k", "n") != F.col("first"))
    numbers = F.flatten(F.collect_set(F.sequence("n", F.col("n") + F.col("lines") - 1)))
    return later.groupBy("k").agg(F.array_sort(F.array_distinct(numbers)).alias("gone"))


def split_lines(rows: DataFrame, min_words: int, widely: int | None, words: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``n_lines``, ``gone`` and ``kept``, the text without the lines that go."""
    out = rows.join(later_copies(rows, min_words, widely, words), "k", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split("text", "\n", -1)
    filled = F.filter(F.transform(lines, lambda x, i: F.when(trimmed(x) != "", i)), lambda i: i.isNotNull())
    out = out.withColumn("lines", lines).withColumn("filled", filled)
    places = F.transform("gone", lambda n: F.get("filled", n))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.withColumn("kept", kept).withColumn("n_lines", F.size("filled").cast("long")).drop("lines", "filled")


def dedup_lines(docs: DataFrame, *, min_words: int = 10, widely: int | None = None, words: Callable[[Column], Column] = by_spaces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_lines, n_removed, n_runs (of consecutive lines that go), kept_sha256, kept."""
    out = split_lines(keyed(docs, key, text), min_words, widely, words)
    runs = F.size(F.filter("gone", lambda n, i: (i == 0) | (F.get("gone", i - 1) != n - 1)))
    return out.select(
        F.col("key").alias(key), "n_lines", F.size("gone").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "kept"
    )


def without_repeated_lines(docs: DataFrame, *, min_words: int = 10, widely: int | None = None, words: Callable[[Column], Column] = by_spaces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts without later copies of runs of lines."""
    plain, names = renamed(docs)
    out = split_lines(keyed(plain, names[key], names[text], carry=list(names.values())), min_words, widely, words).filter((F.size("gone") < F.col("n_lines")) | (F.col("n_lines") == 0))
    of = lambda c, n: F.when(F.size("gone") > 0, F.col("kept")).otherwise(F.col(n)) if c == text else F.col(n)
    return out.select(*[of(c, n).alias(c) for c, n in names.items()])


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents
), placed AS (
  SELECT doc_id, text, raw, list_filter(range(1, len(raw) + 1), lambda i: trim(raw[i], ' ' || chr(9) || chr(13)) <> '') AS filled FROM lines
), docs AS (
  SELECT doc_id, text, raw, filled, list_transform(filled, lambda i: trim(raw[i], ' ' || chr(9) || chr(13))) AS l FROM placed
), spans AS (
  SELECT doc_id, l, n, m, list_sum(list_transform(l[n:n + m - 1], lambda x: length(x) - length(replace(x, ' ', '')) + 1)) AS words
  FROM (SELECT doc_id, l, n, unnest(range(1, least(10, len(l) - n + 1) + 1)) AS m FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM docs))
), least_ones AS (
  SELECT doc_id, n, m, array_to_string(l[n:n + m - 1], chr(10)) AS run FROM spans
  WHERE words >= 10 AND (words - (length(l[n + m - 1]) - length(replace(l[n + m - 1], ' ', '')) + 1) < 10 OR words - (length(l[n]) - length(replace(l[n], ' ', '')) + 1) < 10)
), copies AS (
  SELECT doc_id, n, m, row_number() OVER (PARTITION BY run ORDER BY doc_id, n) AS place FROM least_ones
), gone AS (
  SELECT doc_id, list_sort(list(DISTINCT i)) AS g FROM (SELECT doc_id, unnest(range(n, n + m)) AS i FROM copies WHERE place > 1) GROUP BY doc_id
), joined AS (
  SELECT docs.doc_id, text, raw, filled, l, coalesce(g, []) AS g FROM docs LEFT JOIN gone USING (doc_id)
), cut AS (
  SELECT doc_id, text, raw, l, g, list_transform(g, lambda i: filled[i]) AS raw_gone FROM joined
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(g) AS BIGINT) AS n_removed,
       CAST(len(list_filter(g, lambda x: NOT list_contains(g, x - 1))) AS BIGINT) AS n_runs,
       sha256(CASE WHEN len(g) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(raw_gone, i)), lambda i: raw[i]), chr(10)) END) AS kept_sha256
FROM cut
"""

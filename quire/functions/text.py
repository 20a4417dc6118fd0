"""Text expressions: Column -> Column, built-in functions alone. Java's classes are made Unicode by (?U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import rules as R

U = "(?U)"


def replaced(col: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules one after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, U + r[0], r[1]), rules, col)


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it: an expression's columns are copied to each use."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mapped(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def footnote_clean(text: Column) -> Column:
    """tx_footnote_clean: residue of footnote marks goes, runs of blanks become one."""
    return F.regexp_replace(replaced(text, [(p, "") for p in R.RESIDUE]), "[ \t]{2,}", " ")


def glyph_rules(text: Column) -> Column:
    """lay_glyph_rules: all rewrites in order."""
    return replaced(text, R.GLYPHS)


def gazetteer(text: Column, names: dict[str, str] = R.GAZETTEER) -> Column:
    """lay_gazetteer: a token's core is looked up; its first occurrence in the token is replaced."""
    table = mapped(names)

    def one(token: Column) -> Column:
        core = F.btrim(token, F.lit(R.HYPHEN_STRIP))
        new, at = F.element_at(table, core), F.instr(token, core)
        return F.when((core != "") & new.isNotNull(), F.concat(F.left(token, at - 1), new, F.substring(token, at + F.length(core), F.length(token)))).otherwise(token)

    return F.array_join(F.transform(F.split(text, " ", -1), one), " ")


def letters_only(text: Column) -> Column:
    """tx_clean_letters: German letters and line marks stay, all else becomes a blank; blanks collapse."""
    kept = F.regexp_replace(text, "[^a-zäöüßA-ZÄÖÜ\n\t\r\f ​-‏  ]+", " ")
    return F.btrim(F.regexp_replace(kept, U + r"\s+", " "))


def norm_strict(text: Column) -> Column:
    """tx_norm_strict; case folding beyond lower case is that of sharp s, which is what German needs."""
    return F.replace(F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), U + r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def norm_relaxed(text: Column) -> Column:
    """tx_norm_relaxed: quotes around the name and one leading article or preposition go, too."""
    inner = F.btrim(norm_strict(text), F.lit(R.QUOTES + " "))
    return F.btrim(F.regexp_replace(inner, "^(?:" + "|".join(R.LEADING) + ")(?: |$)", ""))


def small_caps(text: Column) -> Column:
    """tx_small_caps: runs of letters in capitals or with erratic capitals get one capital."""
    return bound(F.replace(text, F.lit("ı"), F.lit("i")), small_caps_in)


def small_caps_in(plain: Column) -> Column:
    letters = "[A-Za-zÀ-ɏ]+"
    words = F.regexp_extract_all(plain, F.lit(f"({letters})"), 1)
    between = F.split(plain, letters, -1)

    def fixed(word: Column) -> Column:
        alpha = F.regexp_replace(word, r"\P{L}", "")
        n = F.length(alpha)
        upper = F.length(F.regexp_replace(word, r"\P{Lu}", ""))
        later = F.length(F.regexp_replace(F.substring(alpha, F.lit(2), F.length(alpha)), r"\P{Lu}", ""))
        odd = ((upper == n) & (n >= 2)) | ((n >= 3) & (upper / n >= 0.6)) | (later >= 2)
        several = word.rlike(r"\p{Lu}.*\p{Lu}")  # any pattern has two capitals: most words are done here
        return F.when(several & odd, F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, F.lit(2), F.length(word))))).otherwise(word)

    joined = F.zip_with(between, words, lambda gap, word: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(fixed(word), F.lit(""))))
    return F.when(plain.rlike(r"\p{Lu}[A-Za-zÀ-ɏ]*\p{Lu}"), F.array_join(joined, "")).otherwise(plain)


def strip_footnotes(text: Column) -> Column:
    """tx_strip_footnotes: entries go, and everything from a separating line on; then marks in the text."""

    def before(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(U + R.FOOTNOTE_LINE)), F.lit(True)).cast("int")
        return bound(at, lambda at: F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines))

    main = F.filter(bound(F.split(text, "\n", -1), before), lambda x: ~x.rlike(U + R.FOOTNOTE_ENTRY))
    return replaced(F.array_join(main, "\n"), [("[¹²³⁰-⁹]+", ""), (r"\^\d+", ""), (r"(?<=\w)\s*\[\d+\]", "")])


def clean_ocr(text: Column) -> Column:
    """tx_clean_ocr: the fixed sequence of cleaning steps; their order matters."""
    c = strip_footnotes(text)
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit(" "))
    c = replaced(c, [(r"[^\S\n\t ]+", " "), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"(\w)-\s*\n\s*(\w)", "$1$2"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")])
    c = F.regexp_replace(c, "(?m)^[^a-zA-ZÀ-ɏ\n]{0,3}$\n?", "")
    c = small_caps(F.replace(c, F.lit("ſ"), F.lit("s")))
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def sanitized(text: Column) -> Column:
    """tx_sanitize: a name for files and tasks."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), F.lit("_"))


def core_of(token: Column) -> Column:
    return F.btrim(token, F.lit(R.HYPHEN_STRIP))


def core_if_trimmed(token: Column) -> Column:
    """core_of; most tokens have nothing to trim, which two look-ups tell sooner than trimming."""
    strip = F.lit(R.HYPHEN_STRIP)
    return F.when(strip.contains(F.left(token, F.lit(1))) | strip.contains(F.right(token, F.lit(1))), core_of(token)).otherwise(token)


def recased(text: Column) -> Column:
    """tx_recase: capitals become names; sigla and Roman numerals stay; function words within a run are small."""
    caps = lambda c: (F.length(c) >= 2) & (F.upper(c) == c) & (F.lower(c) != c)
    parts = lambda c: F.array_join(F.transform(F.split(c, "-", -1), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))), "-")
    one_part = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c))))
    keeps, small = F.lit("|" + "|".join(R.CAPS_KEEP) + "|"), F.lit("|" + "|".join(R.CAPS_LOWER) + "|")
    among = lambda c, names: names.contains(F.concat(F.lit("|"), c, F.lit("|"))) & ~c.contains("|")

    def one(x: Column, last: Column) -> Column:
        token, c = x["token"], x["c"]
        new = F.when(F.coalesce(last["caps"], F.lit(False)) & among(c, small), F.lower(c)).when(c.contains("-"), parts(c)).otherwise(one_part(c))
        done = F.when(token == c, new).otherwise(bound(F.instr(token, c), lambda at: F.concat(F.left(token, at - 1), new, F.substring(token, at + F.length(c), F.length(token)))))
        return F.when(x["caps"] & ~among(c, keeps) & ~c.rlike(R.ROMAN), done).otherwise(token)

    # Step by step: what a lambda uses several times is a field of its argument, not an expression.
    cored = F.transform(F.split(text, " ", -1), lambda t: F.struct(t.alias("token"), core_if_trimmed(t).alias("c")))
    marked = F.transform(cored, lambda x: F.struct(x["token"].alias("token"), x["c"].alias("c"), caps(x["c"]).alias("caps")))
    return bound(marked, lambda all: F.array_join(F.zip_with(all, F.concat(F.array(F.get(all, F.lit(-1))), F.slice(all, F.lit(1), F.size(all) - 1)), one), " "))


def hyphen_action(head: Column, tail: Column) -> Column:
    """tx_hyphen_action: join, compound or open."""
    pair = F.concat(head, F.lit("\u0001"), tail)
    return (
        F.when(tail.rlike(r"^\p{Ll}") | pair.isin([f"{a}\u0001{b}" for a, b in R.HYPHEN_JOIN]), "join")
        .when(pair.isin([f"{a}\u0001{b}" for a, b in R.HYPHEN_COMPOUND]), "compound")
        .otherwise("open")
    )


def close_hyphens(lines: Column) -> Column:
    """tx_close_hyphens: words broken at a source line's end are completed; an emptied line disappears.

    A fold over the lines: what it carries is the lines so far and how to take the next line's first token.
    """
    cleaned = F.transform(lines, lambda x: F.btrim(x))  # btrim itself would take the place as its second argument
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("pull"))

    def step(acc: Column, x: Column) -> Column:
        raw, tail = x["line"], x["next"]
        pulling = acc["pull"] != ""
        token, rest = F.substring_index(raw, " ", 1), F.btrim(F.when(F.instr(raw, " ") > 0, F.substring(raw, F.instr(raw, " ") + 1, F.length(raw))).otherwise(""))
        last = F.element_at(acc["out"], -1)
        finished = F.concat(last, F.when(acc["pull"] == "compound", "-").otherwise(""), token)
        before = F.when(pulling, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(finished))).otherwise(acc["out"])
        own = F.when(pulling, rest).otherwise(raw)
        head = core_of(F.element_at(F.split(F.left(own, F.length(own) - 1), " ", -1), -1))
        action = F.when(own.endswith("-") & tail.isNotNull(), hyphen_action(head, core_of(F.substring_index(tail, " ", 1)))).otherwise("open")
        kept = F.when(action == "open", own).otherwise(F.left(own, F.length(own) - 1))
        out = F.when(pulling & (own == ""), before).otherwise(F.concat(before, F.array(kept)))
        return F.struct(out.alias("out"), F.when(action == "open", "").otherwise(action).alias("pull"))

    after = F.concat(F.slice(cleaned, F.lit(2), F.size(cleaned)), F.array(F.lit(None).cast("string")))
    paired = F.filter(F.zip_with(cleaned, after, lambda x, y: F.struct(x.alias("line"), y.alias("next"))), lambda x: x["line"].isNotNull())
    return F.aggregate(paired, start, step, lambda acc: acc["out"])


def open_sentence(text: Column) -> Column:
    """tx_open_sentence: what is left without quotes, brackets and superscripts at its end ends no sentence."""
    bare = F.regexp_replace(text, r"[»«\"'’‘“”)\]⁰¹²³⁴⁵⁶⁷⁸⁹\s]+$", "")
    return (bare != "") & ~bare.rlike("[.!?:;]$")


def protected(text: Column) -> Column:
    """Periods of abbreviations, initials and ordinals behind a private character."""
    return replaced(text, [(p, "$1" + R.GUARD) for p in R.PROTECT])


def split_sentences(text: Column, protect: bool = False) -> Column:
    """tx_sentence_split, tx_protect_split: array of trimmed sentences; after [.!?] and blanks before a capital or quote, and at line ends."""
    marked = F.regexp_replace(protected(text) if protect else text, r"([.!?]) +([\p{Lu}«„\"])", "$1\n$2")
    parts = F.transform(F.split(marked, "\n", -1), lambda s: F.btrim(F.replace(s, F.lit(R.GUARD), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def chunk_greedy(sentences: Column, most: int = 800) -> Column:
    """tx_chunk_greedy: sentences packed in order into chunks of ``most`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(s) > most)
        done = F.when(full, F.concat(acc["done"], F.array(F.btrim(acc["now"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(F.when(full, "").otherwise(acc["now"]), s, F.lit(" ")).alias("now"))

    return F.aggregate(sentences, start, step, lambda a: F.when(F.btrim(a["now"]) != "", F.concat(a["done"], F.array(F.btrim(a["now"])))).otherwise(a["done"]))


def canonical_tag(tag: Column) -> Column:
    """tx_canon_tag and jn_label_canon."""
    body = F.substring(tag, F.lit(3), F.length(tag))
    known = F.coalesce(F.element_at(mapped(R.TAG_ALIASES), F.lower(body)), F.upper(body))
    return F.when(tag.isNull() | tag.isin("_", "", "O") | ~tag.rlike("^[BI]-.+"), "O").otherwise(F.concat(F.left(tag, F.lit(2)), known))


def property_label(id: Column, name: Column, inverse: Column) -> Column:
    """tx_fmt_label."""
    return F.concat(id, F.lit(" "), name, F.coalesce(F.concat(F.lit(" ("), inverse, F.lit(")")), F.lit("")))


def evidence_trimmed(text: Column) -> Column:
    """tx_evidence_trim."""
    flat = F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > 80, F.concat(F.left(flat, F.lit(77)), F.lit("…"))).otherwise(flat)


def language_code(label: Column) -> Column:
    """tx_lang_code."""
    return F.coalesce(F.element_at(mapped(R.LANGUAGES), label), F.lit("deu+eng"))


def escaped(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def highlighted(text: Column, spans: Column) -> Column:
    """tx_highlight: ``spans`` (array of start, end, label), by start, as <mark> in escaped text."""
    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = escaped(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        inner = escaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.struct(F.concat(acc["html"], gap, F.lit("<mark title=\""), s["label"], F.lit("\">"), inner, F.lit("</mark>")).alias("html"), s["end"].cast("int").alias("at"))

    return F.aggregate(F.array_sort(spans), start, step, lambda a: F.concat(a["html"], escaped(F.substring(text, a["at"] + 1, F.length(text)))))


def text_stats(text: Column) -> Column:
    """ag_text_stats: characters and white-space tokens."""
    bare = F.regexp_replace(text, U + r"^\s+|\s+$", "")
    return F.struct(F.length(text).alias("chars"), F.when(bare == "", 0).otherwise(F.size(F.split(bare, U + r"\s+"))).alias("tokens"))


def footnote_lines(text: Column) -> Column:
    """ag_footnote_count: how many lines open like a footnote."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(U + R.FOOTNOTE_ENTRY)))

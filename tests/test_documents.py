"""Document operators on small rows, layout on a synthetic page, the catalog against DuckDB."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import json_repair
from quire.functions import text as T
from quire.operators import layout, mentions, relations, scoring, segment, stats
from quire.plans import catalog
from quire.sources import readers, sinks
from quire.streaming import limiter

SF = "/root/testdata/sf0.001"


def one(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("text"))).collect()]


def test_text(spark):
    assert one(spark, T.footnote_clean, "«Farna»!, ruhten?, vollendet!?,", "Zusammenhang*. Glocke* und", "1707¹", "(St. Ludwig?)") == ["«Farna», ruhten, vollendet,", "Zusammenhang. Glocke und", "1707", "(St. Ludwig?)"]
    assert one(spark, T.recased, "D. F. RITTMEYER", "THIEME-BECKER", "UB III", "DIE KIRCHE ZUM HERZEN JESU IN ST. FIDEN") == ["D. F. Rittmeyer", "Thieme-Becker", "UB III", "Die Kirche zum Herzen Jesu in St. Fiden"]
    # One capital after the first is no pattern: by the rule (two or more, or 60 % capitals) "MuRer" stays.
    assert one(spark, T.small_caps, "JoHAnNnEs MuRer", "MıcHAEL") == ["Johannnes MuRer", "Michael"]
    assert one(spark, T.norm_relaxed, "der Hochaltar", "„Hochaltar“", "der", "Straße") == ["hochaltar", "hochaltar", "", "strasse"]
    assert one(spark, T.strip_footnotes, "a¹ b [2] c\n1.) note\nd\n____\nrest") == ["a b c\nd"]
    assert one(spark, lambda t: T.split_sentences(t, True), "Siehe Vad. I, S.365. Am 14. Juli 1778 kam hl. Fides. Ende.") == [["Siehe Vad. I, S.365.", "Am 14. Juli 1778 kam hl. Fides.", "Ende."]]
    assert one(spark, T.glyph_rules, "Siche Tab. 1I", "Fol. ı6") == ["Siehe Tab. II", "Fol. 16"]
    assert one(spark, T.gazetteer, "(Carı, Dick)") == ["(CARL, DICK)"]


def test_hyphens(spark):
    rows = spark.createDataFrame([(["Glaser-, Schlosser-, Stein-", "hauer- und Schreinerwerk"],), (["RITT-", "MEYER kam"],), (["THIEME-", "BECKER"],), (["von 1954-", "Kultusgeräte."],)], "lines array<string>")
    got = [r[0] for r in rows.select(T.close_hyphens(F.col("lines"))).collect()]
    assert got == [["Glaser-, Schlosser-, Steinhauer-", "und Schreinerwerk"], ["RITTMEYER", "kam"], ["THIEME-BECKER"], ["von 1954-", "Kultusgeräte."]]


def test_lines_keep_digits_at_their_ends(spark):
    rows = spark.createDataFrame([(["0997 Haus", " 1534-", "1 Bild 1", "12 Raum 2"],)], "lines array<string>")
    assert rows.select(T.close_hyphens(F.col("lines"))).first()[0] == ["0997 Haus", "1534-", "1 Bild 1", "12 Raum 2"]


def test_json(spark):
    broken = '```json\n{"relationships": [{"subject": "A", "object": "B"}, {"subject": "C", "obj'
    kind = "struct<subject:string,object:string>"
    got = one(spark, lambda t: json_repair.parsed(t, kind, "relationships"), broken, '{"relationships": [{"subject": "A"')
    assert [r.subject for r in got[0]][:1] == ["A"] and [r.subject for r in got[1]] == ["A"]
    assert json_repair.repair('{"a": ["x') == '{"a": ["x"]}' and json_repair.repair('{"a": [1, ') == '{"a": [1]}'
    assert json_repair.salvage('{"r": [{"a": 1}, {"b": {"c": 2}}, {"d"') == ['{"a": 1}', '{"b": {"c": 2}}']


def test_pages(spark):
    docs = spark.createDataFrame([(1, "lost [[PAGE 1]] eins [[page 2]] zwei [[PAGE 1]] neu"), (2, " ohne ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in segment.split_pages(docs).collect()) == [(1, 1, "neu"), (1, 2, "zwei"), (2, 1, "ohne")]
    chunks = segment.chunks(spark.createDataFrame([(1, "x" * 8000), (2, "y" * 8001), (3, "")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.start, len(r.chunk)) for r in chunks.collect()) == [(1, 0, 8000), (2, 0, 8000), (2, 7500, 501), (3, 0, 0)]


def test_iob(spark):
    text = "x\nTOKEN\tNE-COARSE-LIT\tMISC\n# document_id = d1\nHans\tB-pers\t_\nMuster\tI-pers\tEndOfSentence\n\nin\tO\t_\nRom\tB-loc\t_\n"
    got = readers.iob_sentences(spark.createDataFrame([("p", text)], "path string, text string")).orderBy("sentence_no").collect()
    assert [(r.document_id, r.tokens, r.ner_tags) for r in got] == [("d1", ["Hans", "Muster"], ["B-PER", "I-PER"]), ("d1", ["in", "Rom"], ["O", "B-LOC"])]
    assert readers.settings("a:\n  b: 1\n  c: [x, 2]\n", ["a.b=3"]) == {"a": {"b": 3, "c": ["x", 2]}}


def test_relations(spark):
    rel = spark.createDataFrame(
        [(1, 0, "Altar", "visual_item", "has_author", "Dick", "person", "e"), (1, 1, "Dick", "person", "painted", "Altar", "visual_item", "f"), (1, 2, "dick", "person", "created", "altar", "visual_item", "g")],
        "doc_id long, n int, subject string, subject_type string, relation_type string, object string, object_type string, evidence string",
    )
    turned = relations.deduplicated(relations.inverted(rel), ["n"])
    entities = spark.createDataFrame([(1, "dates", "Altar"), (1, "places", "altar")], "doc_id long, category string, name string")
    out = {r.n: r for r in relations.aligned(relations.validated(relations.resolved(turned, entities))).collect()}
    assert set(out) == {0, 1} and out[0].subject == "Dick" and out[0].object_type == "place"
    assert out[0].coverage == "db+cidoc" and out[0].db_schema_match == ["is_designer_of_building", "has_designer"] and out[1].coverage == "novel" and out[0].valid and out[1].valid


def test_scores(spark):
    gold = spark.createDataFrame([(1, "persons", "A"), (1, "places", "der Ort")], "doc_id long, category string, name string")
    pred = spark.createDataFrame([(1, "persons", "a"), (1, "places", "Ort")], "doc_id long, category string, name string")
    for view, tp in (("strict", 1), ("relaxed", 2)):
        scores = scoring.entity_scores(gold, pred, view)
        assert scores.count() == 7
        total = scoring.totals(scores, ["doc_id"]).first()
        assert total.tp == tp and abs(total.macro_f1 - tp / 7) < 1e-9
    review = spark.createDataFrame([("2", "", "1"), ("", "x", "")], "n_predicted string, n_wrong string, n_missed string")
    assert mentions.review_scores(review).first().recall == pytest.approx(2 / 3)


def test_limiter(spark):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, i, t0 + datetime.timedelta(minutes=i)) for i in range(12)] + [(1, 12, t0 + datetime.timedelta(hours=1))]
    got = {r.event_id: r.allowed for r in limiter.limited(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")).collect()}
    assert [got[i] for i in range(13)] == [True] * 10 + [False, False, True]


WIDE = f"volume string, page string, width int, images array<struct<x0:int,y0:int,x1:int,y1:int>>, region string, region_idx int, line_idx int, line_id string, x0 int, y0 int, x1 int, y1 int, words {layout.WORDS}"


def test_lines_without_confidence_stay(spark):
    words = [("Kirche", None, 100, 100, 300, 140), ("Fid", None, 320, 100, 400, 140), (".", None, 420, 130, 430, 140)]
    lines = spark.createDataFrame([("v", "p", 2500, [], "r", 0, 0, "l", 100, 100, 430, 140, words)], WIDE)
    kept = layout.without_stray_words(layout.noise(layout.features(lines))).first()
    assert kept.drop_reason is None and kept.text == "Kirche Fid ."


def test_split_lines_keep_their_outer_boxes(spark):
    words = [("links", 0.9, 110, 105, 500, 140), ("hier", 0.9, 520, 105, 800, 140), ("rechts", 0.9, 1400, 108, 1800, 140), ("dort", 0.9, 1820, 108, 2300, 140)]
    lines = spark.createDataFrame([("v", "p", 2500, [], "r", 0, 0, "l", 100, 100, 2350, 150, words)], WIDE)
    out = layout.split_columns(layout.noise(layout.features(lines))).orderBy("line_idx").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.line_id) for r in out] == [(100, 100, 800, 150, "l_c1"), (1400, 100, 2350, 150, "l_c2")]


@pytest.mark.parametrize("name", "split_halves page_folios paragraph_runs line_strata footnote_blocks titled_paragraphs stray_words noise_reasons line_lookup".split())
def test_lines_are_shuffled_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == (2 if name == "split_halves" else 1) and "SortMergeJoin" not in plan  # those two are the same one
    assert not any("Sort [" in x and "words" in x for x in plan.splitlines())


def test_units_without_a_window_of_texts_by_volume(spark):
    texts = ["one", "two.", "three", "Title", "four", "five,", "six"]
    rows = [(v, n // 3, n % 3, "title" if t == "Title" else "body", t) for v in ("a", None) for n, t in enumerate(texts)]
    paras = spark.createDataFrame(rows, "volume string, page int, para_idx int, stratum string, text string")
    out = layout.joined_body(paras)
    want = [("one two.", 0), ("three", 0), ("four five, six", 1)]
    assert sorted((r.volume or "", r.unit, r.text, r.page) for r in out.collect()) == sorted((v, i + 1, t, p) for v in ("a", "") for i, (t, p) in enumerate(want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in x and "[volume#" in x.split("windowspecdefinition(")[1].split("ASC")[0] for x in plan.splitlines() if "windowspecdefinition(" in x)


def test_terms_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(1, "b a b a_1 B ccc"), (2, ""), (3, None), (4, "aa " * 5000), (1, "ccc")], "doc_id long, text string")
    assert [tuple(r) for r in docs.filter("doc_id = 4").select(stats.counted(stats.terms_in(F.col("text"))).alias("c")).first().c] == [("aa", 5000)]
    got = {(r.doc_id, r.term): r.weight for r in stats.tfidf(docs).collect()}
    assert set(got) == {(1, "a_1"), (1, "ccc"), (4, "aa")} and got[4, "aa"] == 1
    assert stats.tfidf(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("make, trims", [(T.recased, 2), (T.clean_ocr, 0)])
def test_expressions_are_not_copied(spark, make, trims):
    plan = spark.range(1).select(F.col("id").cast("string").alias("text")).select(make(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("btrim(") <= trims and plan.count("regexp_replace(text") + plan.count("split(text") + plan.count("split(cast") <= 2


def test_recased_tokens(spark):
    text = "(DER) VON, DER-ALTAR |UB| UB III. A, «ST.-GALLEN» x ÉGLISE! '' "
    assert one(spark, T.recased, text, "", "VON DER") == ["(Der) von, Der-Altar |UB| UB III. A, «St.-Gallen» x Église! '' ", "", "Von der"]


def test_spelled_long_and_short(spark):
    words = ["abcdefghijklmnop", "abcdefghijklm", "kirche", "kirchen", "ab", "xyzabcdefghijkl"]
    terms = ["abXdefghijklmnopq", "abcdefghijk", "bcdefghijklmX", "kirhe", "xkirchenx", "a", "yzabcdefgXhijkl", "nothing", "abcdefghijklmn"]
    lexicon = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    out = stats.spelled(spark.createDataFrame([(t,) for t in terms], "term string"), lexicon)
    brute = spark.createDataFrame([(t,) for t in terms], "term string").crossJoin(lexicon).withColumn("d", F.levenshtein("term", "word")).filter("d <= 2")
    want = {r.term: r.b.word for r in brute.groupBy("term").agg(F.min(F.struct("d", (-F.col("n")).alias("m"), "word")).alias("b")).collect()}
    assert {r.term: r.corrected for r in out.collect()} == {t: want.get(t) for t in terms}


def test_previews_pass_over_stretches(spark):
    texts = ["x" * 300 + "1999" + "y" * 300 + "12 z" + "w" * 90 + "21066 1534\n" + "v" * 50, "a\r1999 b", "none", "12" + "q" * 81 + "1500"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.n): r.preview for r in segment.regex_preview(docs, "[12][0-9]{3}", never="[^0-9]").collect()}
    want = {(i, n): m for i, t in enumerate(texts) for n, m in enumerate(re.findall(".{0,40}(?:[12][0-9]{3}).{0,40}", t.replace("\n", " ")))}
    assert got == want


def test_markers(spark):
    texts = ["Stadt' und", "a) Kirche*, (Chor) Bild) neu", "«Farna»1 ruht? vollendet?,", "1707 Haus12 Haus1\nWort]. !", "(auf Seite 3) b3) «x"]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page int, text string")
    got = sorted((r.page, r.start, r.end, r.cluster) for r in layout.find_markers(pages).collect())
    assert got == [(0, 5, 6, "'"), (1, 9, 10, "*"), (1, 23, 24, ")"), (2, 7, 8, "1"), (2, 24, 25, "?"), (3, 16, 17, "1"), (3, 22, 23, "]"), (4, 15, 17, "3)")]


def test_two_volumes_stay_apart(spark):
    rows = [(v, f"{v}/{p}", 0, "body", "r", [t], ["l"], [(0, t, "l", 0, 0, 9)]) for v, p, t in (("a", 1, "ein Wort voll-"), ("a", 2, "endet hier."), ("b", 1, "anders voll-"), ("b", 2, "kommen und"))]
    paras = spark.createDataFrame(rows, "volume string, page string, para_idx int, stratum string, region string, lines array<string>, line_ids array<string>, all array<struct<line_idx:int,text:string,line_id:string,x0:int,x1:int,width:int>>")
    got = {(r.volume, r.text) for r in layout.joined_body(layout.reflowed(paras)).collect()}
    assert got == {("a", "ein Wort vollendet hier."), ("b", "anders vollkommen und")}
    lines = spark.createDataFrame([("a/1", 0, "neu"), ("a/2", 0, "x"), ("a/2", 1, "y"), ("b/1", 0, "neu")], "page string, line_no int, text string")
    out = {r.page: (r.text, r.error) for r in layout.aligned_lines(paras.select("page", "para_idx", F.col("lines")[0].alias("text")), lines).collect()}
    assert out == {"a/1": ("neu", None), "a/2": ("endet hier.", "1 paragraphs, 2 lines"), "b/1": ("neu", None), "b/2": ("kommen und", "1 paragraphs, 0 lines")}


def test_limiter_in_a_stream(spark, tmp_path):
    import datetime
    import time

    t0 = datetime.datetime(2024, 1, 1)
    rows = [(k, 100 * k + i, t0 + datetime.timedelta(minutes=i * (k + 1))) for k in (1, 2) for i in range(40)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = limiter.limit_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    for _ in range(120):
        if spark.table("limited").count() == len(rows) or query.exception():
            break
        time.sleep(0.5)
    query.stop()
    got = {tuple(r) for r in spark.table("limited").collect()}
    assert got == {tuple(r) for r in limiter.limited(events).select("user_id", "event_id", "ts", "allowed").collect()} and len(got) == 80


def test_layout(spark):
    def line(i, text, y, h=40, conf=0.95, x0=100, region="r1", region_idx=0):
        words, x = [], x0
        for w in text.split():
            words.append((w, conf, x, y, x + 30 * len(w), y + h))
            x += 30 * len(w) + 15
        return ("v1", "0001", 2500, [], region, region_idx, i, f"l{i}", x0, y, x, y + h, words)

    rows = [line(0, "10 Kirche", 10, region="h"), line(1, "Das Werk wurde von dem alten Meister der Stadt' voll-", 100, region_idx=1), line(2, "endet und in der Kirche zu St. Fiden neu aufgestellt", 165, region_idx=1),
            line(3, "mit allen Figuren und mit dem grossen Bild im Chor.", 230, region_idx=1), line(4, "§", 290, conf=0.2, region_idx=1), line(5, "1 Vad. I, S. 365.", 340, h=25, region="f", region_idx=2)]
    schema = f"volume string, page string, width int, images array<struct<x0:int,y0:int,x1:int,y1:int>>, region string, region_idx int, line_idx int, line_id string, x0 int, y0 int, x1 int, y1 int, words {layout.WORDS}"
    from quire.plans.documents import volume

    out = volume(spark.createDataFrame(rows, schema))
    assert [r.status for r in out["footnotes"].collect()] == ["applied"]
    assert out["body"].first().text.startswith("Das Werk wurde von dem alten Meister der Stadt¹ vollendet und")
    assert [r.text for r in out["notes"].collect()] == ["1 Vad. I, S. 365."]
    chars = spark.createDataFrame([("p", i, c) for i, c in enumerate("a) (b) c)")], "page string, pos int, ch string")
    assert [r.pos for r in layout.real_closers(chars, "(", ")").collect()] == [5]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("1", "a\nb", "a\nc")], "page string, before string, after string")
    assert "-b\n+c" in sinks.unified_diff(pages).first().diff
    sinks.csv_with_bom(spark.range(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    words = spark.createDataFrame([("kirche", 9), ("altar", 5)], "word string, n int")
    terms = spark.createDataFrame([("kirhce",), ("xyz",)], "term string")
    assert {r.term: r.corrected for r in stats.spelled(terms, words).collect()} == {"kirhce": "kirche", "xyz": None}


def same(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_catalog(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.SQL:
        return
    con = duckdb.connect()
    for t in ("documents", "events", "lineitem", "orders", "customer", "part", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(same(r[c]) for c in names) for r in rows), key=repr) == sorted((tuple(map(same, r)) for r in found.fetchall()), key=repr)


def test_page_xml_and_token_files(spark, tmp_path):
    from quire.sources import readers

    word = lambda t, x, c: f'<Word id="w{x}"><Coords points="{x},10 {x + 40},10 {x + 40},30 {x},30"/><TextEquiv conf="{c}"><Unicode>{t}</Unicode></TextEquiv></Word>'
    line = lambda n, inner: f'<TextLine id="l{n}"><Coords points="0,{n} 90,{n + 20}"/>{inner}</TextLine>'
    body = line(1, word("Die", 0, 0.9) + word(" ", 45, 0.1) + word("Kirche", 50, 0.8)) + line(2, "<TextEquiv><Unicode>own text</Unicode></TextEquiv>")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "p_0012.xml").write_text(
        '<?xml version="1.0"?><PcGts xmlns="http://example.org/p"><Page imageFilename="a.png" imageWidth="100" imageHeight="200">'
        f'<ImageRegion id="i"><Coords points="5,6 7,9"/></ImageRegion><TextRegion id="r0"/><TextRegion id="r1">{body}</TextRegion></Page></PcGts>'
    )
    got = readers.page_xml(spark, str(tmp_path / "x")).orderBy("line_idx").collect()
    assert [(r.page, r.width, r.height, r.region, r.line_idx, r.line_id, r.plain) for r in got] == [("0012", 100, 200, "r1", 0, "l1", "Die Kirche"), ("0012", 100, 200, "r1", 1, "l2", "own text")]
    assert [(w.text, w.conf, w.x0, w.y1) for w in got[0].words] == [("Die", 0.9, 0, 30), ("Kirche", 0.8, 50, 30)] and [tuple(b) for b in got[0].images] == [(5, 6, 7, 9)]
    assert [r.text for r in readers.plain_lines(readers.page_xml(spark, str(tmp_path / "x"))).orderBy("line_idx").collect()] == ["Die Kirche", "own text"]

    (tmp_path / "t" / "v2").mkdir(parents=True)
    for name in ("HIPE-2022-v2.1-one-train-de.tsv", "HIPE-2022-v2.1-one-dev-de.tsv", "other.tsv"):
        (tmp_path / "t" / "v2" / name).write_text("TOKEN\tNE-COARSE-LIT\n")
    wanted = spark.createDataFrame([("one", "train", "de"), ("one", "test", "de")], "dataset string, split string, lang string")
    found = {r.split: r.path for r in readers.iob_files(spark, str(tmp_path / "t"), wanted).collect()}
    assert found["train"].endswith("HIPE-2022-v2.1-one-train-de.tsv") and found["test"] is None

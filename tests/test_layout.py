import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from inkstrata.layout import abbreviations, bidi, metadata, pages
from inkstrata.layout.config import Thresholds, config_table
from inkstrata.sources import extracts, sinks, workbook

SCHEMA = "doc_id string, page string, row_no bigint, left double, top double, width double, height double, conf double, text string"


def page(doc, name, paragraphs):
    """paragraphs: (top, height, lines of words); structural rows before each."""
    out, n = [], 0
    for top, height, lines in paragraphs:
        for _ in range(3):
            out.append((doc, name, n, 100.0, float(top), 900.0, 30.0, -1.0, None))
            n += 1
        for k, line in enumerate(lines):
            for j, word in enumerate(line.split(" ")):
                out.append((doc, name, n, 100.0 + 60 * j, float(top + 30 * k), 50.0, float(height), 95.0, word))
                n += 1
    return out


def test_main_text_and_footnotes(spark):
    data = page("d", "p01", [(100, 30, ["aa nn oo", "ss uu cc"]), (300, 30, ["mm nn", "rr ss vv"]), (1500, 20, ["1 ooo", "sss aaa"])])
    main, notes = pages.extract(spark.createDataFrame(data, SCHEMA), Thresholds())
    assert [r["content"] for r in main.collect()] == ["aa nn oo | ss uu cc\n\nmm nn | rr ss vv"]
    assert [(r["page"], r["number"], r["text"]) for r in notes.collect()] == [("p01", 1, "1 ooo sss aaa")]


def test_footnote_goes_on(spark):
    t = Thresholds(bottom_margin_max=1850.0)
    body = lambda: [(100, 30, ["aa nn oo", "ss uu cc"]), (300, 30, ["mm nn", "rr ss vv"])]
    data = page("d", "p01", [*body(), (1700, 20, ["1 ooo sss"])]) + page("d", "p02", [*body(), (1500, 20, ["aaa mmm vvv"])])
    _, notes = pages.extract(spark.createDataFrame(data, SCHEMA), t)
    assert [(r["page"], r["text"]) for r in notes.collect()] == [("p01", "1 ooo sssaaa mmm vvv")]


def test_first_line_decides_whether_a_footnote_goes_on(spark):
    body = [(100, 30, ["aa nn oo", "ss uu cc"]), (300, 30, ["mm nn", "rr ss vv"])]
    data = page("d", "p01", [*body, (1700, 20, ["1 ooo sss"])]) + page("d", "p02", [*body, (1500, 20, ["aaa mmm vvv"])])
    df = spark.createDataFrame(data, SCHEMA)
    stats = spark.createDataFrame([("d", "p02", 2)], "doc_id string, page string, para_no long").withColumn("is_footnote", F.lit(True))
    paragraphs = df.withColumn("para_no", F.lit(2).cast("long")).where("page = 'p02'")
    left = lambda x: pages.first_line_left(x, stats).first()["first_left"]
    assert left(paragraphs) == 0.0
    rows = [("d", "p02", i, 2, 100.0 * (i + 1), c) for i, c in enumerate([90.0, 90.0, 90.0, -1.0, 90.0])]
    assert left(spark.createDataFrame(rows, "doc_id string, page string, row_no long, para_no long, left double, conf double")) == 500.0
    for total, texts in ((480.0, ["1 ooo sssaaa mmm vvv"]), (479.0, ["1 ooo sss", "aaa mmm vvv"])):
        _, notes = pages.extract(df, Thresholds(bottom_margin_max=1850.0, total_left=total))
        assert [r["text"] for r in notes.orderBy("number").collect()] == texts


def test_validation(spark):
    df = spark.createDataFrame([("d", "p1", 0, "x", "1", "2", "3", "-1", None)], SCHEMA.replace("double", "string"))
    assert pages.validated(df).count() == 0
    try:
        pages.validated(df.drop("conf"))
        raise AssertionError("no error")
    except ValueError as e:
        assert "conf" in str(e)


def test_bidi():
    assert bidi.typeset(["abc", "def"]) == "abc def"
    assert bidi.typeset(["עולם", "שלום"]) == "שלום עולם"
    assert bidi.typeset(["עולם", "New", "York", "שלום"]) == "שלום New York עולם"
    assert bidi.reverse_inside_blanks(" ab ") == " ba " and bidi.reverse_digit_runs("a12b") == "a21b"


def test_abbreviations(spark):
    df = spark.createDataFrame([("d", 1, 0.0, "AB = Alpha"), ("d", 2, 30.0, "Beta"), ("d", 3, 0.0, "nothing")], "doc_id string, n int, indent double, text string")
    out = abbreviations.assembled(df, ["doc_id"], ["n"], F.col("indent"), 20.0, "text").orderBy("entry_no").collect()
    assert [(r["label"], r["info"]) for r in out] == [("AB", "Alpha Beta"), ("unknown", "nothing")]
    bins = spark.range(1).select(abbreviations.tolerance_bins(F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), 1.5).alias("b")).first()["b"]
    assert [(b["start"], b["n"]) for b in bins] == [(1.0, 2), (9.0, 1)]
    notes = spark.createDataFrame([("AB = Alpha",), ("plain text",)], "text string")
    yes, no = abbreviations.partitioned(notes, spark.createDataFrame([("ab",)], "label string"))
    assert (yes.count(), no.count()) == (1, 1)


def test_state_machines(spark):
    rows = spark.createDataFrame([("d", "p1", 1, "Title", 12.0), ("d", "p1", 2, "1. first", 9.0), ("d", "p2", 1, "goes on", 9.0), ("d", "p2", 2, "2. second", 9.0), ("d", "p2", 3, "Body", 12.0)], "doc_id string, page string, row_no int, text string, font_size double")
    out = abbreviations.collected_references(rows, "END").orderBy("number").collect()
    assert [(r["page"], r["content"]) for r in out] == [("p1", "1. first goes on"), ("p2", "2. second")]
    words = spark.createDataFrame([("d", "p", 1, 10.0, 5.0, 1, 1), ("d", "p", 2, 12.0, 5.0, 1, 1), ("d", "p", 3, 40.0, 5.0, 2, 1)], "doc_id string, page string, row_no bigint, top double, height double, block_num int, par_num int")
    assert [r["line_no"] for r in abbreviations.banded_lines(words).orderBy("row_no").collect()] == [0, 0, 1]


def test_config_aliases(spark):
    rows = config_table(spark, {("sibra", "printed"): Thresholds()}).collect()
    assert {r["journal"] for r in rows} == {"sibra", "sidra"}
    full = {(r["journal"], r["mode"]): r for r in config_table(spark).collect()}
    assert len(full) == 16 and full["sidra", "printed"]["total_left"] == 7200
    notes = spark.createDataFrame([("* תודתי לכל",), ("see above",)], "t string")
    from inkstrata.functions import text

    assert [r[0] for r in notes.select(text.is_acknowledgement(F.col("t"))).collect()] == [True, False]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "conf")}{cell("B1", "text")}</row><row r="2">{cell("A2", "90")}{cell("B2", "word")}</row></sheetData></worksheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="p00" r:id="a"/><sheet name="p01" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", sheet)
    (tmp_path / "doc7.xlsx").write_bytes(buf.getvalue())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = {r["doc_id"]: r for r in workbook.read_workbooks(spark, str(tmp_path)).collect()}
    assert (rows["doc7"]["page"], rows["doc7"]["conf"], rows["doc7"]["text"]) == ("p01", "90", "word")
    assert rows["bad"]["error"].startswith("BadZipFile")


def test_metadata_and_report(spark, tmp_path):
    (tmp_path / "a1.json").write_text(json.dumps({"content": {"isPageScan": True, "references": {"number_of_references": 3, "reference_blocks": [{"reference_content": [{"label": "2"}, {"label": "x"}]}]}}}))
    (tmp_path / "b2.json").write_text("skipped: no article")
    meta = extracts.read_metadata(spark, str(tmp_path))
    counts = {r["doc_id"]: (r[1], r[2]) for r in extracts.reference_counts(meta).collect()}
    assert counts == {"a1": (3, 2), "b2": (0, 0)}
    assert {r["doc_id"]: r[1] for r in extracts.is_page_scan(meta).collect()} == {"a1": True, "b2": False}
    files = meta.select("doc_id", "skipped")
    got = spark.createDataFrame([("a1", 3)], "doc_id string, n_footnotes int")
    report = sinks.processing_report(files, extracts.reference_counts(meta), got)
    assert {r["Filename"]: r["Processing_Status"] for r in report.collect()} == {"a1": "Completed", "b2": "Skipped"}


def test_extract_round_trip_and_load(spark, tmp_path):
    main = spark.createDataFrame([("d", "p01", "body, \"q\"")], "doc_id string, page string, content string")
    notes = spark.createDataFrame([("d", "p01", 1, "note")], "doc_id string, page string, number int, text string")
    sinks.write_extract_csv(main, notes, str(tmp_path / "csv"))
    back = extracts.read_extract_csv(spark, str(tmp_path / "csv/doc_id=d")).collect()
    assert [(r["type"], r["content"]) for r in back] == [("maintext", 'body, "q"'), ("footnote", "note")]
    sinks.write_extract_xml(main, notes, str(tmp_path / "xml"))
    page_row = extracts.read_extract_xml(spark, str(tmp_path / "xml")).first()
    assert page_row["page"] == "p01" and page_row["footnotes"][0]["_VALUE"] == "note"
    rows = spark.createDataFrame([(1, "p01", "x"), (1, "p01", "y")], "issue_id int, page_name string, content string")
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "corpus"), "main_texts", ["content"])
    assert spark.read.parquet(str(tmp_path / "corpus/main_texts")).count() == 1


def test_arrival_stream(spark, tmp_path):
    from inkstrata.streaming.arrivals import load_arrivals

    schema = "issue_id int, page_name string, content string"
    spark.createDataFrame([(1, "p01", "x")], schema).write.parquet(str(tmp_path / "in"))
    for run in range(2):
        load_arrivals(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), "main_texts", ["content"], str(tmp_path / f"cp{run}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/main_texts")).count() == 1


def test_blocks_with_a_parser(spark, tmp_path):
    from inkstrata.sources import blocks

    (tmp_path / "a.pdf").write_bytes(b"one\x01\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"\xff")

    def parse(data):
        for i, line in enumerate(data.decode().split("\n"), 1):
            yield {"page": i, "text": line}

    df = blocks.read_blocks(spark, str(tmp_path), parse)
    assert {(r["doc_id"], r["page"], r["text"]) for r in df.where("error is null").collect()} == {("a", 1, "one"), ("a", 2, "two")}
    assert df.where("error is not null").first()["doc_id"] == "b"
    assert blocks.page_counts(df).first()["n_pages"] == 2


def test_documents_of_xml_and_csv(spark, tmp_path):
    main = spark.createDataFrame([("d", "p02", "zwei"), ("d", "p01", "eins‏ & <b>"), ("e", "p01", "other")], "doc_id string, page string, content string")
    notes = spark.createDataFrame([("d", "p02", 1, "second"), ("d", "p01", 2, "first"), ("d", "p03", 3, "alone")], "doc_id string, page string, number int, text string")
    xml = {r["doc_id"]: ElementTree.fromstring(r["value"].encode()) for r in sinks.extract_xml(main, notes).collect()}
    pages = [(p.get("name"), p.findtext("MainText"), [(n.get("number"), n.get("page"), n.text) for n in p.findall("footnote")]) for p in xml["d"].findall("Page")]
    assert pages == [("p01", "eins & <b>", [("1", "p01", "first")]), ("p02", "zwei", [("2", "p02", "second")]), ("p03", None, [("3", "p03", "alone")])]
    assert [p.get("name") for p in xml["e"]] == ["p01"] and xml["e"].tag == "footnotes"
    sinks.write_extract_csv(main, notes, str(tmp_path / "csv"))
    data = next((tmp_path / "csv/doc_id=d").glob("part-*")).read_bytes().decode()
    assert data.split("\n")[0] == "﻿Type,Page,Number,Content" and data.split("\n")[1].startswith("MainText,p01")
    abbreviations = spark.createDataFrame([("d", None, "AB", "Alpha", "metadata"), ("d", "p01", "C“D", "Gamma", "ocr")], "doc_id string, page string, label string, info string, source string")
    doc = ElementTree.fromstring(next(r["value"] for r in sinks.integrated_xml(main, notes, abbreviations).collect() if r["doc_id"] == "d").encode())
    assert [x.tag for x in doc] == ["main_text", "footnotes", "abbreviations"] and [x.get("number") for x in doc[1]] == ["1", "2", "3"]
    assert {(x.get("label"), x.get("source"), x.text) for x in doc[2]} == {("AB", "metadata", "Alpha"), ("C“D", "ocr", "Gamma")}
    sinks.write_integrated(main, notes, abbreviations, str(tmp_path / "both"))
    rows = next((tmp_path / "both/csv/doc_id=d").glob("part-*")).read_text(encoding="utf-8").rstrip("\n").split("\n")
    assert rows[0] == "﻿Type,Page,Number,Label,Content,Source" and [r.split(",")[0] for r in rows[1:]] == ["MainText"] * 2 + ["Footnote"] * 3 + ["Abbreviation"] * 2
    files = spark.createDataFrame([("d", "d.pdf", "http://x", "zion")], "doc_id string, file string, url string, journal string")
    paper = ElementTree.fromstring(sinks.abbreviation_xml(abbreviations.withColumn("entry_no", F.monotonically_increasing_id()), files).first()["value"].encode())
    assert paper.get("file") == "d.pdf" and {x.get("label") for x in paper[0]} == {"AB", 'C"D'}


def test_reports_and_separators(spark, tmp_path):
    rows = [("7", "a7", 10, 9, 9, True, "Completed", "100.0%", False), ("8", "b8", 0, 0, 0, True, "Skipped", "", False)]
    report = spark.createDataFrame(rows, "Issue_Number string, Filename string, Meta_References_Count int, Meta_biggest_label_number int, Collected_Footnotes_Count int, Has_Meta_File boolean, Processing_Status string, Accuracy_Percentage string, Is_Different boolean")
    for kind, skipped, lines in (("plain", False, 2), ("accuracy", True, 3), ("differences", True, 3)):
        sinks.write_report(report, str(tmp_path / kind), kind, skipped)
        data = next((tmp_path / kind).glob("part-*")).read_text(encoding="utf-8").rstrip("\n").split("\n")
        assert len(data) == lines and len(data[0].split(",")) == len(sinks.REPORTS[kind])
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    names = spark.range(1).select(sinks.report_name("zion", "plain"), sinks.report_name("zion", "accuracy", at)).first()
    assert tuple(names) == ("zion_processing_report.csv", "zion_processing_report_20240506_070809.csv")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("﻿Type,Page,Number,Content\nfootnote,p1,1,\"a, b\"\n", encoding="utf-8")
    (tmp_path / "in/b.csv").write_text("TYPE\tPAGE\tCONTENT\nMainText\tp2\tc, d\nMainText\tp3\n", encoding="utf-8")
    back = {(r["type"], r["page"], r["content"]) for r in extracts.read_extract_csv(spark, str(tmp_path / "in")).collect()}
    assert back == {("footnote", "p1", "a, b"), ("maintext", "p2", "c, d")}
    votes = spark.createDataFrame([(1, 4), (2, 2), (3, 0)], "id int, anomaly_votes int")
    sinks.write_votes(votes, str(tmp_path / "votes"))
    assert [spark.read.csv(str(tmp_path / "votes" / n), header=True).count() for n in ("all", "unanimous", "anomalies")] == [3, 1, 2]


def test_paper_metadata(spark):
    titles = {
        "עיון בתלמוד / A Study": ("עיון בתלמוד", "A Study"), "A Study / עיון בתלמוד": ("עיון בתלמוד", "A Study"), "A Study - Part Two - עיון": ("עיון", "A Study - Part Two"),
        "רק עברית": ("רק עברית", ""), "Only English": ("", "Only English"), "Studies/ עיון בתלמוד": ("עיון בתלמוד", "Studies"), "abc עיון": ("abc עיון", ""),
        "A Study: המשך הכותרת / עיון": ("עיון: המשך הכותרת", "A Study"),
    }
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", *metadata.split_title(metadata.clean_title(F.col("t")))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == titles
    no = ["Front Matter", "Review of books", "English Summaries", "[ללא כותרת]", "שער קדמי", "תקצירים באנגלית", "ספרים שנתקבלו במערכת", "הערת המערכת"]
    yes = ["A Review", "עיון בתלמוד", "הקדמה לספר"]
    t = metadata.clean_title(F.col("t"))
    out = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in no + yes], "t string").select("t", metadata.not_an_article(t, *metadata.split_title(t))).collect()}
    assert [x for x in out if out[x]] == no
    kinds = {"": None, "הקיצורים": metadata.ABBREVIATIONS, "רשימת מקורות": metadata.BIBLIOGRAPHY, "קיצורים ומקורות": metadata.ABBREVIATIONS, "[Footnotes]": None, "[אחר]": "אחר"}
    out = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in kinds], "t string").select("t", metadata.reference_kind(F.col("t"))).collect()}
    assert out == kinds
    labels = {"אב\"ג = ספר": 'אבג', "word and more": "word", "a": "", "x, y": "", "כ\"י לונדון—British": "כי לונדון"}
    out = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in labels], "t string").select("t", metadata.label_of(F.col("t"))).collect()}
    assert out == labels
    pages = {"pp. 7-19": ("7", "19"), "PP. 7–9": ("7", "9"), "p. 12": ("12", "12"), "odd": ("odd", "odd")}
    out = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(x,) for x in pages], "t string").select("t", *metadata.page_range(F.col("t"))).collect()}
    assert out == pages
    row = spark.createDataFrame([(["a", "b", "c"], ["x  y [illegible text]"], "Vol. 12 (3)", "חוברת ד")], "a array<string>, s array<string>, v string, i string")
    got = row.select(*metadata.authors_in(F.col("a")), metadata.abstract(F.col("s")), metadata.volume(F.col("v")), metadata.issue(F.col("i"))).first()
    assert tuple(got) == ("a", "b, c", "x y `", "12", "ד")
    assert [r[0] for r in spark.createDataFrame([("מקורות",), ("א. כתבי יד",), ("מאמר",)], "t string").select(metadata.is_subtype(F.col("t"))).collect()] == [True, True, False]


def test_words_are_not_dealt_again_by_paragraph(spark):
    from inkstrata.plans.queries import layout_main_text

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = layout_main_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    # lines, which have passed through Python, are dealt once more, words are not
    assert dealt and sum("para_no" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt) <= 1
    # numbers are not read from their texts
    assert "try_cast" not in plan.lower() and "as string) as double" not in plan.lower()


def exchanges(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    return plan, [x for x in plan.splitlines() if "Exchange" in x]


def test_paragraphs_are_dealt_once_and_their_words_not(spark):
    """the words of a document's pages were dealt out three times; now only figures of paragraphs are."""
    from inkstrata.plans.queries import layout_footnotes, layout_paragraphs

    for query in (layout_footnotes, layout_paragraphs):
        plan, dealt = exchanges(query(spark, "/root/testdata/sf0.001"))
        assert len(dealt) == 1
        above = plan[: plan.index(dealt[0])]
        assert "SortMergeJoin" not in plan and not re.search(r"\b(words|text|plain)#", above)


def test_main_text_is_dealt_once_as_text(spark):
    """words were dealt out for each use of the paragraphs; now a paragraph's text is, once."""
    from inkstrata.plans.queries import layout_main_text

    plan, dealt = exchanges(layout_main_text(spark, "/root/testdata/sf0.001"))
    assert len(dealt) == 1 and "SortMergeJoin" not in plan and not re.search(r"\b(words|text)#", plan[: plan.index(dealt[0])])


def test_text_of_a_paragraph_is_that_of_its_lines(spark):
    from inkstrata.operators import sequence

    texts = ["aa", "ספר", "(a)", "b‏c", "\n", "שלום", "12", " ", "x\ny", "", "z", None, " ", "ж", "ab", "בג"]
    rows = [(f"d{d}", "p1", p, (i * 7) % 48, 90.0 if (i + d) % 9 else -1.0, float((i + d) * 13 % 40), [None, 5.0, 5.0, 9.0][(i + p) % 4], texts[(i * (d + 1) + p) % 16]) for d in range(4) for p in range(3) for i in range(48)]
    rows += [("e", "p1", 0, 0, -1.0, 3.0, 1.0, "a"), ("e", "p1", 1, 0, 90.0, 99.0, 1.0, "low"), ("e", "p1", 2, 0, 90.0, None, 1.0, "nowhere")]
    df = spark.createDataFrame(rows, "doc_id string, page string, para_no long, row_no long, conf double, top double, left double, text string")
    rules, by = pages.Rules(line_gap=2.0), pages.PARA
    flat = df.where("top <= 30").withColumn("is_word", pages.is_word({c: F.col(c) for c in ("conf", "text")}))
    want = {tuple(r) for r in sequence.ordered_text(pages.lines(flat, by, rules), by, ["line_no"], "line", " | ").select(*by, "content").collect()}
    fields = F.struct("row_no", "conf", "top", "left", "text")
    got = df.groupBy(*by).agg(F.sort_array(F.collect_list(fields)).alias("words")).select(*by, pages.line_text(F.col("words"), 30.0, rules).alias("content"))
    assert len(want) == 12 and {tuple(r) for r in got.where("content is not null").collect()} == want

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plenum import cli
from plenum.errors import ExportError, IngestError, PlenumError, ReferenceError
from plenum.operators import clean, evaluate
from plenum.plans import analysis, brief, export
from plenum.sources import sinks, tables
from plenum.streaming import windows


def test_csv_keeps_text(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿id,comment\n001,\"two\nlines, NA\"\nNA,x\n".encode())
    report = tables.load_table(spark, path, preserve_text=True)
    rows = report.df.orderBy(tables.ORDER).collect()
    assert [(r["id"], r["comment"]) for r in rows] == [("001", "two\nlines, NA"), ("NA", "x")] and report.warnings == ()


def test_csv_encodings_caps_and_errors(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("comment\na – b\nc\nd\n".encode("cp1252"))
    report = tables.load_table(spark, path, row_cap=2, preserve_text=True)
    assert report.rows_omitted == 1 and len(report.warnings) == 2 and report.df.count() == 2
    assert report.df.where(F.col("comment") == "a – b").count() == 1
    (tmp_path / "e.csv").write_text("comment\n")
    with pytest.raises(IngestError):
        tables.load_table(spark, tmp_path / "e.csv")
    with pytest.raises(IngestError):
        tables.load_table(spark, tmp_path / "x.txt")


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>comment</t></si><si><t>hello</t></si></sst>")
        sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row><row><c r="B3"><v>8</v></c></row></sheetData></worksheet>'
        z.writestr("xl/worksheets/s1.xml", sheet)
        z.writestr("xl/worksheets/s2.xml", sheet.replace("<v>7</v>", "<v>9</v>"))


def test_xlsx(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    workbook(path)
    assert tables.list_sheets(path) == ["One", "Two"]
    rows = tables.load_table(spark, path, sheet_name="Two").df.orderBy(tables.ORDER).collect()
    assert [(r["comment"], r["n"]) for r in rows] == [("hello", "9"), ("", "8")]
    with pytest.raises(IngestError):
        tables.list_sheets(tmp_path / "x.csv")
    with pytest.raises(IngestError):
        tables.load_table(spark, path, sheet_name="Three")


def test_side_files(spark, tmp_path):
    good, bad = tmp_path / "r.json", tmp_path / "b.json"
    good.write_text('{"role": {"A": ".5", "B": "50%"}}')
    bad.write_text('{"role": {}, "role": {}}')
    assert tables.read_references(good, ["role"]) == {"subgroup__role": {"A": ".5", "B": "50%"}}
    for path, fields in ((bad, ["role"]), (good, ["ward"])):
        with pytest.raises(ReferenceError):
            tables.read_references(path, fields)
    with pytest.raises(IngestError):
        tables.read_side_text(good, 5)
    csv = tmp_path / "ref.csv"
    csv.write_text("group,share\n01,.5\nB,50%\n")
    assert tables.load_reference_csv(spark, csv) == [("01", ".5"), ("B", "50%")]


def test_zip_and_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("inner/data.csv", "a,b\n1,2\n")
    assert tables.read_zipped_csv(spark, tmp_path / "a.zip", tmp_path / "out", required={"a"}).count() == 1
    lines = [{"data": {"id": f"AG-1-{k}", "type": "comments", "attributes": {"docketId": "AG-1", "commentOnDocumentId": "AG-1-0001", "withdrawn": k == 2, "restrictReason": None, "comment": "<p>a &amp; b</p>", "postedDate": "2026-01-01"}}} for k in (1, 2)]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    got = tables.comment_records(spark.read.json(str(tmp_path / "r.json")), "AG-1-0001").collect()
    assert [(r["source_id"], r["comment_text"]) for r in got] == [("AG-1-1", "a & b")]


def test_export_and_manifest(spark, tmp_path):
    target = tmp_path / "out"
    sinks.export_json(target, {"a": {"x": 1}, "b": []})
    assert sinks.verify_manifest(target)
    with pytest.raises(ExportError):
        sinks.export_json(target, {})
    with pytest.raises(ExportError):
        sinks.export_json(tmp_path / "other", {"a": float("nan")})
    assert not (tmp_path / "other").exists()
    (target / "a.json").write_text("{}")
    assert not sinks.verify_manifest(target)
    df = spark.createDataFrame([("=1+1", -0.5), ("fine", 1.0)], "c string, n double")
    assert sinks.labelled_csv_bytes(df).decode("utf-8-sig").splitlines()[1] == "'=1+1,-0.5"
    assert sinks.script_json({"a": "</script>&"}) == '{"a": "\\u003c/script\\u003e\\u0026"}'
    assert sinks.blind_packet(df, ["n"]).columns == ["c", "answer", "reviewer", "notes"]


def test_labelled_export_refuses_raw_tables(spark):
    df = spark.createDataFrame([(0, "x", "id")], "row_position long, redacted_text string, respondent_id string")
    with pytest.raises(ExportError):
        export.labelled(df, assignments=df, themes=df, affect=df, question_counts=df, question_groups=df)


def test_whole_analysis(spark, folder):
    table = spark.read.parquet(f"{folder}/synthetic_theme_benchmark.parquet")
    mapped = clean.map_columns(table, comment="comment_text", order="row_id", period="hearing_date", respondent="respondent_id", subgroups=["role"])
    seen = []
    r = analysis.analyse(mapped, analysis.Options(progress=seen.append, response="We will fix the bus. The library opens on Sundays."))
    assert seen == list(analysis.STAGES)
    checks = evaluate.reconcile(comments=r.comments, assignments=r.assignments, affect=r.affect, volumes=r.volumes, periods=r.periods, gap_rows=r.gap_rows)
    # Rows without a letter have no theme, so volumes match assignments, and every other check holds.
    assert {c["check"]: c["passed"] for c in checks.collect()} == dict.fromkeys([c["check"] for c in checks.collect()], True)
    sources = {c["row_position"]: c["redacted_text"] for c in r.comments.select("row_position", "redacted_text").collect()}
    assert all(sources[q["row_position"]][q["source_start"] : q["source_end"]] == q["quote"] for q in r.quotes.collect())
    page = brief.build(themes=r.themes, quotes=r.quotes, affect=r.affect, periods=r.periods, mode=r.period_mode, gap_rows=r.gap_rows, top_questions=r.questions["top"])
    assert brief.to_markdown(page).startswith("# Community feedback brief")
    with zipfile.ZipFile(io.BytesIO(brief.docx_bytes(page))) as book:
        assert b"Community feedback brief" in book.read("word/document.xml")
    with pytest.raises(PlenumError):
        analysis.analyse(mapped, analysis.Options(grouping_distance=0))


def test_shorten():
    assert brief.shorten("One two. " * 10, 30).endswith("...") and len(brief.shorten("word " * 50, 40)) <= 40
    assert brief.shorten("a\x00b  c", 10) == "a b c"


def test_stream_equals_table(spark, tmp_path, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.daily_volume(windows.read_events(spark, str(tmp_path / "in"), events.schema))
    windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["window_start"], r["group"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window_start"], r["group"]): r["n"] for r in windows.daily_volume(events).collect()}
    # Windows that the watermark has not passed are still open.
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > len(want) * 0.8


def test_cli_tells_no_cells(spark, tmp_path, capsys):
    path = tmp_path / "in.csv"
    path.write_text("comment\nsecret value\n")
    assert cli.main([str(path), "--comment-column", "nope", "--output-dir", str(tmp_path / "o")]) == 1
    assert "secret" not in capsys.readouterr().err


def test_evaluation(spark):
    df = spark.createDataFrame([(True, True)] * 8 + [(True, False)] * 2 + [(False, True)] + [(False, False)] * 9, "t boolean, p boolean")
    r = evaluate.recall_and_false_positives(df, F.col("t"), F.col("p")).first()
    assert (r["recall"], r["false_positive_rate"], r["accepted"]) == (0.8, 0.1, False)
    a = evaluate.agreement(spark.createDataFrame([("x", "y"), (None, "x")], "t string, p string"), "t", "p").first()
    assert a["agreement"] == 0 and a["needs_work"]
    same = spark.createDataFrame([(k % 3, "abc"[k % 3]) for k in range(12)], "a long, b string")
    assert evaluate.adjusted_rand(same, "a", "b").first()["ari"] == 1
    ids = spark.range(100).withColumnRenamed("id", "k")
    one = [r["k"] for r in evaluate.hash_sample(ids, 10, key="k").collect()]
    assert one == [r["k"] for r in evaluate.hash_sample(ids.repartition(7), 10, key="k").collect()]
    assert {r["k"] for r in evaluate.systematic_sample(ids, 3, position="k").collect()} == {0, 50, 99}
    original = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    returned = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k long, v string")
    assert {(r["k"], r["reason"]) for r in evaluate.tampered(original, returned, "k", ["v"]).collect()} == {(2, "changed"), (3, "missing"), (4, "added")}


def test_encoding_is_decided_over_the_whole_file(tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"comment\n" + b"x" * (1 << 23) + "\né".encode("cp1252"))
    assert tables.encoding_of(path) == ("windows-1252", False)
    path.write_bytes(b"\xef\xbb\xbf" + ("é" * (1 << 22)).encode() + b"x")
    assert tables.encoding_of(path) == ("utf-8", True)
    path.write_bytes("é".encode()[:1])
    assert tables.encoding_of(path)[0] == "windows-1252"
    path.write_bytes(b"")
    assert tables.encoding_of(path) == ("utf-8", False)


def test_workbook_page_chart_and_pdf():
    data = sinks.workbook_bytes({"a & b": [["x", 1.5, None, "=A1"], ["<y>"]]})
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        sheet = book.read("xl/worksheets/s0.xml").decode()
    assert "<f>A1</f>" in sheet and "&lt;y&gt;" in sheet and "<v>1.5</v>" in sheet
    page = sinks.review_page("Review <1>", [{"t": "</script><b>"}])
    assert "</script><b>" not in page and "&lt;1&gt;" in page
    chart = sinks.line_chart({"all": [1.0, None, 2.0, 3.0]}, ["a", "b", "c", "d"], title="Tone")
    assert chart.count("<polyline") == 2 and sinks.line_chart({}, [], title="none").startswith("<svg")
    made = {"themes": [{"label": "A (b) \\ c", "count": 3, "share": 0.5, "quote": None}], "sentiment": {"scored": 0, "unscored": 1}, "change": None, "gaps": [], "questions": [{"text": "why?", "count": 2}] * 90}
    pdf = brief.pdf_bytes(made)
    assert pdf.count(b"/Type /Page ") >= 2 and b"A \\(b\\) \\\\ c" in pdf and pdf.endswith(b"%%EOF\n")
    start = int(pdf.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert pdf[start : start + 4] == b"xref"


def test_gap_workbook_hides_small_groups(spark):
    rows = spark.createDataFrame([("role", "A", 20, 0.8, 0.5, 30.0, 1.6, False), ("role", "B", None, None, 0.5, None, None, True)], "field string, group string, count long, participation_share double, reference_share double, gap_percentage_points double, representation_ratio double, suppressed boolean")
    with zipfile.ZipFile(io.BytesIO(sinks.gap_workbook(rows))) as book:
        sheet = book.read("xl/worksheets/s0.xml").decode()
    assert "<f>(D2-E2)*100</f>" in sheet and ">B<" not in sheet


def test_samples_corpora_and_limits(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("s"), F.lit("some words here").alias("comment_text"))
    drawn = evaluate.reservoir_sample(df, 20, key="id", seed=1, stratum="s")
    assert sorted(r["count"] for r in drawn.groupBy("s").count().collect()) == [20, 20, 20]
    assert {r["id"] for r in drawn.collect()} == {r["id"] for r in evaluate.reservoir_sample(df.repartition(7), 20, key="id", seed=1, stratum="s").collect()}
    assert {r["id"] for r in drawn.collect()} != {r["id"] for r in evaluate.reservoir_sample(df, 20, key="id", seed=2, stratum="s").collect()}
    both = evaluate.concatenated({"a": df.select("id"), "b": df.select("id", "s")})
    assert both.where("corpus = 'a' and s is not null").count() == 0 and both.count() == 1000
    assert clean.admit(df, rows=500, characters=7500) is df
    with pytest.raises(IngestError):
        clean.admit(df, rows=499, characters=7500)
    assert clean.median_words(df, column="comment_text").first()["median_words"] == 3.0
    assert clean.median_words(df.limit(0), column="comment_text").first()["is_short"] is False


def test_positions_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100_003).alias("source_order")).repartition(5)
    for parts in (1, 3, 50):
        got = [r["row_position"] for r in clean.with_positions(df, parts=parts).orderBy("source_order").collect()]
        assert got == list(range(1000))
    assert clean.with_positions(df.limit(0)).count() == 0


def test_stages_of_the_analysis(spark):
    rows = [(k, f"The bus of ward {k % 4} is late again and nobody answers the phone number {k}.") for k in range(12)]
    seen = []
    mapped = clean.map_columns(spark.createDataFrame(rows, "n long, c string"), comment="c", order="n")
    found = analysis.analyse(mapped, analysis.Options(progress=seen.append, theme_count=2))
    assert seen == list(analysis.STAGES) and found.comments.count() == 12

"""Queries over files and small literal cases: readers, redaction rules, grouping and selection, and the whole analysis.

Their SQL holds the results as constants or takes them from the tables; it reads nothing of the package.
"""

from __future__ import annotations

import json
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import redaction
from .operators import affect, clean, evaluate, gaps, questions, themes
from .plans import analysis, brief
from .schema import POSITION
from .sources import shared, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _work() -> Path:
    """A new folder of the driver's own."""
    return Path(tempfile.mkdtemp(prefix="plenum-files-"))


def _values(columns: str, rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(one(v) for v in row) + ')' for row in rows)}) t({columns})"


# ---- files


def _csv_text(rows: list[tuple], header: tuple[str, ...]) -> str:
    def cell(v: object) -> str:
        return '"' + ("" if v is None else str(v)).replace('"', '""') + '"'

    return "\n".join(",".join(cell(v) for v in row) for row in [header, *rows]) + "\n"


def _canonical(spark: SparkSession, folder: str) -> list[tuple]:
    rows = _table(spark, folder, "canonical_values").select("field_name", F.col("canonical_id").cast("string"), F.concat_ws("\n", F.concat(F.array("canonical_value"), "aliases"))).orderBy("field_name", F.col("canonical_id").cast("long")).collect()
    return [tuple(r) for r in rows]


_NAMES = "array_to_string(list_prepend(canonical_value, aliases), chr(10))"


@_query(f"SELECT field_name, CAST(canonical_id AS VARCHAR) AS canonical_id, {_NAMES} AS names, 'utf-8' AS encoding FROM canonical_values")
def source_csv(spark, folder):  # noqa: ANN001, ANN201
    """A CSV with a byte order mark and quoted line breaks, read as text."""
    path = _work() / "table.csv"
    path.write_text("﻿" + _csv_text(_canonical(spark, folder), ("field_name", "canonical_id", "names")), encoding="utf-8")
    df, encoding = tables.read_csv(spark, shared.publish(spark, path), preserve_text=True)
    return df.withColumn("encoding", F.lit(encoding))


@_query(f"SELECT field_name, CAST(canonical_id AS VARCHAR) AS canonical_id, {_NAMES} || ' – “é”' AS names, 'windows-1252' AS encoding FROM canonical_values")
def source_csv_windows(spark, folder):  # noqa: ANN001, ANN201
    """A Windows-1252 CSV whose first 2 MB are plain ASCII."""
    path = _work() / "table.csv"
    rows = [("filler", "0", "x" * 1000)] * 2000 + [(a, b, c + " – “é”") for a, b, c in _canonical(spark, folder)]
    path.write_bytes(_csv_text(rows, ("field_name", "canonical_id", "names")).encode("cp1252"))
    df, encoding = tables.read_csv(spark, shared.publish(spark, path), preserve_text=True)
    return df.where(F.col("field_name") != "filler").withColumn("encoding", F.lit(encoding))


def _reference_rows(spark: SparkSession, folder: str) -> list[tuple]:
    return [tuple(r) for r in _table(spark, folder, "reference_distribution").select("field_name", "group_label", "share").orderBy("field_name", "group_label").collect()]


@_query("SELECT field_name, group_label, share FROM reference_distribution")
def source_xlsx(spark, folder):  # noqa: ANN001, ANN201
    """The second sheet of a workbook, found by its name."""
    path = _work() / "book.xlsx"
    path.write_bytes(sinks.workbook_bytes({"notes": [["nothing here"]], "shares": [["field_name", "group_label", "share"], *map(list, _reference_rows(spark, folder))]}))
    return tables.load_table(spark, path, sheet_name="shares", row_cap=None).df.drop(tables.ORDER)


@_query(_values("sheet_no, sheet", [(0, "notes"), (1, "shares & more")]))
def source_sheets(spark, folder):  # noqa: ANN001, ANN201
    path = _work() / "book.xlsx"
    path.write_bytes(sinks.workbook_bytes({"notes": [["a"]], "shares & more": [["b"]]}))
    return spark.createDataFrame(list(enumerate(tables.list_sheets(path))), "sheet_no int, sheet string")


@_query("SELECT field_name, CAST(canonical_id AS VARCHAR) AS canonical_id FROM canonical_values ORDER BY field_name, canonical_values.canonical_id LIMIT 10")
def source_load_capped(spark, folder):  # noqa: ANN001, ANN201
    """The load wrapper with a row cap, which is its feature: the first ten rows in file order."""
    path = _work() / "table.csv"
    path.write_text(_csv_text(_canonical(spark, folder), ("field_name", "canonical_id", "names")), encoding="utf-8")
    report = tables.load_table(spark, shared.publish(spark, path), row_cap=10, preserve_text=True)
    return report.df.select("field_name", "canonical_id")


@_query(f"SELECT field_name, CAST(canonical_id AS VARCHAR) AS canonical_id, {_NAMES} AS names FROM canonical_values")
def source_zip(spark, folder):  # noqa: ANN001, ANN201
    """The one CSV of an archive, beside a file of another kind."""
    work = _work()
    with zipfile.ZipFile(work / "a.zip", "w") as z:
        z.writestr("readme.txt", "not a table")
        z.writestr("inner/table.csv", _csv_text(_canonical(spark, folder), ("field_name", "canonical_id", "names")))
    return tables.read_zipped_csv(spark, work / "a.zip", shared.new_folder(spark), required={"field_name"})


@_query("SELECT group_label AS \"group\", share FROM reference_distribution WHERE field_name = 'role'")
def source_reference_csv(spark, folder):  # noqa: ANN001, ANN201
    path = _work() / "reference.csv"
    path.write_text(_csv_text([r[1:] for r in _reference_rows(spark, folder) if r[0] == "role"], ("group", "share")), encoding="utf-8")
    return spark.createDataFrame(tables.load_reference_csv(spark, shared.publish(spark, path)), "group string, share string")


@_query("SELECT 'subgroup__' || field_name AS field, trim(group_label) AS \"group\", share FROM reference_distribution")
def source_reference_json(spark, folder):  # noqa: ANN001, ANN201
    """Shares of several fields from a JSON side file."""
    shares: dict[str, dict[str, str]] = {}
    for field, group, share in _reference_rows(spark, folder):
        shares.setdefault(field, {})[group.strip()] = share
    path = _work() / "reference.json"
    path.write_text(json.dumps(shares), encoding="utf-8")
    found = tables.read_references(path, sorted(shares))
    return spark.createDataFrame([(f, g, s) for f, groups in found.items() for g, s in groups.items()], "field string, group string, share string")


@_query(_values("outcome, n", [("JSON with a repeated key", 0), ("a side file over its limit", 0), ("a side file that is not UTF-8", 0), ("an unknown subgroup", 0), ("two CSV files in an archive", 0), ("a side file of six bytes", 6)]))
def source_refusals(spark, folder):  # noqa: ANN001, ANN201
    """What the readers of side files refuse gives 0, what they take its length."""
    work = _work()
    files = {"repeated.json": b'{"role": {}, "role": {}}', "six.txt": b"abc de", "latin.txt": "é".encode("latin-1"), "ward.json": b'{"ward": {"a": "1"}}'}
    for name, data in files.items():
        (work / name).write_bytes(data)
    with zipfile.ZipFile(work / "two.zip", "w") as z:
        z.writestr("a.csv", "x\n1\n"), z.writestr("b.csv", "x\n1\n")
    attempts = {
        "JSON with a repeated key": lambda: len(tables.read_references(work / "repeated.json", ["role"])),
        "a side file over its limit": lambda: len(tables.read_side_text(work / "six.txt", 5)),
        "a side file that is not UTF-8": lambda: len(tables.read_side_text(work / "latin.txt")),
        "an unknown subgroup": lambda: len(tables.read_references(work / "ward.json", ["role"])),
        "two CSV files in an archive": lambda: tables.read_zipped_csv(spark, work / "two.zip", work / "o").count(),
        "a side file of six bytes": lambda: len(tables.read_side_text(work / "six.txt", 6)),
    }
    out = []
    for name, attempt in attempts.items():
        try:
            out.append((name, attempt()))
        except ValueError:
            out.append((name, 0))
    return spark.createDataFrame(out, "outcome string, n int")


@_query("SELECT 'EX-7-' || row_id AS source_id, 'Row ' || row_id || ' & more' AS comment_text, '2026-01-0' || (row_id % 9 + 1) AS hearing_date FROM synthetic_theme_benchmark WHERE row_id % 5 NOT IN (0, 1, 2)")
def source_json_records(spark, folder):  # noqa: ANN001, ANN201
    """Comments of one document from JSON records: withdrawn and restricted ones and those of other documents stay out, markup goes."""
    records = shared.new_folder(spark) + "/records"
    k = F.col("row_id") % 5
    attributes = F.struct(
        F.lit("EX-7").alias("docketId"),
        F.when(k == 0, "EX-7-0002").otherwise("EX-7-0001").alias("commentOnDocumentId"),
        (k == 1).alias("withdrawn"),
        F.when(k == 2, "other").alias("restrictReason"),
        F.concat(F.lit("<p>Row "), F.col("row_id").cast("string"), F.lit(" &amp; <b>more</b></p>")).alias("comment"),
        F.concat(F.lit("2026-01-0"), (F.col("row_id") % 9 + 1).cast("string")).alias("postedDate"),
    )
    rows = _table(spark, folder, "synthetic_theme_benchmark").select(F.struct(F.concat(F.lit("EX-7-"), F.col("row_id").cast("string")).alias("id"), F.lit("comments").alias("type"), attributes.alias("attributes")).alias("data"))
    rows.write.json(records)
    return tables.comment_records(spark.read.json(records), "EX-7-0001")


# ---- redaction

#: Text, spans of persons that a detector would give, the redacted text, and the counts.
_REDACTIONS = [
    ("Write to jo.doe+x@mail.example.org today.", [], "Write to [EMAIL_ADDRESS] today.", '{"EMAIL_ADDRESS":1}'),
    ("See https://example.org/a?b=1, or www.example.net/x.", [], "See [URL], or [URL].", '{"URL":2}'),
    ("Call +1 (312) 555-0123 or 312.555.0123 now", [], "Call [PHONE_NUMBER] or [PHONE_NUMBER] now", '{"PHONE_NUMBER":2}'),
    ("Room 312555 has 3125550123 on it", [], "Room 312555 has 3125550123 on it", "{}"),
    ("It is at 12 North Elm Street, beside 7 Oak Ave. today", [], "It is at [STREET_ADDRESS] beside [STREET_ADDRESS] today", '{"STREET_ADDRESS":2}'),
    ("He lives in Apt. 4B and she in unit #12, not in suite life", [], "He lives in [UNIT_NUMBER] and she in [UNIT_NUMBER], not in suite life", '{"UNIT_NUMBER":2}'),
    ("Unit tests start in week 5; Ste 210-B is open", [], "Unit tests start in week 5; [UNIT_NUMBER] is open", '{"UNIT_NUMBER":1}'),
    ("Contact Mary Ann Smith at mary@example.org.", [], "Contact [PERSON] at [EMAIL_ADDRESS].", '{"EMAIL_ADDRESS":1,"PERSON":1}'),
    ("Contact Mary Smith at the desk.", [], "Contact Mary Smith at the desk.", "{}"),
    ("Meet at 123 John Smith Road, please.", [(12, 22)], "Meet at [STREET_ADDRESS] please.", '{"STREET_ADDRESS":1}'),
    ("Jane Roe spoke.", [(0, 8)], "[PERSON] spoke.", '{"PERSON":1}'),
    ("Broken exterior lighting at the door", [(0, 6)], "Broken exterior lighting at the door", "{}"),
    ("The Broken exterior lighting", [(4, 10)], "The [PERSON] exterior lighting", '{"PERSON":1}'),
    ("Email me at a@b.example.org", [(0, 5)], "Email me at [EMAIL_ADDRESS]", '{"EMAIL_ADDRESS":1}'),
    ("Email was here", [(0, 5)], "[PERSON] was here", '{"PERSON":1}'),
    ("", [], "", "{}"),
    (None, [], "", "{}"),
]


@_query(_values("case_no, redacted, counts", [(i, r[2], r[3]) for i, r in enumerate(_REDACTIONS)]))
def redaction_cases(spark, folder):  # noqa: ANN001, ANN201
    """Each pattern, the contact rule, detected persons and their exceptions, as literal cases."""
    persons = {r[0]: r[1] for r in _REDACTIONS}
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_REDACTIONS)], "case_no int, comment_text string")
    out = redaction.redact_column(df, detector=lambda texts: [persons.get(t, []) for t in texts])
    return out.select("case_no", F.col("redacted_comment_text").alias("redacted"), F.to_json("redaction_counts").alias("counts"))


@_query(_values("case_no, start_pos, end_pos, kind", [(0, 0, 3, "A"), (0, 3, 6, "B"), (1, 0, 9, "B"), (2, 0, 10, "A"), (2, 12, 14, "C"), (3, 0, 6, "A"), (4, 0, 9, "C")]))
def span_union_cases(spark, folder):  # noqa: ANN001, ANN201
    """Touching, overlapping, nested, equal and chained spans."""
    cases = [[(0, 3, "A"), (3, 6, "B")], [(0, 4, "A"), (3, 9, "B")], [(0, 10, "A"), (2, 5, "B"), (12, 14, "C")], [(0, 4, "A"), (2, 6, "B")], [(0, 3, "A"), (2, 5, "B"), (4, 9, "C")]]
    return spark.createDataFrame([(i, *s) for i, spans in enumerate(cases) for s in redaction.merge(spans)], "case_no int, start_pos int, end_pos int, kind string")


@_query("SELECT count(*) AS n_rows, CAST((SELECT count(*) FROM (SELECT unnest(names) AS n FROM person_redaction_cases) WHERE trim(n) <> '') AS BIGINT) AS n_planted, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS partly_left, CAST((SELECT count(*) FROM (SELECT unnest(names) AS n FROM person_redaction_cases) WHERE trim(n) <> '') AS BIGINT) AS left_whole FROM person_redaction_cases")
def redaction_report_untouched(spark, folder):  # noqa: ANN001, ANN201
    """The report of a redaction that does nothing: every planted name is left."""
    return evaluate.redaction_report(_table(spark, folder, "person_redaction_cases"), redacted="text", planted="names")


@_query(_values("n_rows, n_planted, removed, partly_left, left_whole", [(4, 4, 2, 1, 1)]))
def redaction_report_cases(spark, folder):  # noqa: ANN001, ANN201
    rows = [("[PERSON] spoke", ["Ada Byron"]), ("Ada [PERSON] spoke", ["Ada Byron"]), ("ada byron and [PERSON]", ["Ada Byron", "Max Roe"]), ("nothing", [])]
    return evaluate.redaction_report(spark.createDataFrame(rows, "t string, names array<string>"), redacted="t", planted="names")


# ---- themes and questions


@_query(_values("row_position, label", [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 0), (7, 3), (8, -1)]))
def merge_small_cases(spark, folder):  # noqa: ANN001, ANN201
    """A small group near a large one merges into it, one far from all stays, noise stays noise."""
    rows = [(0, 0, [1.0, 0.0, 0.0]), (1, 0, [1.0, 0.05, 0.0]), (2, 0, [1.0, 0.0, 0.05]), (3, 1, [0.0, 1.0, 0.0]), (4, 1, [0.0, 1.0, 0.1]), (5, 1, [0.05, 1.0, 0.0]), (6, 2, [0.9, 0.2, 0.1]), (7, 3, [0.0, 0.1, 1.0]), (8, -1, [0.5, 0.5, 0.5])]
    return themes.merge_small(spark.createDataFrame(rows, f"{POSITION} long, label int, vector array<double>")).withColumn("label", F.col("label").cast("int"))


@_query(_values("step, left_groups, right_groups, score", [(1, "1", "3", 0.95), (2, "0", "2", 0.9), (3, "0,2", "1,3", 0.8)]))
def merge_history_cases(spark, folder):  # noqa: ANN001, ANN201
    """Greedy merging with ties and the least similar pair of merged groups."""
    pairs = {(0, 1): 0.85, (0, 2): 0.9, (0, 3): 0.82, (1, 2): 0.8, (1, 3): 0.95, (2, 3): 0.84, (0, 4): 0.9, (4, 5): 0.1}
    _, history = themes.merge_plan([1, 1, 1, 1, 9, 8], {k: v for k, v in pairs.items() if 4 not in k})
    return spark.createDataFrame([(i, ",".join(map(str, a)), ",".join(map(str, b)), float(s)) for i, (a, b, s) in enumerate(history, 1)], "step int, left_groups string, right_groups string, score double")


def _words(n: int, start: int = 0) -> str:
    return " ".join(f"w{k}" for k in range(start, start + n))


_QUOTES = [
    (_words(11), "sentences"),
    (_words(12), "sentences"),
    (_words(60), "full_comment"),
    (_words(61), "full_comment"),
    (_words(20) + ". " + _words(30) + ". " + _words(20) + ".", "sentences"),
    (_words(13) + " [PHONE_NUMBER]. " + _words(12) + ".", "sentences"),
    (_words(13) + " [PHONE_NUMBER]. " + _words(12) + ".", "full_comment"),
    ("", "sentences"),
]


def _quote_rows() -> list[tuple[int, int, int]]:
    a, b, c = len(_words(20) + "."), len(_words(30) + "."), len(_words(20) + ".")
    start = len(_words(13) + " [PHONE_NUMBER]. ")
    end = start + len(_words(12) + ".")
    return [(1, 0, len(_words(12))), (2, 0, len(_words(60))), (4, 0, a + 1 + b), (4, a + 1, a + 1 + b + 1 + c), (4, a + b + 2, a + b + 2 + c), (5, start, end), (6, 0, end)]


@_query(_values("case_no, start_pos, end_pos", _quote_rows()))
def quote_span_cases(spark, folder):  # noqa: ANN001, ANN201
    """Limits of 12 and 60 words, whole sentences, contact markers."""
    return spark.createDataFrame([(i, a, b) for i, (value, mode) in enumerate(_QUOTES) for a, b in themes.quote_spans(value, mode)], "case_no int, start_pos int, end_pos int")


@_query(_values("theme_id, quote_no, row_position", [(1, 1, 1), (1, 2, 3), (1, 3, 4), (2, 1, 5)]))
def quote_selection_cases(spark, folder):  # noqa: ANN001, ANN201
    """Nearest first, near copies and short comments passed over, no quotes of noise."""
    base = "the buses of our ward are late on most mornings and nobody tells us why"
    texts = [base + " today", base + " today!", "too short", "the library has one copy of each book and the whole class has to share it daily", "our ramp is closed again in the rain so people with chairs wait outside the side door", "letters to the office stay without an answer for many weeks and we have stopped to hope", base]
    near = [1.0, 0.99, 0.98, 0.6, 0.5, 1.0, 1.0]
    rows = [(i, t, [x, (1 - x * x) ** 0.5]) for i, (t, x) in enumerate(zip(texts, near, strict=True))]
    df = spark.createDataFrame(rows, f"{POSITION} long, redacted_text string, vector array<double>")
    assigned = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 0)], f"{POSITION} long, theme_id int")
    return themes.select_quotes(df, assigned, pool=3).select("theme_id", "quote_no", POSITION)


@_query(_values("term", [("bus late",), ("library",), ("ramp",)]))
def keyword_overlap_cases(spark, folder):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(t,) for t in themes.pick_terms(["bus late", "bus", "late bus", "library", "late bus driver", "ramp", "door"], 3)], "term string")


@_query(_values("\"key\", cluster", [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "d")]))
def complete_linkage_cases(spark, folder):  # noqa: ANN001, ANN201
    """A chain a, b, c whose ends are too far apart is cut; d and e are near."""
    import math

    turn = {"a": 0.0, "b": 40.0, "c": 85.0, "d": 180.0, "e": 190.0}
    rows = [(k, [math.cos(math.radians(t)), math.sin(math.radians(t))]) for k, t in turn.items()]
    return questions.group_wordings(spark.createDataFrame(rows, "key string, vector array<double>"), 0.35)


def _blobs(spark: SparkSession, per: int, groups: int) -> DataFrame:
    rows = [(g * per + i, [1.0 if d == g else 0.02 * ((i * (d + 3)) % 5) for d in range(groups)]) for g in range(groups) for i in range(per)]
    return spark.createDataFrame(rows, f"{POSITION} long, vector array<double>")


@_query(_values("groups, same_group_pairs, size", [(5, 5, 12)]))
def kmeans_auto_cases(spark, folder):  # noqa: ANN001, ANN201
    """Five clear groups of twelve: the silhouette chooses five, each group under one label."""
    labels, _ = themes.choose_kmeans(_blobs(spark, 12, 5), "auto")
    sizes = labels.withColumn("g", F.floor(F.col(POSITION) / 12)).groupBy("label", "g").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_distinct("label").cast("int").alias("groups"), F.count(F.lit(1)).cast("int").alias("same_group_pairs"), F.max("n").cast("int").alias("size"))


@_query(_values("label, n", [(-1, 1), (0, 30), (1, 30), (2, 30)]))
def density_cases(spark, folder):  # noqa: ANN001, ANN201
    """Three dense groups and one row that is near to none, under the default similarity."""
    points = _blobs(spark, 30, 4).where(F.col(POSITION) < 91)
    labels, _ = themes.density_labels(points)
    return labels.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.col("label").cast("int").alias("label"), "n")


@_query(_values("row_position, sentence_index, source_start, source_end, is_question", [(0, 0, 0, 16, True), (0, 1, 17, 32, False), (0, 2, 33, 47, True), (1, 0, 0, 9, False)]))
def sentence_offset_cases(spark, folder):  # noqa: ANN001, ANN201
    """Verbatim offsets and question rules of the sentencizer."""
    df = spark.createDataFrame([(0, "Where is my bus? It came at six. Can we go now?"), (1, "We waited"), (2, "?!"), (3, None)], f"{POSITION} long, comment_text string")
    return questions.sentence_records(df).select(POSITION, "sentence_index", "source_start", "source_end", "is_question")


@_query(_values("\"key\", response_match_status, matched_wordings", [("a", "possible_match", 2), ("b", "partial_match", 1), ("c", "no_match", 0), ("d", "not_checked", -1)]))
def match_status_cases(spark, folder):  # noqa: ANN001, ANN201
    clusters = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b"), ("c1", "c"), ("d1", "d")], "key string, cluster string")
    matches = spark.createDataFrame([("a1", 0.6), ("a2", 0.9), ("b1", 0.7), ("b2", 0.59), ("c1", 0.1), ("d1", None)], "key string, similarity double")
    return questions.match_status(matches, clusters).select(F.col("cluster").alias("key"), "response_match_status", F.coalesce("matched_wordings", F.lit(-1)).cast("int").alias("matched_wordings"))


# ---- tables


@_query("SELECT median(len(list_filter(regexp_split_to_array(coalesce(comment_text, ''), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+'), lambda x: x <> ''))) AS median_words, median(len(list_filter(regexp_split_to_array(coalesce(comment_text, ''), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+'), lambda x: x <> ''))) < 8 AS is_short FROM synthetic_theme_benchmark")
def median_words(spark, folder):  # noqa: ANN001, ANN201
    return clean.median_words(_table(spark, folder, "synthetic_theme_benchmark"), column="comment_text")


@_query("SELECT 'benchmark' AS corpus, CAST(row_id AS VARCHAR) AS id, comment_text, CAST(NULL AS VARCHAR) AS product FROM synthetic_theme_benchmark UNION ALL SELECT 'complaints', complaint_id, comment_text, product FROM cfpb_sample UNION ALL SELECT 'federal', source_id, comment_text, NULL FROM federal_sample")
def corpora_together(spark, folder):  # noqa: ANN001, ANN201
    """Three corpora of different columns below each other."""
    return evaluate.concatenated(
        {
            "benchmark": _table(spark, folder, "synthetic_theme_benchmark").select(F.col("row_id").cast("string").alias("id"), "comment_text"),
            "complaints": _table(spark, folder, "cfpb_sample").select(F.col("complaint_id").alias("id"), "comment_text", "product"),
            "federal": _table(spark, folder, "federal_sample").select(F.col("source_id").alias("id"), "comment_text"),
        }
    )


@_query("SELECT source, least(count(*), 40) AS n, true AS all_known FROM documents GROUP BY 1")
def reservoir_by_source(spark, folder):  # noqa: ANN001, ANN201
    """A sampling operator: forty documents of each source."""
    docs = _table(spark, folder, "documents").select("doc_id", "source")
    drawn = evaluate.reservoir_sample(docs, 40, key="doc_id", seed=20260925, stratum="source")
    known = drawn.join(docs.withColumn("known", F.lit(True)), ["doc_id", "source"], "left")
    return known.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))


@_query("SELECT count(*) AS n, true AS in_order, true AS sized FROM (SELECT DISTINCT comment_text FROM synthetic_theme_benchmark WHERE comment_text IS NOT NULL)")
def length_batches(spark, folder):  # noqa: ANN001, ANN201
    """Batches of 32 distinct texts: no two batches of a task overlap in length, none is larger."""
    texts = _table(spark, folder, "synthetic_theme_benchmark").select(F.col("comment_text").alias("scoring_text")).where(F.col("scoring_text").isNotNull()).distinct()
    b = affect.length_batches(texts, 32).withColumns({"task": F.split("batch_no", "-")[0].cast("int"), "no": F.split("batch_no", "-")[1].cast("int")})
    from pyspark.sql import Window

    sizes = b.groupBy("task", "no").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("scoring_text")).alias("low"), F.max(F.length("scoring_text")).alias("high"))
    ordered = sizes.withColumn("before", F.lag("high").over(Window.partitionBy("task").orderBy("no")))
    return ordered.agg(F.sum("n").alias("n"), F.bool_and(F.coalesce(F.col("before") <= F.col("low"), F.lit(True))).alias("in_order"), (F.max("n") <= 32).alias("sized"))


@_query("SELECT 'role' AS method, count(*) FILTER (WHERE role IS NOT NULL AND validation_theme IS NOT NULL) AS n, count(DISTINCT role) AS n_groups, (SELECT max(c) FROM (SELECT count(*) AS c FROM synthetic_theme_benchmark WHERE role IS NOT NULL GROUP BY role)) AS largest FROM synthetic_theme_benchmark UNION ALL SELECT 'school', count(*) FILTER (WHERE school IS NOT NULL AND validation_theme IS NOT NULL), count(DISTINCT school), (SELECT max(c) FROM (SELECT count(*) AS c FROM synthetic_theme_benchmark WHERE school IS NOT NULL GROUP BY school)) FROM synthetic_theme_benchmark")
def grouping_comparison(spark, folder):  # noqa: ANN001, ANN201
    """Two groupings held against the planted themes (the index itself has a query of its own)."""
    return evaluate.compare_groupings(_table(spark, folder, "synthetic_theme_benchmark"), "validation_theme", ["role", "school"]).select("method", "n", "n_groups", "largest")


@_query("SELECT role AS \"before\", housing_tenure AS \"after\", count(*) AS n FROM synthetic_theme_benchmark WHERE role IS DISTINCT FROM housing_tenure GROUP BY 1, 2")
def moved_between_groupings(spark, folder):  # noqa: ANN001, ANN201
    return evaluate.moved_rows(_table(spark, folder, "synthetic_theme_benchmark"), "role", "housing_tenure")


@_query(_values("n_chosen, n_known, in_top, mean_rank", [(4, 3, 2, 9.0)]))
def priority_cases(spark, folder):  # noqa: ANN001, ANN201
    groups = spark.createDataFrame([(f"q{k:03d}", k) for k in range(1, 31)], "question_group_id string, rank int")
    return evaluate.priorities(groups, spark.createDataFrame([("q001",), ("q006",), ("q020",), ("q099",), ("q001",)], "question_group_id string"))


@_query(_values("limits, admitted", [("60 rows, 24000 characters", False), ("all", True)]))
def admission(spark, folder):  # noqa: ANN001, ANN201
    """A table over the limit is refused whole; under a wider one it is taken whole."""
    df = _table(spark, folder, "synthetic_theme_benchmark")
    out = []
    for name, rows, characters in (("60 rows, 24000 characters", 60, 24_000), ("all", 1 << 40, 1 << 50)):
        try:
            out.append((name, clean.admit(df, rows=rows, characters=characters) is df))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "limits string, admitted boolean")


@_query("SELECT field_name AS field, trim(group_label) AS \"group\", round(CASE WHEN trim(share) LIKE '%\\%' ESCAPE '\\' THEN CAST(rtrim(trim(share), '%') AS DOUBLE) / 100 ELSE CAST(trim(share) AS DOUBLE) END, 9) AS share FROM reference_distribution")
def reference_shares(spark, folder):  # noqa: ANN001, ANN201
    """Shares as proportions and percentages."""
    rows = _table(spark, folder, "reference_distribution").collect()
    return spark.createDataFrame([(r["field_name"], r["group_label"].strip(), round(float(gaps.parse_share(r["share"])), 9)) for r in rows], "field string, group string, share double")


@_query(_values("given, share", [("0.2", 0.2), (".5", 0.5), ("12.5 %", 0.125), ("100%", 1.0), ("0", 0.0), ("1e-3", 0.001), ("40", None), ("-1%", None), ("nan", None), ("a", None), ("", None), ("1e-400", None)]))
def share_cases(spark, folder):  # noqa: ANN001, ANN201
    out = []
    for given in ("0.2", ".5", "12.5 %", "100%", "0", "1e-3", "40", "-1%", "nan", "a", "", "1e-400"):
        try:
            out.append((given, float(gaps.parse_share(given))))
        except ValueError:
            out.append((given, None))
    return spark.createDataFrame(out, "given string, share double")


@_query()
def gap_workbook(spark, folder):  # noqa: ANN001, ANN201
    """The workbook of gap rows, read back: nothing hidden is in it."""
    references = gaps.references_from_table(_table(spark, folder, "reference_distribution"))
    rows, _ = gaps.analyse_gaps(_table(spark, folder, "synthetic_theme_benchmark"), subgroups=["role", "ward"], references={k: v for k, v in references.items() if k in ("role", "ward")}, order="row_id")
    path = _work() / "gaps.xlsx"
    path.write_bytes(sinks.gap_workbook(rows))
    back = tables.load_table(spark, path, row_cap=None).df
    return back.select("field", "group", F.col("count").cast("long").alias("count"))


@_query(_values("kind, made", [("markdown", True), ("word", True), ("pdf", True)]))
def brief_documents(spark, folder):  # noqa: ANN001, ANN201
    """The sizes of the brief as Markdown, Word and PDF."""
    made = {
        "themes": [{"label": "Late buses", "count": 3, "share": 0.5, "quote": "The bus is late."}],
        "sentiment": {"scored": 0, "unscored": 1},
        "change": None,
        "gaps": [],
        "questions": [],
    }
    sizes = [("markdown", len(brief.to_markdown(made)) > 100), ("word", brief.docx_bytes(made)[:2] == b"PK"), ("pdf", brief.pdf_bytes(made).startswith(b"%PDF"))]
    return spark.createDataFrame(sizes, "kind string, made boolean")


_CLEANED = r"""
k AS (SELECT row_id, regexp_replace(coalesce(comment_text, ''), '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '', 'g') AS t, regexp_replace(coalesce(respondent_id, ''), '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '', 'g') AS rid FROM synthetic_theme_benchmark),
f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY row_id) AS rn FROM k WHERE t <> ''),
c AS (SELECT * FROM f WHERE rid = '' OR rn = 1),
n AS (SELECT count(*) AS n FROM c)"""


@_query(f"WITH {_CLEANED} SELECT unnest(['comments', 'affect rows', 'comments in periods', 'assigned once', 'themes have assignments', 'quotes lie in comments', 'volumes are assignments']) AS part, unnest([n, n, n, 1, 1, 1, 1]) AS n FROM n")
def full_analysis(spark, folder):  # noqa: ANN001, ANN201
    """The whole analysis of the benchmark comments, its tables counted and held against each other."""
    mapped = clean.map_columns(_table(spark, folder, "synthetic_theme_benchmark"), comment="comment_text", order="row_id", period="hearing_date", respondent="respondent_id", subgroups=["role"])
    a = analysis.analyse(mapped)

    def count(df: DataFrame) -> int:
        return df.count()

    assigned = a.assignments.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(POSITION).alias("d")).first()
    themed = a.themes.join(a.assignments.groupBy("theme_id").agg(F.count(F.lit(1)).alias("k")), "theme_id", "left").where(~F.col("count").eqNullSafe(F.col("k")))
    quoted = a.quotes.join(a.comments.select(POSITION, "redacted_text"), POSITION, "left").where(~F.coalesce(F.expr("substring(redacted_text, source_start + 1, source_end - source_start)") == F.col("quote"), F.lit(False)))
    rows = [
        ("comments", count(a.comments)),
        ("affect rows", count(a.affect)),
        ("comments in periods", int(a.periods.agg(F.sum("total_comments")).first()[0])),
        ("assigned once", int(assigned["n"] == assigned["d"])),
        ("themes have assignments", int(count(themed) == 0)),
        ("quotes lie in comments", int(count(quoted) == 0 and count(a.quotes) > 0)),
        ("volumes are assignments", int(a.volumes.agg(F.sum("n")).first()[0] == assigned["n"])),
    ]
    return spark.createDataFrame(rows, "part string, n long")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

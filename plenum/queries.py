"""One query for each operator of the core, over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import pkgutil
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, redaction, text, vectors
from .operators import affect, clean, evaluate, gaps, questions, themes, timeline
from .operators.graph import checkpointed
from .plans import brief, export
from .schema import EMOTIONS, POSITION, SENTIMENTS
from .sources import synthetic, tables
from .streaming import windows

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


def _benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "synthetic_theme_benchmark")


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    return clean.map_columns(_benchmark(spark, folder), comment="comment_text", order="row_id", period="hearing_date", respondent="respondent_id", subgroups=["role"])


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# The word lists of the SQL are its own: a slip in the package's lists shows as a difference.
_SQL_CONTACT = "contact at or i live email me us call on my address is".split()
_SQL_WH = "who whom whose what which when where why how".split()
_SQL_AUXILIARIES = "am is are was were do does did have has had can could shall should will would may might must".split()
_SQL_GATE = {
    "en": "the of and to in is that for it was on are as with at be this from have not but what all were when we there can an your which their will about how if do does my our us why please".split(),
    "es": "el la de que y en los las del se por con para una su al lo como pero ya está más no un es mi nos si".split(),
    "pt": "de que e do da em um para com não uma os no se na por mais as dos como mas foi ao ele são já é meu".split(),
    "pl": "w z na się nie do to że o jak za po co ale od już czy tak przez jest są dla my przed".split(),
}
_SQL_TONE = {
    "positive": "good great thank thanks grateful helpful encouraged relieved hopeful support safe love like better best happy improve improved welcome appreciate works clear".split(),
    "negative": "bad angry tired baffled ignored worn unsafe broken late missing lost slow worse worst unhappy fail failed fails crisis cut closed afraid sad unconvinced overwhelmed".split(),
    "anger": "angry furious ignored outraged unfair".split(),
    "disgust": "disgusting filthy shameful gross".split(),
    "fear": "afraid unsafe scared worried danger dangerous".split(),
    "joy": "happy love grateful glad relieved encouraged hopeful thank thanks".split(),
    "sadness": "sad tired lost worn lonely cry".split(),
    "surprise": "surprised unexpected suddenly baffled".split(),
}
# The stop list is an input file of both.
_SQL_STOP = [w for line in pkgutil.get_data("plenum.operators", "stop_words.txt").decode("utf-8").splitlines() if line[0] != "#" for w in line.split(" ")]


# SQL of the white space that strip() and squeeze() know, and of common expressions.
_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _list(words) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits(words) -> str:  # noqa: ANN001
    return f"len(list_intersect(tok, {_list(words)}))"


_CLEANED = f"""
k AS (SELECT row_id, {_strip("comment_text")} AS comment_text, hearing_date, respondent_id, role, {_strip("respondent_id")} AS rid FROM synthetic_theme_benchmark),
f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY row_id) AS rn FROM k WHERE comment_text <> ''),
cleaned AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_position, row_id AS source_order, comment_text, hearing_date AS date_or_hearing, respondent_id, role AS subgroup__role FROM f WHERE rid = '' OR rn = 1)"""


@_query(f"WITH {_CLEANED} SELECT * FROM cleaned")
def map_clean_dedupe(spark, folder):  # noqa: ANN001, ANN201
    """Mapping, blank removal, first row of each respondent, positions."""
    return clean.with_positions(clean.clean(_mapped(spark, folder)))


@_query(f"""WITH {_CLEANED} SELECT (SELECT count(*) FROM k) AS input_rows, (SELECT count(*) FROM k WHERE comment_text = '') AS empty_removed,
(SELECT count(*) FROM f WHERE rid <> '' AND rn > 1) AS duplicates_removed, (SELECT count(*) FROM cleaned) AS kept_rows""")
def cleaning_summary(spark, folder):  # noqa: ANN001, ANN201
    return clean.cleaning_summary(_mapped(spark, folder)).select(*[F.col(c).cast("long") for c in ("input_rows", "empty_removed", "duplicates_removed", "kept_rows")])


@_query(f"WITH {_CLEANED} SELECT row_position, comment_text FROM cleaned WHERE row_position < 20")
def row_cap_preview(spark, folder):  # noqa: ANN001, ANN201
    """The preview of the first usable rows."""
    return clean.first_rows(clean.with_positions(clean.clean(_mapped(spark, folder))), 20, POSITION).select(POSITION, "comment_text")


@_query("""WITH d AS (SELECT complaint_id, comment_text, date_received, row_number() OVER (PARTITION BY complaint_id ORDER BY comment_text, date_received) AS rn FROM cfpb_sample
WHERE """ + _strip("comment_text") + """ <> '' AND regexp_matches(date_received, '^\\d{4}-\\d{2}-\\d{2}$') AND try_strptime(date_received, '%Y-%m-%d') IS NOT NULL AND date_received BETWEEN '2017-01-01' AND '2026-12-31' AND regexp_matches(complaint_id, '^[0-9]+$'))
SELECT complaint_id, comment_text, date_received FROM d WHERE rn = 1""")
def eligible_complaints(spark, folder):  # noqa: ANN001, ANN201
    """Date range, strict dates, ASCII ids, one row an id."""
    rows = _table(spark, folder, "cfpb_sample").select("complaint_id", "comment_text", "date_received")
    return clean.ascii_records(rows, text_column="comment_text", date_column="date_received", id_column="complaint_id", first_day="2017-01-01", last_day="2026-12-31")


_FIELDS = ("role", "housing_tenure", "language", "ward")
_GAPS = f"""
e AS (SELECT row_id, role, housing_tenure, language, CAST(ward AS VARCHAR) AS ward FROM synthetic_theme_benchmark WHERE {_strip("comment_text")} <> ''),
cells AS ({" UNION ALL ".join(f"SELECT row_id, '{x}' AS field, {_strip(x)} AS label FROM e" for x in _FIELDS)}),
c AS (SELECT field, lower(label) AS key, arg_min(label, row_id) AS label, count(*) AS n FROM cells WHERE label <> '' GROUP BY 1, 2),
r0 AS (SELECT field_name AS field, trim(group_label) AS ref_label, CAST(round((CASE WHEN trim(share) LIKE '%\\%' ESCAPE '\\' THEN CAST(rtrim(trim(share), '%') AS DOUBLE) / 100 ELSE CAST(trim(share) AS DOUBLE) END) * 1000000) AS BIGINT) AS ppm FROM reference_distribution),
ok AS (SELECT field FROM r0 GROUP BY 1 HAVING abs(sum(ppm) - 1000000) <= 1),
r AS (SELECT field, lower(ref_label) AS key, ref_label, ppm FROM r0 SEMI JOIN ok USING (field)),
j AS (SELECT coalesce(c.field, r.field) AS field, coalesce(c.key, r.key) AS key, label, ref_label, coalesce(n, 0) AS n, ppm FROM c FULL JOIN r ON c.field = r.field AND c.key = r.key),
t AS (SELECT field, sum(n) AS known, count(*) FILTER (WHERE n < 10) AS n_small, arg_min(key, (n, key)) FILTER (WHERE n >= 10) AS least_key, count(*) FILTER (WHERE ppm IS NULL AND n > 0) AS n_unmatched FROM j GROUP BY 1),
x AS (SELECT j.*, known, CASE WHEN n < 10 THEN 'small_group' WHEN n_small = 1 AND key = least_key THEN 'complementary' END AS reason,
  j.field IN (SELECT field FROM ok) AS valid FROM j JOIN t ON j.field = t.field WHERE known > 0)"""


def _gap_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    references = gaps.references_from_table(_table(spark, folder, "reference_distribution"))
    return gaps.analyse_gaps(_benchmark(spark, folder), subgroups=list(_FIELDS), references={k: v for k, v in references.items() if k in _FIELDS}, order="row_id")


@_query(f"""WITH {_GAPS} SELECT field, coalesce(ref_label, label) AS "group", CASE WHEN reason IS NULL THEN n END AS "count",
round(CASE WHEN reason IS NULL THEN n / known END, 6) AS participation_share, round(ppm / 1000000, 6) AS reference_share,
round(CASE WHEN reason IS NULL THEN (n / known - ppm / 1000000) * 100 END, 6) AS gap_percentage_points,
round(CASE WHEN reason IS NULL AND ppm <> 0 THEN n / known / (ppm / 1000000) END, 6) AS representation_ratio,
CASE WHEN reason IS NOT NULL THEN 'suppressed' WHEN NOT valid THEN 'invalid_reference' WHEN ppm IS NULL THEN 'unmatched' WHEN ppm = 0 THEN 'zero_reference'
WHEN n * 100000000 < 75 * ppm * known THEN 'underrepresented' WHEN n * 100000000 > 125 * ppm * known THEN 'overrepresented' ELSE 'within_range' END AS flag,
reason IS NOT NULL AS suppressed, reason AS suppression_reason FROM x""")
def gap_rows(spark, folder):  # noqa: ANN001, ANN201
    """Participation against reference shares with hidden small cells."""
    rows, _ = _gap_tables(spark, folder)
    return rows.withColumns({c: _r(c) for c in ("participation_share", "reference_share", "gap_percentage_points", "representation_ratio")})


@_query(f"""WITH {_GAPS}, l AS (SELECT unnest({_list(_FIELDS)}) AS field) SELECT l.field, CASE WHEN coalesce(known, 0) = 0 THEN 'unavailable' WHEN l.field IN (SELECT field FROM ok) THEN 'comparison' ELSE 'counts_only' END AS status,
CASE WHEN l.field IN (SELECT field FROM ok) THEN 'valid' ELSE 'invalid' END AS reference_status, (SELECT count(*) FROM e) AS eligible_rows, coalesce(known, 0) AS known_rows, (SELECT count(*) FROM e) - coalesce(known, 0) AS missing_rows,
coalesce(n_small, 0) > 0 AS has_hidden_groups, l.field IN (SELECT field FROM ok) AND coalesce(n_unmatched, 0) > 0 AS has_unmatched_groups FROM l LEFT JOIN t ON l.field = t.field""")
def gap_fields(spark, folder):  # noqa: ANN001, ANN201
    _, fields = _gap_tables(spark, folder)
    return fields.drop("field_no", "minimum_group_size")


@_query("SELECT event_type AS \"group\", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events WHERE event_type IS NOT NULL AND trim(event_type) <> '' GROUP BY 1")
def participation_events(spark, folder):  # noqa: ANN001, ANN201
    return gaps.participation(_table(spark, folder, "events"), F.col("event_type")).withColumn("share", _r("share"))


_MASK = r"regexp_replace(regexp_replace(coalesce({x}, ''), '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL_ADDRESS]', 'g'), '(?:https?://|www\.)[^\s<>()]*[^\s<>().,;:!?]', '[URL]', 'g')"


@_query(f"SELECT doc_id, {_MASK.format(x='text')} AS redacted FROM documents")
def redact_email_url(spark, folder):  # noqa: ANN001, ANN201
    return _table(spark, folder, "documents").select("doc_id", redaction.mail_and_links(F.col("text")).alias("redacted"))


@_query()
def redact_full(spark, folder):  # noqa: ANN001, ANN201
    """All five patterns and the contact rule, overlaps merged."""
    return redaction.redact_column(_table(spark, folder, "documents").select("doc_id", "text"), "text", "redacted_text").select("doc_id", "redacted_text", F.to_json("redaction_counts").alias("counts"))


@_query()
def redaction_totals(spark, folder):  # noqa: ANN001, ANN201
    return redaction.redaction_counts(redaction.redact_column(_table(spark, folder, "documents").select("doc_id", "text"), "text", "redacted_text"))


_MARK = r"\[(?:PERSON|EMAIL_ADDRESS|PHONE_NUMBER|STREET_ADDRESS|UNIT_NUMBER|URL)\]"
_SPLIT = r"string_split(regexp_replace({x}, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1))"


@_query(f"""SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(list_filter({_SPLIT.format(x="m")}, lambda s: NOT (regexp_matches(s, '{_MARK}') AND
len(list_filter(regexp_extract_all(lower(regexp_replace(s, '{_MARK}', ' ', 'g')), '\\p{{L}}+'), lambda w: NOT list_contains({_list(_SQL_CONTACT)}, w))) = 0)), lambda s: regexp_replace(s, '{_MARK}', ' ', 'g')), ' '), '{_WS}+', ' ', 'g')) AS analysis_text
FROM (SELECT doc_id, {_MASK.format(x="text")} AS m FROM documents)""")
def analysis_text(spark, folder):  # noqa: ANN001, ANN201
    """Contact boilerplate removed after masking."""
    return _table(spark, folder, "documents").select("doc_id", text.without_boilerplate(redaction.mail_and_links(F.col("text"))).alias("analysis_text"))


_SENT = f"""
t AS (SELECT row_id, {_strip("comment_text")} AS t FROM synthetic_theme_benchmark),
p AS (SELECT row_id, {_SPLIT.format(x="t")} AS parts FROM t WHERE t <> ''),
s AS (SELECT row_id, i - 1 AS sentence_index, parts[i] AS text FROM (SELECT row_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p))"""


def _simple_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = _benchmark(spark, folder).select("row_id", text.strip(F.col("comment_text")).alias("t")).where(F.col("t") != "")
    return rows.select("row_id", F.posexplode(text.sentence_split(F.col("t"))).alias("sentence_index", "text"))


@_query(f"WITH {_SENT} SELECT row_id, sentence_index, text FROM s")
def sentences_simple(spark, folder):  # noqa: ANN001, ANN201
    return _simple_sentences(spark, folder).withColumn("sentence_index", F.col("sentence_index").cast("long"))


@_query(f"""WITH {_SENT}, d AS (SELECT DISTINCT row_id, text FROM s), n AS (SELECT count(*) AS n FROM t WHERE t <> '')
SELECT text AS sentence, count(*) AS df, round(ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1, 6) AS weight FROM d GROUP BY 1""")
def sentence_idf(spark, folder):  # noqa: ANN001, ANN201
    rows = _benchmark(spark, folder).select(F.col("row_id").alias(POSITION), text.strip(F.col("comment_text")).alias("analysis_text")).where(F.col("analysis_text") != "")
    return themes.sentence_weights(rows).select("sentence", "df", _r("weight").alias("weight")).distinct()


@_query(f"""SELECT row_id, len(list_filter(regexp_split_to_array(coalesce(comment_text, ''), '{_WS}+'), lambda x: x <> '')) AS words, regexp_matches(coalesce(comment_text, ''), '\\p{{L}}') AS eligible,
len(list_filter(regexp_split_to_array(coalesce(comment_text, ''), '{_WS}+'), lambda x: x <> '')) BETWEEN 12 AND 60 AS quotable FROM synthetic_theme_benchmark""")
def word_count_eligible(spark, folder):  # noqa: ANN001, ANN201
    c = F.col("comment_text")
    n = text.word_count(c)
    return _benchmark(spark, folder).select("row_id", n.cast("long").alias("words"), text.has_letter(c).alias("eligible"), n.between(12, 60).alias("quotable"))


_FIRST = r"lower(regexp_extract(regexp_replace(tt, '^[ \t\n\x0b\f\r]*(?:(?:\d+[.)]|[-*•])[ \t\n\x0b\f\r]+)?[ \t\n\x0b\f\r" + "\"''“‘(\\[" + r"]*', ''), '^([A-Za-z]+)', 1))"
_QUESTION = f"""{_SENT},
q0 AS (SELECT *, {_strip("text")} AS tt FROM s),
q1 AS (SELECT *, ends_with(regexp_replace(tt, '["''”’)\\]}} ]+$', ''), '?') AS mark, {_FIRST} AS first_word FROM q0),
q AS (SELECT row_id, sentence_index, text, CASE WHEN NOT regexp_matches(tt, '\\p{{L}}') THEN '' ELSE concat_ws(',', CASE WHEN mark THEN 'question_mark' END, CASE WHEN list_contains({_list(_SQL_WH)}, first_word) THEN 'wh_word' WHEN list_contains({_list(_SQL_AUXILIARIES)}, first_word) THEN 'auxiliary' END) END AS reasons FROM q1)"""


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return questions.with_reasons(_simple_sentences(spark, folder)).where("is_question").withColumnRenamed("row_id", POSITION)


@_query(f"WITH {_QUESTION} SELECT row_id, sentence_index, text, reasons, sha256(text) AS text_sha256 FROM q WHERE reasons <> ''")
def question_candidates(spark, folder):  # noqa: ANN001, ANN201
    return _candidates(spark, folder).select(F.col(POSITION).alias("row_id"), F.col("sentence_index").cast("long").alias("sentence_index"), "text", F.array_join("reasons", ",").alias("reasons"), "text_sha256")


@_query(f"WITH {_QUESTION} SELECT b.row_id AS row_position, count(q.row_id) AS question_count FROM synthetic_theme_benchmark b LEFT JOIN (SELECT row_id FROM q WHERE reasons <> '') q ON b.row_id = q.row_id GROUP BY 1")
def comment_question_counts(spark, folder):  # noqa: ANN001, ANN201
    sentences = questions.with_reasons(_simple_sentences(spark, folder)).withColumnRenamed("row_id", POSITION)
    return questions.question_counts(_benchmark(spark, folder), sentences, "row_id")


@_query()
def question_sentences(spark, folder):  # noqa: ANN001, ANN201
    """The sentencizer with verbatim offsets."""
    return questions.sentence_records(_benchmark(spark, folder), position="row_id").select(POSITION, "sentence_index", "source_start", "source_end", "is_question")


_SPREAD = f"""WITH {_QUESTION},
pairs AS (SELECT DISTINCT row_id, reasons AS question_group_id FROM q WHERE reasons <> ''),
known AS ({" UNION ALL ".join(f"SELECT row_id, '{x}' AS field, lower({_strip(x)}) AS category FROM synthetic_theme_benchmark" for x in ("role", "housing_tenure"))}),
cnt AS (SELECT question_group_id, field, category, count(*) AS n FROM pairs JOIN known USING (row_id) WHERE category <> '' GROUP BY 1, 2, 3),
sp AS (SELECT question_group_id, count(*) FILTER (WHERE n >= 10) AS subgroup_spread FROM cnt GROUP BY 1),
g AS (SELECT question_group_id, count(DISTINCT row_id) AS comment_count, count(*) AS sentence_count FROM (SELECT row_id, reasons AS question_group_id FROM q WHERE reasons <> '') GROUP BY 1)
SELECT g.question_group_id, comment_count, sentence_count, subgroup_spread, row_number() OVER (ORDER BY comment_count DESC, coalesce(subgroup_spread, 0) DESC, g.question_group_id) AS rank FROM g LEFT JOIN sp ON g.question_group_id = sp.question_group_id"""


@_query(_SPREAD)
def question_spread_rank(spark, folder):  # noqa: ANN001, ANN201
    """Counts, spread over subgroups and rank of groups of questions (grouped by their reasons here)."""
    rows = _candidates(spark, folder).select(POSITION, "sentence_index", F.array_join("reasons", ",").alias("question_group_id"))
    comments = _benchmark(spark, folder).withColumnRenamed("row_id", POSITION)
    spread = questions.subgroup_spread(rows, comments, ["role", "housing_tenure"])
    groups = rows.groupBy("question_group_id").agg(F.countDistinct(POSITION).alias("comment_count"), F.count(F.lit(1)).alias("sentence_count")).withColumn("text", F.col("question_group_id"))
    return questions.rank_groups(groups, spread).select("question_group_id", "comment_count", "sentence_count", "subgroup_spread", F.col("rank").cast("long").alias("rank"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select(F.col("vec_id").alias(POSITION), F.col("embedding").cast("array<double>").alias("vector"), "label")


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS ue FROM v)"
_C = _V + """, d AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v) GROUP BY 1, 2),
c0 AS (SELECT label, list(m ORDER BY i) AS m FROM d GROUP BY 1), c AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM c0)"""


@_query(f"WITH {_C}, r AS (SELECT u.vec_id, k.vec_id AS response_key, list_dot_product(u.ue, k.ue) AS s FROM u, u k WHERE k.vec_id % 50 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, response_key) AS rn FROM r) SELECT vec_id AS key, response_key, round(s, 6) AS similarity FROM o WHERE rn = 1")
def response_match(spark, folder):  # noqa: ANN001, ANN201
    """Best response of each question; every fiftieth row is the set of responses, all rows are questions."""
    points = _vectors(spark, folder).withColumnRenamed(POSITION, "key")
    responses = points.where(F.col("key") % 50 == 0).withColumnRenamed("key", "response_key")
    return questions.best_matches(points, responses).withColumn("similarity", _r("similarity"))


@_query()
def complete_linkage_groups(spark, folder):  # noqa: ANN001, ANN201
    points = _vectors(spark, folder).select(F.col(POSITION).alias("key"), "vector")
    return questions.group_wordings(points)


@_query(f"WITH {_C} SELECT label, i AS dim, round(x, 6) AS value FROM (SELECT label, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x FROM c)")
def theme_centroids(spark, folder):  # noqa: ANN001, ANN201
    c = themes.centroids(_vectors(spark, folder))
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("dim"), _r("x").alias("value"))


@_query(f"WITH {_C}, s AS (SELECT v.label, vec_id AS row_position, round(list_dot_product(e, c), 9) AS sim FROM v JOIN c ON v.label = c.label) SELECT label, row_position, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY sim DESC, row_position) AS nearest_no FROM s")
def nearest_to_centroid(spark, folder):  # noqa: ANN001, ANN201
    return themes.nearest_to_centroid(_vectors(spark, folder)).select("label", POSITION, _r("similarity").alias("similarity"), F.col("nearest_no").cast("long").alias("nearest_no"))


@_query(f"""WITH {_C}, s AS (SELECT vec_id, v.label, c.label AS l2, list_dot_product(e, c) AS sim FROM v, c), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, l2) AS rn, lead(sim) OVER (PARTITION BY vec_id ORDER BY sim DESC, l2) AS second FROM s)
SELECT vec_id AS row_position, label, CASE WHEN sim >= 0.45 AND sim - second >= 0.03 THEN l2 ELSE label END AS new_label FROM o WHERE rn = 1""")
def refine_step(spark, folder):  # noqa: ANN001, ANN201
    return themes.refine_step(_vectors(spark, folder))


@_query()
def refine_loop(spark, folder):  # noqa: ANN001, ANN201
    return themes.refine(_vectors(spark, folder))


@_query(f'WITH {_C} SELECT a.label AS "left", b.label AS "right", round(greatest(-1, least(1, list_dot_product(a.c, b.c))), 6) AS similarity FROM c a JOIN c b ON a.label < b.label')
def centroid_pairs(spark, folder):  # noqa: ANN001, ANN201
    return themes.centroid_pairs(_vectors(spark, folder)).withColumn("similarity", _r("similarity"))


@_query()
def merge_small(spark, folder):  # noqa: ANN001, ANN201
    return themes.merge_small(_vectors(spark, folder))


@_query(f"""WITH {_V}, d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
x AS (SELECT vec_id, max(CASE WHEN la = lb THEN s / n END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM x""")
def silhouette_euclidean(spark, folder):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(round(themes.silhouette(_vectors(spark, folder)), 6),)], "silhouette double")


@_query()
def kmeans_auto(spark, folder):  # noqa: ANN001, ANN201
    points = _vectors(spark, folder)
    labels, _ = themes.choose_kmeans(points, "auto")
    return themes.display_ids(labels)


@_query()
def density_themes(spark, folder):  # noqa: ANN001, ANN201
    labels, _ = themes.density_labels(_vectors(spark, folder), least_similarity=0.6)
    return labels


_ALNUM = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+"
_TERMS = f"""
w AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_ALNUM}'), lambda x: regexp_full_match(x, '\\p{{L}}{{3,}}') AND NOT regexp_full_match(x, 'x+') AND NOT list_contains({_list(_SQL_STOP)}, x)) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 5000),
wt AS (SELECT doc_id, tf.term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN st ON tf.term = st.term),
ln AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM wt GROUP BY 1),
sz AS (SELECT source, count(*) AS size FROM documents GROUP BY 1)"""


def _document_terms(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(F.col("doc_id").alias(POSITION), F.coalesce("text", F.lit("")).alias("analysis_text"), "source")
    return themes.keyword_scores(docs, docs.select(POSITION, F.col("source").alias("theme_id")))


@_query(f"WITH {_TERMS} SELECT d.source AS theme_id, wt.term, round(sum(w / l) / any_value(size), 6) AS score FROM wt JOIN ln ON wt.doc_id = ln.doc_id JOIN documents d ON d.doc_id = wt.doc_id JOIN sz ON sz.source = d.source GROUP BY 1, 2")
def tfidf_group_terms(spark, folder):  # noqa: ANN001, ANN201
    return _document_terms(spark, folder).withColumn("score", _r("score"))


@_query()
def theme_keywords(spark, folder):  # noqa: ANN001, ANN201
    return themes.top_keywords(_document_terms(spark, folder))


@_query()
def theme_keywords_diverse(spark, folder):  # noqa: ANN001, ANN201
    scores = _document_terms(spark, folder)
    docs = _table(spark, folder, "documents").select(F.col("doc_id").alias(POSITION), "text", F.col("source").alias("label"))
    centers = themes.centroids(themes.hashed_embedding(docs, "text")).withColumnRenamed("label", "theme_id")
    return themes.diverse_keywords(scores, themes.hashed_embedding(scores.select("term").distinct(), "term"), centers)


@_query()
def theme_quotes(spark, folder):  # noqa: ANN001, ANN201
    rows = _benchmark(spark, folder).select(F.col("row_id").alias(POSITION), text.strip(F.col("comment_text")).alias("redacted_text"), F.coalesce("ward", F.lit(0)).alias("theme_id")).where(F.col("redacted_text") != "")
    return themes.select_quotes(themes.hashed_embedding(rows, "redacted_text"), rows.select(POSITION, "theme_id"))


_TOKENS = f"tk AS (SELECT row_id, ward, role, received_at, {_strip('comment_text')} AS t, list_distinct(regexp_extract_all(lower({_strip('comment_text')}), '\\p{{L}}+')) AS tok FROM synthetic_theme_benchmark)"
_GATE = ", ".join(f"{_hits(w)} AS h_{c}" for c, w in _SQL_GATE.items())
_EMO = ", ".join(f"{_hits(_SQL_TONE[e])} + 0.1 AS e_{e}" if e != "neutral" else "1.0 AS e_neutral" for e in EMOTIONS)
_TOP = "greatest(" + ", ".join(f"e_{e}" for e in EMOTIONS) + ")"
_AFFECT = f"""{_TOKENS},
h AS (SELECT *, {_GATE}, {_hits(_SQL_TONE["negative"])} + 0.25 AS neg, {_hits(_SQL_TONE["positive"])} + 0.25 AS pos, {_EMO}, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters FROM tk),
lg AS (SELECT *, CASE WHEN letters < 3 OR h_en + h_es + h_pt + h_pl = 0 THEN 'unknown' {" ".join(f"WHEN h_{c} >= 0.8 * (h_en + h_es + h_pt + h_pl) THEN '{c}'" for c in _SQL_GATE)} ELSE 'unknown' END AS language FROM h),
st AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN language = 'en' THEN 'scored' ELSE 'excluded_language' END AS status FROM lg),
a AS (SELECT row_id, ward, role, received_at, t, language, status, CASE WHEN status = 'scored' THEN CASE WHEN neg >= 1 AND neg >= pos THEN 'negative' WHEN 1 >= pos THEN 'neutral' ELSE 'positive' END END AS sentiment,
CASE WHEN status = 'scored' THEN CASE {" ".join(f"WHEN e_{e} = {_TOP} THEN '{e}'" for e in EMOTIONS)} END END AS emotion,
CASE WHEN status = 'scored' THEN (pos - neg) / (pos + neg + 1) END AS score, neg / (pos + neg + 1) AS pn, 1 / (pos + neg + 1) AS pz, pos / (pos + neg + 1) AS pp FROM st)"""
_AGG = "count(*) AS total_comments, count(*) FILTER (WHERE status = 'scored') AS scored_comments, round(avg(score), 6) AS mean_sentiment, " + ", ".join(f"count(*) FILTER (WHERE sentiment = '{s}') AS sentiment_{s}" for s in SENTIMENTS) + ", " + ", ".join(f"count(*) FILTER (WHERE emotion = '{e}') AS emotion_{e}" for e in EMOTIONS)
_AGG_NAMES = ["total_comments", "scored_comments", "mean_sentiment", *[f"sentiment_{s}" for s in SENTIMENTS], *[f"emotion_{e}" for e in EMOTIONS]]


def _affect(spark: SparkSession, folder: str) -> DataFrame:
    return affect.analyse_affect(_benchmark(spark, folder), position="row_id")


def _affect_with(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _affect(spark, folder).join(_benchmark(spark, folder).select(F.col("row_id").alias(POSITION), *columns), POSITION)


def _aggregated(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[_r(c).alias(c) if c == "mean_sentiment" else c for c in _AGG_NAMES])


@_query(f"WITH {_AFFECT} SELECT row_id AS row_position, language, status, sentiment, emotion, round(score, 6) AS sentiment_score FROM a".replace("language, status", "CASE WHEN t = '' THEN 'unknown' ELSE language END AS language, status", 1).replace("SELECT row_id, ward, role, received_at, t, CASE WHEN t = '' THEN 'unknown' ELSE language END AS language, status", "SELECT row_id, ward, role, received_at, t, language, status"))
def affect_rows(spark, folder):  # noqa: ANN001, ANN201
    return _affect(spark, folder).select(POSITION, "language", "status", "sentiment", "emotion", _r("sentiment_score").alias("sentiment_score"))


@_query(f"WITH {_AFFECT} SELECT CAST(ward AS VARCHAR) AS \"group\", {_AGG} FROM a GROUP BY 1")
def affect_by_group(spark, folder):  # noqa: ANN001, ANN201
    return _aggregated(affect.aggregate_affect(_affect_with(spark, folder, "ward"), F.col("ward").cast("string")), "group")


@_query(f"WITH {_AFFECT} SELECT 'all' AS \"group\", {_AGG} FROM a")
def affect_overall(spark, folder):  # noqa: ANN001, ANN201
    return _aggregated(affect.aggregate_affect(_affect(spark, folder), F.lit("all")), "group")


@_query(f"WITH {_AFFECT} SELECT 'ward' AS level, CAST(ward AS VARCHAR) AS \"group\", {_AGG} FROM a GROUP BY 2 UNION ALL SELECT 'role', role, {_AGG} FROM a GROUP BY 2 UNION ALL SELECT 'all', 'all', {_AGG} FROM a")
def group_sets_affect(spark, folder):  # noqa: ANN001, ANN201
    """Two groupings and the total in one pass."""
    return _aggregated(affect.aggregate_affect_sets(_affect_with(spark, folder, "ward", "role"), ["ward", "role"]), "level", "group")


@_query(f"WITH {_AFFECT} SELECT count(*) FILTER (WHERE status = 'scored') AS scored_count, count(*) FILTER (WHERE status = 'excluded_language') AS excluded_language_count, count(*) FILTER (WHERE status = 'empty') AS empty_count, CAST(0 AS BIGINT) AS truncated_count FROM a")
def affect_status(spark, folder):  # noqa: ANN001, ANN201
    return affect.status_counts(_affect(spark, folder))


@_query(f"WITH {_AFFECT} SELECT language, count(*) AS n FROM a WHERE status <> 'empty' GROUP BY 1")
def affect_languages(spark, folder):  # noqa: ANN001, ANN201
    return affect.language_counts(_affect(spark, folder))


@_query(f"WITH {_AFFECT} SELECT row_id AS row_position, round(list_sort([pn, pz, pp], 'DESC')[1] - list_sort([pn, pz, pp], 'DESC')[2], 6) AS gap FROM a WHERE status = 'scored'")
def score_gap(spark, folder):  # noqa: ANN001, ANN201
    return _affect(spark, folder).where(F.col("status") == "scored").select(POSITION, _r(affect.score_gap(F.col("sentiment_probabilities"))).alias("gap"))


_PERIOD = f"{_AFFECT}, pd AS (SELECT *, coalesce(strftime(received_at, '%Y-%m-%d'), 'Missing period') AS period FROM a), ps AS (SELECT period, {_AGG}, row_number() OVER (ORDER BY period = 'Missing period', period) AS period_no FROM pd WHERE status <> 'empty' GROUP BY 1)"


def _periods(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _benchmark(spark, folder).select("row_id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received"))
    with_period, mode, _ = timeline.with_period(rows, "received")
    return with_period, timeline.period_affect(_affect(spark, folder), with_period, mode, "row_id")


@_query(f"WITH {_PERIOD} SELECT period, {', '.join(_AGG_NAMES)}, period_no FROM ps")
def timeline_periods(spark, folder):  # noqa: ANN001, ANN201
    return _aggregated(_periods(spark, folder)[1].withColumn("period_no", F.col("period_no").cast("long")), "period", "period_no")


@_query()
def hearing_labels(spark, folder):  # noqa: ANN001, ANN201
    """Hearing dates as they were typed: not all are dates, so all become redacted labels."""
    rows, _, _ = timeline.with_period(_benchmark(spark, folder).select("row_id", "hearing_date"))
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_PERIOD}, th AS (SELECT DISTINCT coalesce(ward, 0) AS theme_id FROM a), ct AS (SELECT period, coalesce(ward, 0) AS theme_id, count(*) AS n FROM pd GROUP BY 1, 2) SELECT ps.period, th.theme_id, coalesce(ct.n, 0) AS n FROM ps CROSS JOIN th LEFT JOIN ct ON ct.period = ps.period AND ct.theme_id = th.theme_id")
def theme_volumes(spark, folder):  # noqa: ANN001, ANN201
    """Zero-filled volume of each period and theme (wards stand for themes here)."""
    periods, summary = _periods(spark, folder)
    assignments = _benchmark(spark, folder).select(F.col("row_id").alias(POSITION), F.coalesce("ward", F.lit(0)).alias("theme_id"))
    return timeline.theme_volumes(assignments, periods, summary, "row_id")


@_query(f"WITH {_PERIOD}, o AS (SELECT * FROM ps WHERE period <> 'Missing period' AND scored_comments > 0) SELECT min(period) AS first_day, arg_min(mean_sentiment, period) AS first_score, max(period) AS last_day, arg_max(mean_sentiment, period) AS last_score, count(*) AS n_days, coalesce((SELECT sum(total_comments) FROM ps WHERE period = 'Missing period'), 0) AS undated_comments FROM o")
def first_last_period(spark, folder):  # noqa: ANN001, ANN201
    found = timeline.first_and_last(_periods(spark, folder)[1])
    return found.withColumns({"first_score": _r("first_score"), "last_score": _r("last_score")})


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type AS \"group\", count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2".replace("time_bucket(INTERVAL 1 DAY, ts) AS day", "strftime(ts, '%Y-%m-%d') AS day"))
def daily_volume(spark, folder):  # noqa: ANN001, ANN201
    """The windowed aggregate that also runs as a stream."""
    rows = windows.daily_volume(_table(spark, folder, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "group", "n", _r("mean_value").alias("mean_value"))


@_query(r"SELECT row_id, hearing_date, strftime(coalesce(CASE WHEN regexp_matches(trim(hearing_date), '^\d{4}-\d{1,2}-\d{1,2}') THEN try_cast(regexp_replace(trim(hearing_date), '[TZ]', ' ', 'g') AS TIMESTAMP) END, try_strptime(trim(hearing_date), '%m/%d/%Y')), '%Y-%m-%d') AS day FROM synthetic_theme_benchmark")
def parsed_days(spark, folder):  # noqa: ANN001, ANN201
    return _benchmark(spark, folder).select("row_id", "hearing_date", dates.day_of(F.col("hearing_date")).alias("day"))



def _safe(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^{_WS}*[=+\\-@]') OR regexp_matches({x}, '^[\\t\\r\\n]') THEN '''' || {x} ELSE {x} END"



@_query(f"""WITH {_QUESTION}, {_AFFECT.replace("q AS", "qq AS")}, qc AS (SELECT row_id, count(*) AS c, string_agg(DISTINCT reasons, ';' ORDER BY reasons) AS g FROM q WHERE reasons <> '' GROUP BY 1), rd AS (SELECT row_id, {_MASK.format(x="comment_text")} AS m FROM synthetic_theme_benchmark)
SELECT a.row_id + 1 AS cleaned_comment_number, {_safe("rd.m")} AS redacted_comment, ward AS theme_id, CASE WHEN coalesce(ward, 0) = 0 THEN '' ELSE 'Ward ' || ward END AS theme_label, CASE WHEN ward IS NULL THEN 'excluded' WHEN ward = 0 THEN 'ungrouped' ELSE 'assigned' END AS theme_status,
coalesce(sentiment, '') AS sentiment, coalesce(emotion, '') AS emotion, round(score, 6) AS sentiment_score, status AS affect_status, false AS affect_truncated, coalesce(c, 0) AS question_count, coalesce(g, '') AS question_group_ids,
{", ".join(f"round(CASE WHEN status = 'scored' THEN {p} END, 6) AS sentiment_{k}_probability" for k, p in (("negative", "pn"), ("neutral", "pz"), ("positive", "pp")))},
round(CASE WHEN status = 'scored' THEN list_sort([pn, pz, pp], 'DESC')[1] - list_sort([pn, pz, pp], 'DESC')[2] END, 6) AS sentiment_score_gap
FROM a JOIN rd ON a.row_id = rd.row_id LEFT JOIN qc ON qc.row_id = a.row_id""")
def labeled_export(spark, folder):  # noqa: ANN001, ANN201
    """The labelled table with formula-like text made safe (wards stand for themes, reasons for question groups here)."""
    from .sources import sinks

    base = _benchmark(spark, folder)
    comments = base.select(F.col("row_id").alias(POSITION), redaction.mail_and_links(F.col("comment_text")).alias("redacted_text"))
    assignments = base.where(F.col("ward").isNotNull()).select(F.col("row_id").alias(POSITION), F.col("ward").alias("theme_id"))
    named = assignments.where(F.col("theme_id") > 0).select("theme_id").distinct().withColumn("label", F.concat(F.lit("Ward "), F.col("theme_id").cast("string")))
    found = _candidates(spark, folder)
    counts = found.groupBy(POSITION).agg(F.count(F.lit(1)).alias("question_count"))
    groups = found.select(POSITION, F.array_join("reasons", ",").alias("question_group_id"))
    table = export.labelled(comments, assignments=assignments, themes=named, affect=_affect(spark, folder), question_counts=counts, question_groups=groups)
    return sinks.guard_strings(table.withColumns({c: _r(c) for c in ("sentiment_score", *[f"sentiment_{k}_probability" for k in SENTIMENTS], "sentiment_score_gap")}))


_CODE = "CASE lower(trim(language)) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in (("english", "en"), ("en", "en"), ("eng.", "en"), ("en-us", "en"), ("inglés", "en"), ("spanish", "es"), ("es", "es"), ("español", "es"), ("castellano", "es"), ("polish", "pl"), ("pl", "pl"), ("polski", "pl"), ("portuguese", "pt"), ("pt-br", "pt"), ("português", "pt"))) + " END"


def _labels_and_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _benchmark(spark, folder).select(F.col("row_id").alias(POSITION), F.expr(_CODE).alias("truth"))
    return _affect(spark, folder).where(F.col("status") != "empty").join(rows, POSITION).select("truth", F.col("language").alias("predicted"))


_LABELS = f"{_AFFECT}, tr AS (SELECT row_id, {_CODE} AS truth FROM synthetic_theme_benchmark), lp AS (SELECT truth, language AS predicted FROM a JOIN tr USING (row_id) WHERE t <> '')"


@_query(f"WITH {_LABELS} SELECT truth, predicted, count(*) AS n FROM lp WHERE truth IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark, folder):  # noqa: ANN001, ANN201
    """Every labelled comment; what the gate can't tell counts as unknown."""
    return evaluate.confusion(_labels_and_gate(spark, folder), "truth", "predicted")


@_query(f"WITH {_LABELS} SELECT 'all' AS \"group\", count(truth) AS labelled, count(truth) AS scored, round(avg(CASE WHEN truth IS NOT NULL THEN CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END END), 6) AS agreement, coalesce(avg(CASE WHEN truth IS NOT NULL THEN CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END END) < 0.7, false) AS needs_work FROM lp UNION ALL SELECT 'told apart', count(truth), count(truth) FILTER (WHERE predicted <> 'unknown'), round(avg(CASE WHEN truth IS NOT NULL AND predicted <> 'unknown' THEN CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END END), 6), coalesce(avg(CASE WHEN truth IS NOT NULL AND predicted <> 'unknown' THEN CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END END) < 0.7, false) FROM lp")
def label_agreement(spark, folder):  # noqa: ANN001, ANN201
    """Agreement over all labelled comments, unknown ones as misses, and over those that the gate tells."""
    rows = _labels_and_gate(spark, folder)
    told = rows.withColumns({"predicted": F.when(F.col("predicted") != "unknown", F.col("predicted")), "part": F.lit("told apart")})
    return evaluate.agreement(rows.withColumn("part", F.lit("all")).unionByName(told), "truth", "predicted", group="part").withColumn("agreement", _r("agreement"))


@_query(f"""WITH {_QUESTION}, z AS (SELECT b.row_id, contains(coalesce(b.comment_text, ''), '?') AS truth, count(q.row_id) > 0 AS predicted FROM synthetic_theme_benchmark b LEFT JOIN (SELECT row_id FROM q WHERE reasons <> '') q ON b.row_id = q.row_id GROUP BY 1, 2),
k2 AS (SELECT count(*) FILTER (WHERE truth AND predicted) AS tp, count(*) FILTER (WHERE NOT truth AND predicted) AS fp, count(*) FILTER (WHERE NOT truth AND NOT predicted) AS tn, count(*) FILTER (WHERE truth AND NOT predicted) AS fn FROM z)
SELECT tp AS true_positive, fp AS false_positive, tn AS true_negative, fn AS false_negative, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS false_positive_rate, tp / (tp + fn) >= 0.8 AND fp / (fp + tn) < 0.1 AS accepted FROM k2""")
def recall_fpr(spark, folder):  # noqa: ANN001, ANN201
    sentences = questions.with_reasons(_simple_sentences(spark, folder)).withColumnRenamed("row_id", POSITION)
    base = _benchmark(spark, folder)
    counts = questions.question_counts(base, sentences, "row_id")
    rows = base.select(F.col("row_id").alias(POSITION), F.coalesce("comment_text", F.lit("")).contains("?").alias("truth")).join(counts, POSITION)
    found = evaluate.recall_and_false_positives(rows, F.col("truth"), F.col("question_count") > 0)
    return found.withColumns({"recall": _r("recall"), "false_positive_rate": _r("false_positive_rate")})


@_query("""WITH c AS (SELECT role AS a, housing_tenure AS b, CAST(count(*) AS DOUBLE) AS n FROM synthetic_theme_benchmark WHERE role IS NOT NULL AND housing_tenure IS NOT NULL GROUP BY 1, 2),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS same, (SELECT sum(n) FROM c) AS total, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS pa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS pb)
SELECT CAST(total AS BIGINT) AS n, round((same - pa * pb / (total * (total - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (total * (total - 1) / 2)), 6) AS ari FROM x""")
def adjusted_rand(spark, folder):  # noqa: ANN001, ANN201
    return evaluate.adjusted_rand(_benchmark(spark, folder), "role", "housing_tenure").withColumn("ari", _r("ari"))


@_query("SELECT doc_id, source FROM documents ORDER BY sha256('plenum' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_sample(spark, folder):  # noqa: ANN001, ANN201
    """A sampling operator: the limit is its size."""
    return evaluate.hash_sample(_table(spark, folder, "documents").select("doc_id", "source"), 100, key="doc_id")


@_query("""WITH b AS (SELECT CAST(floor(doc_id / 4096) AS BIGINT) AS block, count(*) AS n, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY block)) AS fingerprint FROM b""")
def corpus_fingerprint(spark, folder):  # noqa: ANN001, ANN201
    return evaluate.corpus_fingerprint(_table(spark, folder, "documents"), order="doc_id", column="text")


@_query()
def html_text(spark, folder):  # noqa: ANN001, ANN201
    return _table(spark, folder, "federal_sample").select("source_id", tables.html_text(F.col("comment_text")).alias("plain"))


_RECONCILE = f"""WITH {_PERIOD}, asg AS (SELECT row_id, coalesce(ward, 0) AS theme_id FROM a WHERE status <> 'empty'), th AS (SELECT DISTINCT theme_id FROM asg),
vol AS (SELECT sum(k) AS n FROM (SELECT (SELECT count(*) FROM asg JOIN pd ON asg.row_id = pd.row_id WHERE pd.period = ps.period AND asg.theme_id = th.theme_id) AS k FROM ps CROSS JOIN th)),
num AS (SELECT (SELECT count(*) FROM synthetic_theme_benchmark) AS nc, (SELECT count(DISTINCT row_id) FROM synthetic_theme_benchmark) AS np, (SELECT count(*) FROM asg) AS na, (SELECT count(DISTINCT row_id) FROM asg) AS nd,
(SELECT count(*) FROM a) AS nf, (SELECT count(*) FROM a WHERE status <> 'empty') AS ne, (SELECT n FROM vol) AS nv, (SELECT sum(total_comments) FROM ps) AS npd)"""
_CHECKS = ("positions_unique", "assignments_unique", "assignments_known", "affect_rows_match", "theme_volumes_match", "period_totals_match", "suppressed_hidden")


def _checks_sql(values: str) -> str:
    return f"{_RECONCILE} SELECT unnest({_list(_CHECKS)}) AS \"check\", unnest([{values}]) AS passed FROM num"


def _reconciled(spark: SparkSession, folder: str, *, corrupt: bool) -> DataFrame:
    base = _benchmark(spark, folder).withColumnRenamed("row_id", POSITION)
    # The scored rows feed four of the inputs: they are worked out once.
    rows = checkpointed(_affect(spark, folder))
    dated = base.select(F.col(POSITION), F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received"))
    periods, mode, _ = timeline.with_period(dated, "received")
    summary = timeline.period_affect(rows, periods, mode)
    assignments = base.join(rows.where(F.col("status") != "empty").select(POSITION), POSITION, "left_semi").select(POSITION, F.coalesce("ward", F.lit(0)).alias("theme_id"))
    volumes = timeline.theme_volumes(assignments, periods, summary)
    hidden = _gap_tables(spark, folder)[0]
    if corrupt:
        # A row named twice, one that doesn't exist, a lost row of affect, and a hidden cell that shows its count.
        first = assignments.orderBy(POSITION).limit(1)
        assignments = assignments.unionByName(first).unionByName(first.withColumn(POSITION, F.lit(-7).cast("long")))
        rows = rows.join(first.select(POSITION), POSITION, "left_anti")
        hidden = hidden.withColumn("count", F.coalesce("count", F.lit(3).cast("long")))
    return evaluate.reconcile(comments=base, assignments=assignments, affect=rows, volumes=volumes, periods=summary, gap_rows=hidden)


@_query(_checks_sql("nc = np, na = nd, (SELECT count(*) FROM asg WHERE row_id NOT IN (SELECT row_id FROM synthetic_theme_benchmark)) = 0, nf = nc, nv = na, npd = ne, (SELECT count(*) FROM (SELECT CASE WHEN n < 10 THEN NULL ELSE n END AS shown, n FROM (SELECT role, count(*) AS n FROM synthetic_theme_benchmark GROUP BY 1)) WHERE n < 10 AND shown IS NOT NULL) = 0"))
def reconcile_checks(spark, folder):  # noqa: ANN001, ANN201
    """Counts that must agree across the tables of one analysis."""
    return _reconciled(spark, folder, corrupt=False)


@_query(_checks_sql("nc = np, na + 2 = nd + 1, 1 = 0, nf - 1 = nc, nv = na + 2, npd = ne - 1, 3 IS NULL"))
def reconcile_corrupted(spark, folder):  # noqa: ANN001, ANN201
    """The same checks over damaged tables: each damage must be seen."""
    return _reconciled(spark, folder, corrupt=True)


@_query("SELECT source_id, comment_text FROM federal_sample WHERE source_id IN (SELECT source_id FROM federal_sample GROUP BY 1 HAVING count(*) % 2 = 1) EXCEPT ALL SELECT source_id, comment_text FROM federal_sample WHERE false".replace("EXCEPT ALL SELECT source_id, comment_text FROM federal_sample WHERE false", ""))
def odd_repeats(spark, folder):  # noqa: ANN001, ANN201
    """Rows whose id occurs an odd number of times, as the symmetric difference with the rows of the other ids."""
    rows = _table(spark, folder, "federal_sample").select("source_id", "comment_text")
    even = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 0).select("source_id")
    return evaluate.symmetric_difference(rows, rows.join(even, "source_id", "left_semi"))


@_query(f"WITH {_AFFECT} SELECT count(*) FILTER (WHERE status = 'scored') AS scored, count(*) FILTER (WHERE status <> 'scored') AS unscored, CAST(0 AS BIGINT) AS truncated, {', '.join(f'round(100.0 * count(*) FILTER (WHERE sentiment = {chr(39)}{s}{chr(39)}) / count(*) FILTER (WHERE status = {chr(39)}scored{chr(39)}), 0) AS {s}_percent' for s in SENTIMENTS)} FROM a")
def brief_sentiment(spark, folder):  # noqa: ANN001, ANN201
    return brief.sentiment_shares(_affect(spark, folder))


@_query(f"""WITH {_GAPS}, y AS (SELECT field, coalesce(ref_label, label) AS "group", (n / known - ppm / 1000000) * 100 AS g FROM x WHERE reason IS NULL AND ppm > 0 AND n * 100000000 < 75 * ppm * known) SELECT field, "group", round(g, 6) AS gap_percentage_points FROM y WHERE g < 0 ORDER BY g, field, "group" LIMIT 2""")
def brief_worst_gaps(spark, folder):  # noqa: ANN001, ANN201
    """The report of the two largest gaps."""
    return brief.worst_gaps(_gap_tables(spark, folder)[0]).select("field", "group", _r("gap_percentage_points").alias("gap_percentage_points"))


@_query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, folder):  # noqa: ANN001, ANN201
    return _table(spark, folder, "embeddings").select("vec_id", _r(vectors.norm(vectors.as_double(F.col("embedding")))).alias("norm"))


@_query()
def synthetic_hearing(spark, folder):  # noqa: ANN001, ANN201
    """Invented comments of the hearing schema, from rules and a seed."""
    return synthetic.hearing_comments(spark, 1000)


@_query("SELECT count(*) AS n_rows, count(DISTINCT row_id) AS n_ids, count(*) FILTER (WHERE trim(coalesce(comment_text, '')) = '') > 0 AS has_blanks, count(*) = count(DISTINCT row_id) AS ids_unique FROM synthetic_theme_benchmark")
def fixture_facts(spark, folder):  # noqa: ANN001, ANN201
    """What a fixture's manifest is held against."""
    return synthetic.fixture_facts(_benchmark(spark, folder), key="row_id", column="comment_text")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

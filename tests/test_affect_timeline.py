import pytest
from pyspark.sql import functions as F

from plenum.errors import TimelineError
from plenum.operators import affect, timeline

ROWS = "row_position long, status string, sentiment string, emotion string, sentiment_score double, theme int"


def test_aggregate(spark):
    df = spark.createDataFrame([(0, "scored", "positive", "joy", 0.7, 1), (1, "empty", None, None, None, 1), (2, "excluded_language", None, None, None, 0)], ROWS)
    out = {r["group"]: r for r in affect.aggregate_affect(df, "theme").collect()}
    assert out[1]["sentiment_positive_share"] == 1 and out[1]["excluded_comments"] == 1 and out[1]["dominant_emotion"] == "joy"
    assert out[0]["mean_sentiment"] is None and out[0]["dominant_emotion"] is None and out[0]["dominant_emotion_ties"] == []


def test_emotion_ties_keep_label_order(spark):
    df = spark.createDataFrame([(0, "scored", "positive", "joy", 0.1, 1), (1, "scored", "positive", "fear", 0.1, 1)], ROWS)
    r = affect.aggregate_affect(df, "theme").first()
    assert r["dominant_emotion"] is None and r["dominant_emotion_ties"] == ["fear", "joy"]


def test_score_gap(spark):
    def gap(*p):
        m = F.create_map(*[x for k, v in zip(("negative", "neutral", "positive"), p, strict=True) for x in (F.lit(k), F.lit(v))])
        return spark.range(1).select(affect.score_gap(m).alias("g")).first()["g"]

    assert abs(gap(0.49, 0.5, 0.01) - 0.01) < 1e-9 and gap(0.5, 0.5, 0.0) == 0
    assert gap(0.9, 0.5, 0.1) is None and gap(float("nan"), 0.5, 0.5) is None


def test_language_gate_and_scoring(spark):
    df = spark.createDataFrame([(0, "This is a good plan for all of the children and we thank you"), (1, "No entiendo por que todos los niños llegan tarde a la escuela"), (2, "  "), (3, None), (4, "??")], "row_position long, comment_text string")
    out = {r["row_position"]: r for r in affect.analyse_affect(df).collect()}
    assert out[0]["status"] == "scored" and out[0]["sentiment"] == "positive"
    assert out[1]["status"] == "excluded_language" and out[1]["sentiment"] is None
    assert out[2]["status"] == out[3]["status"] == "empty" and out[4]["language"] == "unknown"


def test_custom_scorer_sees_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(df):
        seen.add(df.count())
        m = F.create_map(F.lit("negative"), F.lit(0.1), F.lit("neutral"), F.lit(0.2), F.lit("positive"), F.lit(0.7))
        e = F.create_map(*[x for k in ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise") for x in (F.lit(k), F.lit(1 / 7))])
        return df.withColumns({"sentiment_probabilities": m, "emotion_probabilities": e, "truncated": F.lit(False)})

    df = spark.createDataFrame([(k, "we are all on the same bus") for k in range(5)], "row_position long, comment_text string")
    out = affect.analyse_affect(df, scorer=scorer)
    assert out.where("sentiment = 'positive' AND emotion = 'anger'").count() == 5 and seen.value == 1


def periods(spark, values, scores):
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(values)], "row_position long, date_or_hearing string, comment_text string")
    rows = spark.createDataFrame([(k, "scored", "neutral", "neutral", s, 1) for k, s in enumerate(scores)], ROWS)
    p, mode, _ = timeline.with_period(df)
    return p, mode, timeline.period_affect(rows, p, mode)


def test_date_periods_in_order(spark):
    p, mode, summary = periods(spark, ["2026-10-02", "", "2026-10-01"], [0.1, 0.2, 0.3])
    assert mode == "date" and [r["period"] for r in summary.orderBy("period_no").collect()] == ["2026-10-01", "2026-10-02", "Missing period"]
    assignments = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "row_position long, theme_id int")
    volumes = timeline.theme_volumes(assignments, p, summary).collect()
    assert len(volumes) == 6 and sum(r["n"] for r in volumes) == 3
    found = timeline.first_and_last(summary).first()
    assert (found["first_day"], found["last_day"], found["n_days"], found["undated_comments"]) == ("2026-10-01", "2026-10-02", 2, 1)


def test_label_and_single_periods(spark):
    _, mode, summary = periods(spark, ["2026-10-02", "Hearing two", ""], [0.0, 0.0, 0.0])
    assert mode == "hearing_label" and [r["period"] for r in summary.orderBy("period_no").collect()] == ["2026-10-02", "Hearing two", "Missing period"]
    df = spark.createDataFrame([(0, "x")], "row_position long, comment_text string")
    assert timeline.with_period(df)[1] == "single_period"
    with pytest.raises(TimelineError):
        timeline.with_period(df, "nope")
    with pytest.raises(TimelineError):
        timeline.check_positions(spark.createDataFrame([(0, 1), (0, 2)], "row_position long, theme_id int"), 1)

"""The labelled table: every comment with its theme, tone and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ExportError
from ..operators.affect import score_gap
from ..schema import POSITION, SENTIMENTS


def labelled(comments: DataFrame, *, assignments: DataFrame, themes: DataFrame, affect: DataFrame, question_counts: DataFrame, question_groups: DataFrame) -> DataFrame:
    """One row for each redacted comment (row_position, redacted_text), joined by position; other columns are refused.

    Theme labels are one row a theme and are broadcast by AQE; the other sides share the position, so one
    partitioning serves all joins.
    """
    if set(comments.columns) != {POSITION, "redacted_text"}:
        raise ExportError("The export takes the redacted comments and nothing else.")
    groups = question_groups.groupBy(POSITION).agg(F.concat_ws(";", F.sort_array(F.collect_set("question_group_id"))).alias("question_group_ids"))
    joined = comments.join(assignments.select(POSITION, "theme_id"), POSITION, "left").join(affect, POSITION, "left").join(question_counts, POSITION, "left").join(groups, POSITION, "left").join(themes.select("theme_id", F.col("label").alias("theme_label")), "theme_id", "left")
    s = F.col("sentiment_probabilities")
    status = F.when(F.col("theme_id").isNull(), "excluded").when(F.col("theme_id") == 0, "ungrouped").otherwise("assigned")
    return joined.select(
        (F.col(POSITION) + 1).alias("cleaned_comment_number"),
        F.col("redacted_text").alias("redacted_comment"),
        "theme_id",
        F.coalesce("theme_label", F.lit("")).alias("theme_label"),
        status.alias("theme_status"),
        F.coalesce("sentiment", F.lit("")).alias("sentiment"),
        F.coalesce("emotion", F.lit("")).alias("emotion"),
        "sentiment_score",
        F.col("status").alias("affect_status"),
        F.coalesce("truncated", F.lit(False)).alias("affect_truncated"),
        F.coalesce("question_count", F.lit(0)).cast("long").alias("question_count"),
        F.coalesce("question_group_ids", F.lit("")).alias("question_group_ids"),
        *[s[k].alias(f"sentiment_{k}_probability") for k in SENTIMENTS],
        score_gap(s).alias("sentiment_score_gap"),
    )

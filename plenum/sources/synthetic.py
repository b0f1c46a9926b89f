"""Invented comments for trials, made by rules from a seed, and the facts a fixture is checked by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Each topic has openings, objects and closings of its own; a row's topic is its number modulo their count.
TOPICS = {
    "buses": (("Our bus is late again", "Route changes left us waiting", "Nobody answers about the bus"), ("since the merger", "every rainy morning", "before the first bell"), ("Please fix the schedule.", "When will this change?")),
    "books": (("Our class shares one book", "The library has empty shelves", "Pupils copy pages by hand"), ("for the whole spring", "after the cuts", "in two schools"), ("Please buy more books.", "Can the board help?")),
    "ramps": (("The ramp is too narrow", "The lift stopped working", "Wheelchair users wait outside"), ("at the side door", "during hearings", "all winter"), ("Please repair it.", "Who is responsible?")),
    "letters": (("Nobody answered my letter", "The notice came one day early", "Minutes were never posted"), ("about the vote", "about the budget", "about the hearing"), ("Please answer in writing.", "How can we follow this?")),
}
# Values and their weights.
ROLES = (("Parent", 55), ("Resident", 20), ("Teacher", 12), ("Student", 8), ("Community organizer", 5))
TENURES = (("Renter", 68), ("Owner", 25), ("Other", 7))
LANGUAGES = (("English", 82), ("Spanish", 10), ("Polish", 4), ("Mandarin", 4))
DATES = (("2026-09-02", 30), ("2026-09-07", 33), ("2026-09-12", 37))
WARDS = (("5", 8), ("6", 12), ("7", 18), ("8", 30), ("10", 22), ("20", 10))


def _draw(seed: int, salt: str) -> Column:
    """A number from 0 to 99 for each row, the same in every run and partitioning."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}:{salt}")), F.lit(100))


def _weighted(values: tuple[tuple[str, int], ...], seed: int, salt: str) -> Column:
    """A value with the chance of its weight; the weights add up to 100."""
    pick, below = F.lit(values[-1][0]), 100
    for value, weight in reversed(values):
        pick = F.when(_draw(seed, salt) < below, F.lit(value)).otherwise(pick)
        below -= weight
    return pick


def _choice(values: tuple[str, ...], seed: int, salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}:{salt}")), F.lit(len(values))) + 1).cast("int"))


def hearing_comments(spark: SparkSession, rows: int, seed: int = 20260915) -> DataFrame:
    """respondent_id, comment_text, hearing_date, ward, role, language, housing_tenure, validation_theme.

    One comment in twelve names a contact and one in twelve an address, for redaction.
    """
    base = spark.range(rows)
    text, theme = F.lit(""), F.lit("")
    for k, (topic, (openings, times, closings)) in enumerate(TOPICS.items()):
        here = F.col("id") % len(TOPICS) == k
        sentence = F.concat(_choice(openings, seed, "o"), F.lit(" "), _choice(times, seed, "t"), F.lit(". "), _choice(closings, seed, "c"))
        text, theme = F.when(here, sentence).otherwise(text), F.when(here, F.lit(topic)).otherwise(theme)
    number = F.col("id").cast("string")
    contact = F.when(_draw(seed, "contact") < 8, F.concat(F.lit(" Contact person"), number, F.lit("@example.org."))).otherwise("")
    address = F.when(_draw(seed, "address") < 8, F.concat(F.lit(" I live at "), (F.col("id") % 900 + 10).cast("string"), F.lit(" Oak Street."))).otherwise("")
    return base.select(
        F.concat(F.lit("SYN-"), F.lpad(number, 7, "0")).alias("respondent_id"),
        F.concat(text, contact, address).alias("comment_text"),
        _weighted(DATES, seed, "date").alias("hearing_date"),
        _weighted(WARDS, seed, "ward").cast("int").alias("ward"),
        _weighted(ROLES, seed, "role").alias("role"),
        _weighted(LANGUAGES, seed, "language").alias("language"),
        _weighted(TENURES, seed, "tenure").alias("housing_tenure"),
        theme.alias("validation_theme"),
    )


def fixture_facts(df: DataFrame, *, key: str, column: str) -> DataFrame:
    """One row (n_rows, n_ids, has_blanks, ids_unique) to hold against a manifest."""
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_ids"), F.count_if(F.trim(F.coalesce(F.col(column), F.lit(""))) == "").alias("b"))
    return agg.select("n_rows", "n_ids", (F.col("b") > 0).alias("has_blanks"), (F.col("n_rows") == F.col("n_ids")).alias("ids_unique"))

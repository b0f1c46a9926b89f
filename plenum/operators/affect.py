"""Tone of comments: language gate, scores, and their aggregates by group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AffectError
from ..functions import text
from ..schema import COMMENT, EMOTIONS, POSITION, SENTIMENTS

#: A scorer turns a table with a column `scoring_text` into one with the columns `sentiment_probabilities` and
#: `emotion_probabilities` (maps of label to probability) and `truncated`.
Scorer = Callable[[DataFrame], DataFrame]

# Word lists of the default scorer and the default language gate, written for this project.
LEXICON = {
    "positive": "good great thank thanks grateful helpful encouraged relieved hopeful support safe love like better best happy improve improved welcome appreciate works clear".split(),
    "negative": "bad angry tired baffled ignored worn unsafe broken late missing lost slow worse worst unhappy fail failed fails crisis cut closed afraid sad unconvinced overwhelmed".split(),
    "anger": "angry furious ignored outraged unfair".split(),
    "disgust": "disgusting filthy shameful gross".split(),
    "fear": "afraid unsafe scared worried danger dangerous".split(),
    "joy": "happy love grateful glad relieved encouraged hopeful thank thanks".split(),
    "sadness": "sad tired lost worn lonely cry".split(),
    "surprise": "surprised unexpected suddenly baffled".split(),
}
STOP_WORDS = {
    "en": "the of and to in is that for it was on are as with at be this from have not but what all were when we there can an your which their will about how if do does my our us why please".split(),
    "es": "el la de que y en los las del se por con para una su al lo como pero ya está más no un es mi nos si".split(),
    "pt": "de que e do da em um para com não uma os no se na por mais as dos como mas foi ao ele são já é meu".split(),
    "pl": "w z na się nie do to że o jak za po co ale od już czy tak przez jest są dla my przed".split(),
}


def with_language(df: DataFrame, column: str, output: str = "language", *, least_share: float = 0.8) -> DataFrame:
    """Adds en, es, pt or pl if at least `least_share` of the frequent words found belong to it, else unknown.

    Texts with fewer than three letters are unknown.  Each count is a column of its own, computed once.
    """
    hits = {code: f"__hits_{code}" for code in STOP_WORDS}
    counted = df.withColumns({"__tokens": text.letter_tokens(F.col(column)), "__letters": text.letter_count(F.col(column))})
    counted = counted.withColumns({name: text.lexicon_hits(F.col("__tokens"), STOP_WORDS[code]) for code, name in hits.items()})
    counted = counted.withColumn("__hits", reduce(lambda a, b: a + b, [F.col(n) for n in hits.values()]))
    gate = F.lit("unknown")
    for code in reversed(hits):
        gate = F.when(F.col(hits[code]) >= F.lit(least_share) * F.col("__hits"), F.lit(code)).otherwise(gate)
    gate = F.when((F.col("__letters") < 3) | (F.col("__hits") == 0), F.lit("unknown")).otherwise(gate)
    return counted.withColumn(output, gate).drop("__tokens", "__letters", "__hits", *hits.values())


def length_batches(df: DataFrame, size: int, *, column: str = "scoring_text") -> DataFrame:
    """Adds batch_no: distinct texts of a task in the order of their length, `size` to a batch, so that a model pads little.

    No row moves to another task: the order holds inside each partition.
    """
    if size < 1:
        raise AffectError("A batch holds at least one text.")
    ordered = df.sortWithinPartitions(F.length(column), column)
    place = F.monotonically_increasing_id()
    return ordered.withColumn("batch_no", F.concat_ws("-", F.shiftright(place, 33).cast("string"), F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / size).cast("string")))


def lexicon_scorer(df: DataFrame) -> DataFrame:
    """The default scorer: how many listed words occur, smoothed.  It needs no model and runs as column expressions."""
    counted = df.withColumn("__tokens", text.letter_tokens(F.col("scoring_text")))
    counted = counted.withColumns({f"__{k}": text.lexicon_hits(F.col("__tokens"), v).cast("double") for k, v in LEXICON.items()})
    sentiment = {"negative": F.col("__negative") + 0.25, "neutral": F.lit(1.0), "positive": F.col("__positive") + 0.25}
    emotion = {k: (F.lit(1.0) if k == "neutral" else F.col(f"__{k}") + 0.1) for k in EMOTIONS}
    totals = counted.withColumns({"__s": reduce(lambda a, b: a + b, sentiment.values()), "__e": reduce(lambda a, b: a + b, emotion.values())})

    def shares(weights: dict[str, Column], total: str) -> Column:
        return F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), w / F.col(total))])

    scored = totals.withColumns({"sentiment_probabilities": shares(sentiment, "__s"), "emotion_probabilities": shares(emotion, "__e"), "truncated": F.lit(False)})
    return scored.drop("__tokens", "__s", "__e", *[f"__{k}" for k in LEXICON])


def _argmax(probabilities: Column, labels: Sequence[str]) -> Column:
    """The likeliest label; of equals the first in label order."""
    top = F.greatest(*[probabilities[k] for k in labels])
    return F.coalesce(*[F.when(probabilities[k] == top, F.lit(k)) for k in labels])


def valid_scores(probabilities: Column, labels: Sequence[str]) -> Column:
    """Whether a map holds a finite probability for every label and they add up to about one."""
    each = [probabilities[k] for k in labels]
    fine = reduce(lambda a, b: a & b, [e.isNotNull() & ~F.isnan(e) & (e >= 0) & (e <= 1) for e in each])
    return F.coalesce(fine & (F.abs(reduce(lambda a, b: a + b, each) - 1) <= 1e-5) & (F.size(probabilities) == len(labels)), F.lit(False))


def score_gap(probabilities: Column, labels: Sequence[str] = SENTIMENTS) -> Column:
    """Largest minus second largest score; null unless the scores are valid."""
    ordered = F.sort_array(F.array(*[probabilities[k] for k in labels]), asc=False)
    return F.when(valid_scores(probabilities, labels), F.element_at(ordered, 1) - F.element_at(ordered, 2))


def analyse_affect(df: DataFrame, *, scorer: Scorer = lexicon_scorer, language: Column | None = None, position: str = POSITION) -> DataFrame:
    """One row for each comment: position, language, status, sentiment, emotion, sentiment_score, probabilities, truncated.

    Status is empty, excluded_language or scored; only scored rows have labels, the others are never neutral.  Each
    distinct normalised text is scored once and joined back, so a scorer that runs a model sees no repeats.
    """
    base = df.select(F.col(position).alias(POSITION), text.strip(F.col(COMMENT)).alias("t"), (language if language is not None else F.lit(None).cast("string")).alias("given"))
    base = with_language(base, "t", "gate")
    base = base.withColumn("language", F.when(F.col("t") == "", "unknown").otherwise(F.coalesce("given", "gate"))).drop("gate")
    base = base.withColumn("status", F.when(F.col("t") == "", "empty").when(F.col("language") == "en", "scored").otherwise("excluded_language"))
    base = base.withColumn("scoring_text", F.when(F.col("status") == "scored", text.for_scoring(F.col("t")))).drop("t", "given")
    if scorer is lexicon_scorer:
        scored = lexicon_scorer(base)  # cheap expressions: scoring repeats costs less than a join
    else:
        unique = scorer(base.where(F.col("status") == "scored").select("scoring_text").distinct())
        missing = {"scoring_text", "sentiment_probabilities", "emotion_probabilities", "truncated"} - set(unique.columns)
        if missing:
            raise AffectError("The scorer returned incomplete results.")
        scored = base.join(unique, "scoring_text", "left")
    is_scored = F.col("status") == "scored"
    s, e = F.col("sentiment_probabilities"), F.col("emotion_probabilities")
    return scored.select(
        POSITION,
        "language",
        "status",
        F.when(is_scored, _argmax(s, SENTIMENTS)).alias("sentiment"),
        F.when(is_scored, _argmax(e, EMOTIONS)).alias("emotion"),
        F.when(is_scored, s["positive"] - s["negative"]).alias("sentiment_score"),
        F.when(is_scored, s).alias("sentiment_probabilities"),
        F.when(is_scored, e).alias("emotion_probabilities"),
        F.when(is_scored, F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated"),
    )


def check_scores(rows: DataFrame) -> None:
    """Raises if any scored row lacks valid probabilities."""
    bad = rows.where((F.col("status") == "scored") & ~(valid_scores(F.col("sentiment_probabilities"), SENTIMENTS) & valid_scores(F.col("emotion_probabilities"), EMOTIONS)))
    if bad.limit(1).count():
        raise AffectError("Affect inference returned invalid scores.")


def _aggregates(total: Column | None = None) -> list[Column]:
    scored = F.col("status") == "scored"
    out = [(F.count(F.lit(1)) if total is None else total).alias("total_comments"), F.count_if(scored).alias("scored_comments"), F.avg(F.when(scored, F.col("sentiment_score"))).alias("mean_sentiment")]
    out += [F.count_if(scored & (F.col("sentiment") == k)).alias(f"sentiment_{k}") for k in SENTIMENTS]
    return out + [F.count_if(scored & (F.col("emotion") == k)).alias(f"emotion_{k}") for k in EMOTIONS]


def _finish(df: DataFrame) -> DataFrame:
    n = F.col("scored_comments")
    top = F.greatest(*[F.col(f"emotion_{k}") for k in EMOTIONS])
    tied = F.filter(F.array(*[F.when(F.col(f"emotion_{k}") == top, F.lit(k)) for k in EMOTIONS]), lambda x: x.isNotNull())
    tied = F.when(n > 0, tied).otherwise(F.array().cast("array<string>"))
    shares = {f"{kind}_{k}_share": F.when(n > 0, F.col(f"{kind}_{k}") / n) for kind, labels in (("sentiment", SENTIMENTS), ("emotion", EMOTIONS)) for k in labels}
    return df.withColumns({"excluded_comments": F.col("total_comments") - n} | shares | {"dominant_emotion": F.when(F.size(tied) == 1, tied[0]), "dominant_emotion_ties": F.when(F.size(tied) > 1, tied).otherwise(F.array().cast("array<string>"))})


def aggregate_affect(rows: DataFrame, group: str | Column, *more: Column, total: Column | None = None) -> DataFrame:
    """Counts, shares among scored rows, mean score and the most frequent emotion of each group; groups without a scored row keep nulls.

    Further aggregates can be asked for, and another count of the comments of a group.
    """
    key = F.col(group) if isinstance(group, str) else group
    return _finish(rows.groupBy(key.alias("group")).agg(*_aggregates(total), *more))


def aggregate_affect_sets(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The same for every one of several groupings and for all rows together, in one pass (grouping sets).  `level` names the grouping."""
    for g in groups:
        if g not in rows.columns:
            raise AffectError("A grouping column is missing.")
    sets = [[F.col(g)] for g in groups] + [[]]
    agg = rows.groupingSets(sets, *[F.col(g) for g in groups]).agg(F.grouping_id().alias("gid"), *_aggregates())
    k = len(groups)
    level = F.coalesce(*[F.when(F.col("gid") == ((1 << k) - 1) - (1 << (k - 1 - i)), F.lit(g)) for i, g in enumerate(groups)], F.lit("all"))
    value = F.coalesce(*[F.when(F.col("level") == g, F.col(g).cast("string")) for g in groups], F.when(F.col("level") == "all", F.lit("all")))
    return _finish(agg.withColumn("level", level).withColumn("group", value).drop("gid", *groups))


def status_counts(rows: DataFrame) -> DataFrame:
    """(scored_count, excluded_language_count, empty_count, truncated_count)."""
    return rows.agg(F.count_if(F.col("status") == "scored").alias("scored_count"), F.count_if(F.col("status") == "excluded_language").alias("excluded_language_count"), F.count_if(F.col("status") == "empty").alias("empty_count"), F.count_if(F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated_count"))


def language_counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") != "empty").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def score_details(rows: DataFrame) -> DataFrame:
    """Scores in percent of each comment, closest decisions first; rounded only after sorting."""
    s = F.col("sentiment_probabilities")
    exact = rows.where(F.col("status") == "scored").withColumn("gap", score_gap(s)).where(F.col("gap").isNotNull())
    return exact.orderBy("gap", POSITION).select((F.col(POSITION) + 1).alias("comment_number"), "sentiment", *[F.round(s[k] * 100, 2).alias(f"{k}_percent") for k in SENTIMENTS], F.round(F.col("gap") * 100, 2).alias("gap_points"))

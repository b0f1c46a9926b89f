"""Agreement of labels with predictions, of clusterings with each other, and checks over finished tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EvaluationError
from ..schema import POSITION


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) of rows that have both."""
    both = df.select(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).where(F.col("truth").isNotNull() & F.col("predicted").isNotNull())
    return both.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, truth: str, predicted: str, *, group: str | None = None, least: float = 0.7) -> DataFrame:
    """(group, labelled, scored, agreement, needs_work): the share of scored rows that agree; null without a scored row."""
    key = F.col(group) if group else F.lit("all")
    scored = F.col(truth).isNotNull() & F.col(predicted).isNotNull()
    agg = df.groupBy(key.cast("string").alias("group")).agg(F.count_if(F.col(truth).isNotNull()).alias("labelled"), F.count_if(scored).alias("scored"), F.count_if(scored & (F.col(truth).cast("string") == F.col(predicted).cast("string"))).alias("hits"))
    share = F.when(F.col("scored") > 0, F.col("hits") / F.col("scored"))
    return agg.select("group", "labelled", "scored", share.alias("agreement"), F.coalesce(share < least, F.lit(False)).alias("needs_work"))


def recall_and_false_positives(df: DataFrame, truth: Column, predicted: Column, *, least_recall: float = 0.8, below_rate: float = 0.1) -> DataFrame:
    """Counts of the four outcomes, recall TP/(TP+FN), false-positive rate FP/(FP+TN), and whether both are good enough (the rate strictly)."""
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    agg = df.agg(F.count_if(t & p).alias("true_positive"), F.count_if(~t & p).alias("false_positive"), F.count_if(~t & ~p).alias("true_negative"), F.count_if(t & ~p).alias("false_negative"))
    positive, negative = F.col("true_positive") + F.col("false_negative"), F.col("true_negative") + F.col("false_positive")
    rates = agg.withColumns({"recall": F.when(positive > 0, F.col("true_positive") / positive), "false_positive_rate": F.when(negative > 0, F.col("false_positive") / negative)})
    return rates.withColumn("accepted", (F.col("recall") >= least_recall) & (F.col("false_positive_rate") < below_rate))


def adjusted_rand(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row (n, ari): the adjusted Rand index of two labelings, from their contingency table; 1 if there is nothing to tell apart."""
    cells = df.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = F.col("n") * (F.col("n") - 1) / 2
    inner = cells.agg(F.coalesce(F.sum(two), F.lit(0.0)).alias("same"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))
    by_a = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(two), F.lit(0.0)).alias("pa"))
    by_b = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(two), F.lit(0.0)).alias("pb"))
    one = inner.join(by_a).join(by_b)
    pairs = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("pa") * F.col("pb") / pairs
    top = (F.col("pa") + F.col("pb")) / 2
    ari = F.when((pairs <= 0) | (top == expected), 1.0).otherwise((F.col("same") - expected) / (top - expected))
    return one.select(F.col("total").cast("long").alias("n"), ari.alias("ari"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables of the same columns has, repeats counted."""
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def tampered(original: DataFrame, returned: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, reason) of rows that a review lost, added or changed."""
    a = original.select(F.col(key), F.struct(*columns).alias("a"))
    b = returned.select(F.col(key), F.struct(*columns).alias("b"))
    joined = a.join(b, key, "full_outer")
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return joined.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def hash_sample(df: DataFrame, n: int, *, key: str, seed: str = "plenum") -> DataFrame:
    """n rows in the order of a digest of seed and key: the same rows whatever the partitioning, each equally likely."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise EvaluationError("The sample size must be a whole number of at least 1.")
    return df.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"), 256), key).limit(n)


def reservoir_sample(df: DataFrame, n: int, *, key: str, seed: int, stratum: str | None = None) -> DataFrame:
    """n rows (of each stratum) by a reservoir: every row draws a number from seed and key, the n smallest stay.

    Each task keeps a reservoir of its own before they are merged; the draw depends on the row alone, so the sample is
    the same whatever the partitioning.
    """
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise EvaluationError("The sample size must be a whole number of at least 1.")
    draw = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    if stratum is None:
        return df.orderBy(draw, key).limit(n)
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key)))
    return ranked.where(F.col("__k") <= n).drop("__k")


def concatenated(corpora: Mapping[str, DataFrame], *, column: str = "corpus") -> DataFrame:
    """All corpora below each other with the name of each in a column; columns that one lacks are null there."""
    if not corpora:
        raise EvaluationError("There is no corpus.")
    named = [df.withColumn(column, F.lit(name)) for name, df in corpora.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def compare_groupings(df: DataFrame, truth: str, methods: Sequence[str]) -> DataFrame:
    """(method, n, n_groups, largest, ari): each grouping (a column of labels) held against the truth."""

    def one(method: str) -> DataFrame:
        sizes = df.where(F.col(method).isNotNull()).groupBy(method).agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
        return adjusted_rand(df, truth, method).join(sizes).select(F.lit(method).alias("method"), "n", "n_groups", "largest", "ari")

    return reduce(DataFrame.unionByName, map(one, methods))


def moved_rows(df: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, n) of the rows whose group changed between two methods."""
    return df.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def redaction_report(df: DataFrame, *, redacted: str, planted: str) -> DataFrame:
    """One row (n_rows, n_planted, removed, partly_left, left_whole) of planted names (an array column) and what the redacted text keeps of them."""
    names = df.select(F.col(redacted).alias("t"), F.explode(planted).alias("name")).where(F.trim("name") != "")
    low = F.lower("t")
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(F.regexp_replace(w, r"\P{L}", "")) > 1)
    kept = F.size(F.filter(words, lambda w: F.array_contains(F.split(low, r"[^\p{L}'’-]+"), w)))
    whole = F.contains(low, F.lower("name"))
    agg = names.agg(F.count(F.lit(1)).alias("n_planted"), F.count_if(~whole & (kept == 0)).alias("removed"), F.count_if(~whole & (kept > 0)).alias("partly_left"), F.count_if(whole).alias("left_whole"))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).join(agg)


def priorities(groups: DataFrame, chosen: DataFrame, *, key: str = "question_group_id", rank: str = "rank", top: int = 10) -> DataFrame:
    """One row (n_chosen, n_known, in_top, mean_rank): how the groups that reviewers chose stand in a ranking."""
    found = chosen.select(F.col(key)).distinct().join(groups.select(key, rank), key, "left")
    return found.agg(F.count(F.lit(1)).alias("n_chosen"), F.count(rank).alias("n_known"), F.count_if(F.col(rank) <= top).alias("in_top"), F.avg(rank).alias("mean_rank"))


def systematic_sample(df: DataFrame, n: int, *, position: str = POSITION) -> DataFrame:
    """n rows at even distances of a 0-based position."""
    total = df.count()
    if not 1 <= n <= max(total, 1):
        raise EvaluationError("The sample can't be larger than the table.")
    places = sorted({round(i * (total - 1) / max(1, n - 1)) for i in range(n)}) if total else []
    return df.where(F.col(position).isin(*places)) if places else df.limit(0)


def corpus_fingerprint(df: DataFrame, *, order: str, column: str) -> DataFrame:
    """One row (n, fingerprint): a digest of the digests of all texts in order.

    Texts are hashed where they lie; blocks of 4096 consecutive positions are hashed again, so that no task sees
    more than one block or the digests of the blocks.
    """
    one = df.select(F.col(order).alias("o"), F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256).alias("h"))
    blocks = one.groupBy(F.floor(F.col("o") / 4096).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda s: s["h"])).cast("binary"), 256).alias("h"))
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda s: s["h"])).cast("binary"), 256).alias("fingerprint"))


def reconcile(*, comments: DataFrame, assignments: DataFrame, affect: DataFrame, volumes: DataFrame, periods: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """(check, passed): counts and positions that must agree across the tables of one analysis."""
    n = comments.agg(F.count(F.lit(1)).alias("n_comments"), F.count_distinct(POSITION).alias("n_positions"))
    a = assignments.agg(F.count(F.lit(1)).alias("n_assigned"), F.count_distinct(POSITION).alias("n_assigned_rows"))
    known = assignments.join(comments.select(POSITION), POSITION, "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    f = affect.agg(F.count(F.lit(1)).alias("n_affect"), F.count_if(F.col("status") != "empty").alias("n_nonempty"))
    v = volumes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_volume"))
    p = periods.agg(F.coalesce(F.sum("total_comments"), F.lit(0)).alias("n_period"))
    g = gap_rows.agg(F.count_if(F.col("suppressed") & (F.col("count").isNotNull() | F.col("participation_share").isNotNull() | F.col("gap_percentage_points").isNotNull() | F.col("representation_ratio").isNotNull())).alias("n_leaks"))
    one = n.join(a).join(known).join(f).join(v).join(p).join(g)
    checks = {
        "positions_unique": F.col("n_comments") == F.col("n_positions"),
        "assignments_unique": F.col("n_assigned") == F.col("n_assigned_rows"),
        "assignments_known": F.col("n_unknown") == 0,
        "affect_rows_match": F.col("n_affect") == F.col("n_comments"),
        "theme_volumes_match": F.col("n_volume") == F.col("n_assigned"),
        "period_totals_match": F.col("n_period") == F.col("n_nonempty"),
        "suppressed_hidden": F.col("n_leaks") == 0,
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()])).alias("r")
    return one.select(rows).select("r.check", "r.passed")

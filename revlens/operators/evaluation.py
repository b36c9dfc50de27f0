"""Scores of an evaluation: ratios over several groups with fixed values for empty ones, quality checks, deltas, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("recall", "clean_false_positive_rate", "unproven_blocker_rate", "blocker_recall", "anchor_accuracy", "parse_success")


def _share(part: Column, whole: Column, empty: float | None) -> Column:
    ratio = F.count_if(part & whole) / F.nullif(F.count_if(whole), F.lit(0))
    return (ratio if empty is None else F.coalesce(ratio, F.lit(empty))).cast("double")


def score(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row of metrics over (expected_category, expect_blocker, findings, blockers, matched, matched_blocker, exact_anchor, n_errors, tokens).

    An empty group has a fixed value: recalls and parse success 1, rates and anchors 0.
    """
    defect = F.coalesce(F.col("expected_category") != "", F.lit(False))
    control, provable = F.col("expect_blocker").eqNullSafe(F.lit(False)), F.col("expect_blocker").eqNullSafe(F.lit(True))
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(
        F.count("*").alias("cases"),
        _share(F.col("matched"), defect, 1.0).alias("recall"),
        _share(F.col("findings") > 0, ~defect & ~control, 0.0).alias("clean_false_positive_rate"),
        _share(F.col("blockers") > 0, control, 0.0).alias("unproven_blocker_rate"),
        _share(F.col("matched_blocker"), provable, 1.0).alias("blocker_recall"),
        _share(F.col("exact_anchor"), defect & F.col("matched"), 0.0).alias("anchor_accuracy"),
        _share(F.col("n_errors") == 0, F.lit(True), 1.0).alias("parse_success"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
    )


def gate_failed(metrics: DataFrame, baseline: DataFrame, semantic: DataFrame) -> DataFrame:
    """One row (failed): whether one of eight bounds is broken; the last two compare one way of chunking with another."""
    two = ("recall", "clean_false_positive_rate")
    b, s = (df.select(*[F.col(c).alias(f"{n}_{c}") for c in two]) for df, n in ((baseline, "b"), (semantic, "s")))
    m = metrics.join(b, F.lit(True)).join(s, F.lit(True))
    broken = (
        (F.col("recall") < 0.80)
        | (F.col("clean_false_positive_rate") > 0.10)
        | (F.col("unproven_blocker_rate") > 0.10)
        | (F.col("blocker_recall") < 0.80)
        | (F.col("anchor_accuracy") < 0.95)
        | (F.col("parse_success") < 0.99)
        | (F.col("s_recall") < F.col("b_recall"))
        | (F.col("s_clean_false_positive_rate") > F.col("b_clean_false_positive_rate"))
    )
    return m.select(broken.alias("failed"))


def quality(rows: DataFrame, checks: tuple[str, ...], kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Pass rates over (kind, judge_attempted, judge: map of check to outcome, unsupported_claims), over all rows or for each of the fixed kinds.

    A check that nothing answered is null, never 1. A null judge of an attempt is one that failed.
    """
    graded = F.col("judge_attempted") & F.col("judge").isNotNull()
    answers = F.when(graded, F.map_values("judge"))
    passed = F.when(graded, F.size(F.filter(F.map_values("judge"), lambda x: x)))
    metrics = [
        F.count(F.col("judge_attempted")).alias("cases"),
        F.count_if("judge_attempted").alias("judge_attempts"),
        F.count_if(graded).alias("judged"),
        (F.count_if(graded) / F.nullif(F.count_if("judge_attempted"), F.lit(0))).alias("judge_completion"),
        (F.sum(passed) / F.nullif(F.sum(F.size(answers)), F.lit(0))).alias("overall"),
        F.coalesce(F.sum("unsupported_claims"), F.lit(0)).cast("long").alias("unsupported_claims"),
        *[F.avg(F.when(graded, F.col("judge")[c].cast("int"))).alias(c) for c in checks],
    ]
    if not kinds:
        return rows.agg(*metrics)
    dim = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return dim.join(rows, "kind", "left").groupBy("kind").agg(*metrics)


def deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, delta) of means that both summaries (metric, mean) have."""
    return current.select("metric", F.col("mean").alias("now")).join(baseline.select("metric", F.col("mean").alias("then")), "metric").select("metric", (F.col("now") - F.col("then")).alias("delta"))


def baseline(files: DataFrame) -> DataFrame:
    """(suite, metric, value) of recorded baselines (text): maps of suites to maps of metrics. What is no JSON, no map or no number has no row; of a metric that stands in several files the least counts."""
    whole = files.select(F.try_variant_get(F.try_parse_json("text"), "$", "map<string,variant>").alias("m")).where("m IS NOT NULL")
    suites = whole.select(F.explode("m").alias("suite", "v")).select("suite", F.try_variant_get("v", "$", "map<string,variant>").alias("m")).where("m IS NOT NULL")
    rows = suites.select("suite", F.explode("m").alias("metric", "v")).where(F.schema_of_variant("v").rlike(r"\A(?:BIGINT|DOUBLE|DECIMAL)"))
    return rows.select("suite", "metric", F.try_variant_get("v", "$", "double").alias("value")).where("value IS NOT NULL").groupBy("suite", "metric").agg(F.min("value").alias("value"))

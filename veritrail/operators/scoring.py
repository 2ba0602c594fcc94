"""Answers -> theme scores -> dimension scores -> overall score and rating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.answers import is_match
from veritrail.functions.numbers import exact_round, rating

ANALYSIS = ["analysis_id", "company_id", "report_year"]


def theme_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of matching answers per analysis and theme, on a 0-10 scale with two decimals.

    Answers must be normalised and unique per (analysis, question). A theme whose
    answers are all not applicable scores 0; a theme without answers has no row.
    """
    counts = (
        answers.join(questions.select("question_pk", "theme_id", "expected_answer"), "question_pk")
        .groupBy(*ANALYSIS, "theme_id")
        .agg(
            F.count_if(F.col("answer") != L.NOT_APPLICABLE).alias("scored"),
            F.count_if(is_match(F.col("answer"), F.col("expected_answer"))).alias("matches"),
        )
    )
    exact = F.when(F.col("scored") > 0, F.col("matches") * 10.0 / F.col("scored")).otherwise(F.lit(0.0))
    scored = counts.withColumn("raw_score", exact)
    return scored.withColumn("raw_score", exact_round(F.col("raw_score"), 2)).withColumn(
        "rating", rating(F.col("raw_score"))
    )


def weight_themes(scores: DataFrame, companies: DataFrame, themes: DataFrame, weights: DataFrame) -> DataFrame:
    """Add dimension, sector weight (1.0 where none is set) and the weighted score."""
    return (
        scores.join(companies.select("company_id", "sector"), "company_id", "left")
        .join(themes.select("theme_id", "dimension"), "theme_id")
        .join(weights.select("sector", "theme_id", "weight"), ["sector", "theme_id"], "left")
        .withColumn("weight", F.coalesce(F.col("weight"), F.lit(1.0)))
        .withColumn("weighted_score", F.col("raw_score") * F.col("weight"))
    )


def _weighted_mean(condition=None):
    """Exact weighted mean of theme scores: decimal sums, so row order cannot change it."""
    weight = F.col("weight").cast("decimal(22,10)")
    points = F.col("raw_score").cast("decimal(4,2)") * weight
    if condition is not None:
        weight, points = F.when(condition, weight), F.when(condition, points)
    total = F.sum(weight)
    return F.when(total > 0, F.sum(points).cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def dimension_scores(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy(*ANALYSIS, "dimension").agg(
        _weighted_mean().alias("score"), F.count("*").alias("themes")
    )


def overall_scores(weighted: DataFrame, shares: dict[str, float] = L.DIMENSION_WEIGHTS) -> DataFrame:
    """One row per analysis; the rating looks at the overall score before rounding."""
    exact = weighted.groupBy(*ANALYSIS).agg(
        *[_weighted_mean(F.col("dimension") == d).alias(d) for d in shares]
    )
    parts = [F.col(d) * F.lit(share) for d, share in shares.items()]
    overall = parts[0]
    for part in parts[1:]:
        overall = overall + part
    totals = exact.withColumn("overall", overall)
    return totals.select(
        *ANALYSIS,
        *[exact_round(F.col(d), 2).alias(f"{d}_score") for d in shares],
        exact_round(F.col("overall"), 2).alias("overall_score"),
        rating(F.col("overall")).alias("overall_rating"),
    )

"""Comparison with the analyst's reference answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.numbers import exact_round
from veritrail.functions.text import strip
from veritrail.operators.keys import top_per_key
from veritrail.operators.scoring import ANALYSIS


def match_reference(workbook: DataFrame, themes: DataFrame, questions: DataFrame) -> DataFrame:
    """Workbook answers placed on catalogue questions; unplaced ones stay, with a null key.

    A sheet carries its theme's name. Section headers (fewer than two dots, unless the id
    starts with ``0.``) and answers outside the three values are not answers.
    """
    dots = F.regexp_count("question_id", F.lit(r"\."))
    answers = (
        workbook.where(~F.col("sheet").isin(L.UNSCORED_SHEETS))
        .where((dots >= 2) | F.col("question_id").startswith("0."))
        .withColumn("answer", strip(F.col("answer")))
        .where(F.col("answer").isin(L.ANSWER_VALUES))
    )
    placed = answers.join(themes.select(F.col("name").alias("sheet"), "theme_id"), "sheet")
    return placed.join(
        questions.select("theme_id", "question_id", "question_pk"), ["theme_id", "question_id"], "left"
    ).select(
        "question_pk", "question_id", F.col("sheet").alias("theme_name"), "answer", "source",
        F.col("question_pk").isNotNull().alias("matched"),
    )


def answer_distribution(answers: DataFrame) -> DataFrame:
    """Count of each of the three values, zero included."""
    counted = answers.agg(*[F.count_if(F.col("answer") == v).alias(v) for v in L.ANSWER_VALUES])
    return counted.select(
        F.inline(F.array(*[F.struct(F.lit(v).alias("answer"), F.col(f"`{v}`").alias("n")) for v in L.ANSWER_VALUES]))
    )


def expected_answers(questions: DataFrame, reference: DataFrame) -> DataFrame:
    """The catalogue with ``Não`` expected wherever the analyst answered ``Não``."""
    refused = reference.where(F.col("answer") == L.NO).select("question_pk").distinct().withColumn("_no", F.lit(True))
    return (
        questions.join(refused, "question_pk", "left")
        .withColumn("expected_answer", F.when(F.col("_no"), F.lit(L.NO)).otherwise(F.col("expected_answer")))
        .drop("_no")
    )


def accuracy(answers: DataFrame, reference: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """Hits and misses per analysis; reference N/A is skipped, unanswered questions are counted apart.

    With ``analyses`` those without any answer have a row too.

    Only answered questions meet the reference. What an analysis did not answer follows
    from the reference totals, so the full analysis x question grid is never built.
    """
    skipped = reference.select(F.count_if(F.col("answer") == L.NOT_APPLICABLE)).scalar()
    wanted = reference.select(F.count_if(F.col("answer") != L.NOT_APPLICABLE)).scalar()
    judged = reference.where(F.col("answer") != L.NOT_APPLICABLE).select(
        "question_pk", F.col("answer").alias("reference_answer")
    )
    counts = answers.join(judged, "question_pk", "left").groupBy(*ANALYSIS).agg(
        F.count_if(F.col("answer") == F.col("reference_answer")).alias("matches"),
        F.count_if(F.col("answer") != F.col("reference_answer")).alias("mismatches"),
    )
    if analyses is not None:
        counts = analyses.select(*ANALYSIS).distinct().join(counts, list(ANALYSIS), "left").fillna(0, ["matches", "mismatches"])
    compared = F.col("matches") + F.col("mismatches")
    percent = F.when(compared > 0, F.col("matches") / compared * 100.0).otherwise(F.lit(0.0))
    return counts.select(
        *ANALYSIS, "matches", "mismatches",
        skipped.alias("skipped"), (wanted - compared).alias("not_found"), percent.alias("accuracy"),
    ).withColumn("accuracy", exact_round(F.col("accuracy"), 1))


def mismatches(answers: DataFrame, reference: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` differing answers of every analysis in reference order (a report)."""
    judged = reference.where(F.col("answer") != L.NOT_APPLICABLE).select(
        "question_pk", "question_id", "theme_id", F.col("answer").alias("expected")
    )
    wrong = (
        answers.join(judged, "question_pk")
        .where(F.col("answer") != F.col("expected"))
        .select("question_pk", "question_id", "theme_id", "analysis_id", "expected",
                F.col("answer").alias("got"), "confidence_score")
    )
    return top_per_key(wrong, ["analysis_id"], [F.col("question_pk")], n, "place").drop("place")


def score_delta(scores: DataFrame, analyst: DataFrame) -> DataFrame:
    """Absolute distance to the analyst's scores per dimension and overall."""
    names = [f"{d}_score" for d in L.DIMENSIONS] + ["overall_score"]
    theirs = analyst.select(*ANALYSIS, *[F.col(n).alias(f"analyst_{n}") for n in names])
    joined = scores.join(theirs, ANALYSIS)
    return joined.select(
        *ANALYSIS,
        *[exact_round(F.abs(F.col(n) - F.col(f"analyst_{n}")), 2).alias(n.replace("_score", "_delta")) for n in names],
    )

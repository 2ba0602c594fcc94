"""The ordered event log of finished analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.answers import strip_question_id
from veritrail.session import written

_ORDER = ["phase", "theme_order", "theme_id", "kind", "place"]


def _event(name: str, phase: int, kind: int, theme: bool = True, **values: Column) -> list[Column]:
    nothing = F.lit(None)
    return [
        F.col("analysis_id"),
        F.lit(phase).alias("phase"),
        (F.col("theme_order") if theme else F.lit(-1)).cast("long").alias("theme_order"),
        (F.col("theme_id") if theme else F.lit(-1)).cast("long").alias("theme_id"),
        F.lit(kind).alias("kind"),
        values.get("place", F.lit(-1)).cast("long").alias("place"),
        F.lit(name).alias("event"),
        values.get("subject", nothing).cast("string").alias("subject"),
        values.get("answer", nothing).cast("string").alias("answer"),
        values.get("justification", nothing).cast("string").alias("justification"),
        values.get("answered", F.lit(0)).cast("long").alias("answered_count"),
        values.get("score", nothing).cast("double").alias("score"),
        values.get("rating", nothing).cast("string").alias("rating"),
    ]


def replay_log(answers: DataFrame, questions: DataFrame, themes: DataFrame, theme_scores: DataFrame,
               scores: DataFrame) -> DataFrame:
    """Start, dimension changes, themes, questions and completions of every analysis, numbered.

    Answers are unique per question, so an analysis is never longer than the catalogue.
    """
    by_analysis = Window.partitionBy("analysis_id")
    placed = answers.join(
        questions.select("question_pk", "question_id", "question_text", "theme_id", "display_order"), "question_pk"
    ).join(
        themes.select("theme_id", "dimension", "name", F.col("display_order").alias("theme_order")), "theme_id"
    )
    numbered = placed.withColumn(
        "answered", F.row_number().over(by_analysis.orderBy("theme_order", "theme_id", "display_order", "question_pk"))
    )
    # a few dozen rows per analysis, read five times below
    reached = written(numbered.groupBy("analysis_id", "theme_id", "theme_order", "dimension", "name").agg(
        F.max("answered").alias("answered")
    ), "reached")
    before = F.lag("dimension").over(by_analysis.orderBy("theme_order", "theme_id"))
    turns = reached.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("dimension"))
    )
    done = reached.join(theme_scores.select("analysis_id", "theme_id", "raw_score", "rating"), ["analysis_id", "theme_id"])
    totals = reached.groupBy("analysis_id").agg(F.max("answered").alias("answered"))
    finished = scores.join(totals, "analysis_id")
    text = F.substring(strip_question_id(F.col("question_text"), F.col("question_id")), 1, 120)
    said = F.substring("justification", 1, 200) if "justification" in answers.columns else F.lit(None)
    answered = F.col("answered")
    events = (
        scores.select(*_event("analysis_start", 0, 0, theme=False))
        .unionByName(turns.select(*_event("dimension_start", 1, 1, subject=F.col("dimension"))))
        .unionByName(reached.select(*_event("theme_start", 1, 2, subject=F.col("name"))))
        .unionByName(numbered.select(*_event("question_answered", 1, 3, place=answered, subject=text,
                                             answer=F.col("answer"), justification=said, answered=answered)))
        .unionByName(done.select(*_event("theme_complete", 1, 4, subject=F.col("name"), answered=answered,
                                         score=F.col("raw_score"), rating=F.col("rating"))))
        .unionByName(finished.select(*_event("analysis_complete", 2, 5, theme=False, answered=answered,
                                             score=F.col("overall_score"), rating=F.col("overall_rating"))))
    )
    return events.withColumn("seq", F.row_number().over(by_analysis.orderBy(*_ORDER))).drop(*_ORDER)

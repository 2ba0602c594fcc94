"""Which model answers which question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.answers import question_complexity


def route_questions(questions: DataFrame, default: str, simple: str | None = None, complex_: str | None = None) -> DataFrame:
    """Add ``complexity`` and ``model``. The split applies only when both models are named."""
    routed = questions.withColumn("complexity", question_complexity(F.col("question_text")))
    if not (simple and complex_):
        return routed.withColumn("model", F.lit(default))
    return routed.withColumn(
        "model", F.when(F.col("complexity") == "simple", F.lit(simple)).otherwise(F.lit(complex_))
    )

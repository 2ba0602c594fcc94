"""Questionnaire rows out of a workbook given as cells (sheet, row_number, col, value, is_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.text import strip

_ID = L.QUESTION_ID_PATTERN
_COLUMNS = ["A", "B", "C", "D", "E", "F", "L"]


def _present(cell: Column) -> Column:
    """A source cell with content: not empty text, not a numeric zero, not a false."""
    value = cell["value"]
    zero = F.coalesce(value.try_cast("double") == 0, F.lit(False)) | (F.lower(value) == "false")
    return F.when(F.when(cell["is_text"], value != "").otherwise(~zero), value)


def extract_questionnaire(cells: DataFrame, skip: list[str] = L.ADMIN_SHEETS) -> DataFrame:
    """One row per question: id, text, answer and source, wherever the sheet keeps them.

    The id is the first of columns B, C, D, A that starts like ``1.2``; the text is what
    follows it in that cell, else the first longer text in C or D; the source is F, else L.
    """
    used = cells.where(~F.col("sheet").isin(skip) & F.col("col").isin(_COLUMNS) & F.col("value").isNotNull())
    grid = used.groupBy("sheet", "row_number").pivot("col", _COLUMNS).agg(F.first(F.struct("value", "is_text")))
    id_cell = F.get(
        F.filter(
            F.array(*[strip(F.col(c)["value"]) for c in "BCDA"]), lambda s: F.coalesce(s.rlike(_ID), F.lit(False))
        ),
        F.lit(0),
    )
    named = grid.withColumn("_cell", id_cell).withColumn("question_id", F.nullif(F.regexp_extract("_cell", _ID, 1), F.lit("")))
    rest = F.nullif(strip(F.substr(F.col("_cell"), F.length("question_id") + 1)), F.lit(""))
    other = [F.when(F.col(c)["is_text"] & (F.length(F.col(c)["value"]) > 10), F.col(c)["value"]) for c in "CD"]
    worded = named.withColumn("_text", F.coalesce(rest, *other))
    kept = worded.where(F.col("question_id").isNotNull() | (F.length("_text") > 15))
    return kept.select(
        "sheet", "row_number", "question_id",
        F.substring("_text", 1, 500).alias("question_text"),
        strip(F.col("E")["value"]).alias("answer"),
        F.substring(F.coalesce(_present(F.col("F")), _present(F.col("L"))), 1, 1000).alias("source"),
    )


def extraction_summary(extracted: DataFrame) -> DataFrame:
    """Questions and answered questions per sheet."""
    return extracted.groupBy("sheet").agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("answer").isNotNull() & ~F.col("answer").isin("", "None", "N/A")).alias("answered"),
    )

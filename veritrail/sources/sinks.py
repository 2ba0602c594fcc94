"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame



def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The chunk table, in folders by report year, which searches filter on."""
    chunks.write.mode(mode).partitionBy("report_year").parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Answers or reference answers as JSON lines; null fields stay in."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_export(detail: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The export as CSV, one folder per dimension, rows in theme and question order within a file."""
    ordered = detail.sortWithinPartitions("dimension", "analysis_id", "theme_order", "display_order")
    ordered.write.mode(mode).partitionBy("dimension").option("header", "true").option("escape", '"').csv(path)

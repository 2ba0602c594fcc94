"""Reading the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = (
    "doc_id long, chunk_index int, content string, token_count int, page_number int, page_range array<int>, "
    "report_year int"
)


def read_chunks(spark: SparkSession, path: str, report_year: int | None = None) -> DataFrame:
    """The chunk table; a year reads only that year's folder."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    return chunks if report_year is None else chunks.where(F.col("report_year") == report_year)


def decoded(content: Column) -> Column:
    """Page bytes as text; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_page_files(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Stored pages (one file each) as ``url`` and ``html``.

    ``manifest`` (path, url) gives the address a page came from, against which its links are resolved; ``path`` is the
    end of the file's path below the folder. Pages it does not list keep their file path as address.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pages = files.select("path", decoded(F.col("content")).alias("html"))
    if manifest is None:
        return pages.select(F.col("path").alias("url"), "html")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    below = F.substring_index("path", f"/{root}/", -1)
    named = pages.withColumn("_below", below).join(manifest.select(F.ltrim("path", F.lit("/")).alias("_below"), "url"), "_below", "left")
    return named.select(F.coalesce("url", "path").alias("url"), "html")

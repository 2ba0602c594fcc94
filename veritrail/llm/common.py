"""What the training-data operators share: folds, text as given, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.session import ship_package

ARROW_ROWS = 512  # rows in one Arrow batch, and bytes, about: long texts then stay within a worker's memory
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ready a session for the operators that run Python in tasks: package shipped, batches kept small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def fold(key: str, folds: int) -> Column:
    """``crc32(key as text) mod folds``; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds).cast("int")


def whole(text: str) -> Column:
    """The text as it stands; null is the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")

"""New documents -> chunks and a status line, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veritrail.operators.chunking import chunk_texts
from veritrail.session import read_folder
from veritrail.sources.sinks import write_chunks
from veritrail.streaming.runs import finish, per_batch


def ingest_documents(stream: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunk the stream's documents (doc_id, report_year, page_count, text) into tables under ``path``.

    Gives (chunks, statuses). A document without text ends as ``error``, any other as
    ``ready`` with its counts. A repeated batch replaces its own folders.
    """
    spark = stream.sparkSession
    chunked = lambda rows: chunk_texts(rows, ["doc_id", "report_year"])
    shape = chunked(stream).schema
    status = StructType([stream.schema["doc_id"], stream.schema["report_year"], StructField("status", StringType()),
                         StructField("chunk_count", LongType()), StructField("page_count", stream.schema["page_count"].dataType)])

    def write(batch_df: DataFrame, batch: int) -> None:
        target = f"{path}/chunks/batch={batch}"
        write_chunks(chunked(batch_df), target)
        # a batch of blank documents leaves no file to infer columns from
        stored = batch_df.sparkSession.read.schema(shape).parquet(target)
        counts = stored.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
        found = F.col("chunk_count").isNotNull()
        batch_df.select("doc_id", "report_year", "page_count").join(counts, "doc_id", "left").select(
            "doc_id", "report_year",
            F.when(found, F.lit("ready")).otherwise(F.lit("error")).alias("status"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            F.when(found, F.col("page_count")).otherwise(F.lit(0)).alias("page_count"),
        ).write.mode("overwrite").parquet(f"{path}/status/batch={batch}")

    finish(per_batch(stream, path, write))
    by_batch = lambda schema: StructType([*schema.fields, StructField("batch", LongType())])
    return read_folder(spark, f"{path}/chunks", by_batch(shape)), read_folder(spark, f"{path}/status", by_batch(status))

"""Running a stream to the end of what is there, with its state in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from veritrail.session import is_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, folder: str, file: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream; ``file`` narrows it to matching names, or is a table's own folder of files."""
    schema = spark.read.parquet(f"{folder}/{file}" if file else folder).schema
    if file and is_folder(spark, f"{folder}/{file}"):
        folder, file = f"{folder}/{file}", None  # a file stream does not look into folders below its own
    reader = spark.readStream.schema(schema)
    if file:
        reader = reader.option("pathGlobFilter", file)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, so it may outgrow the executors' memory."""
    earlier = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, earlier)


def append_to_files(stream: DataFrame, path: str) -> StreamingQuery:
    """Exactly-once parquet sink; ``path`` holds both data and checkpoint, so a restart resumes."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .option("path", f"{path}/data")
        .trigger(availableNow=True)
        .start()
    )


def per_batch(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """``foreachBatch`` with its checkpoint under ``path``. ``write`` must give the same result when repeated."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error

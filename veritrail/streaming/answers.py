"""Delivery of new answers, each once, numbered in created order, resumable from a seen count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from veritrail.operators.keys import first_per_key, ordered_number
from veritrail.session import Job, read_folder, ship_package
from veritrail.streaming.runs import finish, per_batch

BUCKETS = 64  # folders of delivered ids in a batch
FILTER_BITS = 1 << 20  # of each bucket's Bloom filter; a full one costs reading, never an answer
PROBES = 5
_LEDGER = "rows long, last long, batch long"


def _places(low: np.ndarray, bits: int) -> np.ndarray:
    """The bits of every id: ids x probes, from one 64-bit hash."""
    x = low.astype(np.int64).view(np.uint64)
    step = (x >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (((x & np.uint64(0xFFFFFFFF))[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def may_contain(held: bytes | None, hashes: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Which hashes may have been added to a Bloom filter; those never added are told so but for a few."""
    if held is None:
        return np.zeros(len(hashes), bool)
    place = _places(hashes, bits)
    return ((np.frombuffer(held, np.uint8)[place >> 3] >> (place & 7)) & 1).all(axis=1)


def add_to_filter(held: bytes | None, hashes: np.ndarray, bits: int = FILTER_BITS) -> bytes:
    out = np.zeros(bits // 8, np.uint8) if held is None else np.frombuffer(held, np.uint8).copy()
    place = _places(hashes, bits).ravel()
    np.bitwise_or.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return out.tobytes()


def _ledger(spark: SparkSession, path: str, before: int) -> tuple[int, int | None]:
    """How many answers the batches before this one delivered, and the number of the last of them."""
    if not before:
        return 0, None
    rows = spark.read.schema(_LEDGER).parquet(f"{path}/ledger").where(F.col("batch") < before)
    found = rows.agg(F.max("last"), F.max("batch")).first()
    return found[0] or 0, found[1]


def _maybe_seen(new: DataFrame, filters: DataFrame, columns: list[str], shape: str) -> DataFrame:
    """The rows of ``new`` whose bucket's filter has their hash."""

    def look(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = may_contain(held["filter"].iloc[0] if len(held) else None, rows["hash"].to_numpy())
        return rows.loc[found, columns]

    return new.select(*columns, "hash").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(look, shape)


def _grown(new: DataFrame, filters: DataFrame) -> DataFrame:
    """The filters of all buckets with the new hashes added."""

    def grow(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        old = held["filter"].iloc[0] if len(held) else None
        bucket = (rows if len(rows) else held)["bucket"].iloc[0]
        return pd.DataFrame({"bucket": [bucket], "filter": [add_to_filter(old, rows["hash"].to_numpy(np.int64))]})

    return new.select("bucket", "hash").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(grow, "bucket int, filter binary")


def deliver_answers(stream: DataFrame, ids: Sequence[str], path: str, time: str = "created_at", buckets: int = BUCKETS) -> DataFrame:
    """Append every answer once to the table under ``path``; a second run continues where this one ended.

    Delivered answers have ``sequence``, a number without gaps: batch after batch, and in created order within a batch.
    The ids of delivered answers are kept in folders by hash, with a Bloom filter for each. A batch asks the filters
    first; only ids that may have been delivered are compared, and only with the folders they are in. So a batch's work
    grows with the batch, not with what was delivered before; nothing grows in a state store, an answer is delivered
    however late it comes, and one sent again with another ``time`` stays as first delivered. Within a batch the earliest
    of an id counts. A repeated batch reads only what earlier batches left and replaces its own folders.
    """
    spark, ids = stream.sparkSession, list(ids)
    ship_package(spark)
    shape = StructType([*stream.schema.fields, StructField("sequence", LongType()), StructField("batch", LongType())])
    id_fields = [stream.schema[c] for c in ids]
    known = StructType([*id_fields, StructField("bucket", IntegerType()), StructField("batch", LongType())])
    pieces = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in id_fields] + ["bucket int"])
    hashed: Column = F.xxhash64(*ids)

    def write(batch_df: DataFrame, batch: int) -> None:
        session, job = batch_df.sparkSession, Job(batch_df.sparkSession, "deliver")
        delivered, last = _ledger(session, path, batch)
        rows = first_per_key(batch_df, ids, [F.col(time).asc_nulls_last()])
        new = job.keep(rows.withColumn("hash", hashed).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int")), "new")
        filters = (session.createDataFrame([], "bucket int, filter binary") if last is None
                   else session.read.schema("bucket int, filter binary").parquet(f"{path}/filters/batch={last}"))
        fresh = new
        if last is not None:
            maybe = job.keep(_maybe_seen(new, filters, [*ids, "bucket"], pieces), "maybe")
            asked = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most one per folder
            if asked:
                old = session.read.schema(known).parquet(f"{path}/ids").where((F.col("batch") < batch) & F.col("bucket").isin(asked))
                same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in [*ids, "bucket"]])
                seen = job.keep(maybe.join(old, same(maybe, old), "left_semi"), "seen")
                fresh = job.keep(new.join(seen, same(new, seen), "left_anti"), "fresh")
        numbered = ordered_number(fresh, [F.col(time).asc_nulls_last(), *[F.col(c) for c in ids]], "sequence", delivered + 1)
        # written once, in the order the numbers were made in; what follows reads the delivered rows themselves
        numbered.select(*stream.columns, "sequence").sortWithinPartitions("sequence").write.mode("overwrite").option(
            "compression", "zstd").parquet(f"{path}/data/batch={batch}")
        numbered = session.read.schema(shape).parquet(f"{path}/data/batch={batch}").withColumn("hash", hashed).withColumn(
            "bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
        numbered.select(*ids, "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ids/batch={batch}")
        _grown(numbered, filters).write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")
        numbered.agg(F.count("*").alias("rows"), F.coalesce(F.max("sequence"), F.lit(delivered)).alias("last")).write.mode(
            "overwrite").parquet(f"{path}/ledger/batch={batch}")
        for name in ("new", "maybe", "seen", "fresh"):
            job.drop(name)

    finish(per_batch(stream, path, write))
    return read_folder(spark, f"{path}/data", shape).drop("batch")


def delivered_after(spark: SparkSession, path: str, seen: int) -> DataFrame:
    """The delivered answers behind the first ``seen``, for a reader that goes on; only batches that have any are read."""
    ledger = spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    ends = [r["batch"] for r in ledger.where(F.col("last") > seen).select("batch").collect()]
    data = spark.read.parquet(f"{path}/data")
    return data.where(F.col("batch").isin(ends) & (F.col("sequence") > seen)).drop("batch")

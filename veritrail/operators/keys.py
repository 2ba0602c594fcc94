"""First-wins, top-k and running numbers: the order-dependent building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.session import written


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key in ``order``, numbered from 1.

    The rank filter lets Spark cut every partition to k rows per key before the
    shuffle, so one hot key costs at most k rows per upstream task.
    """
    window = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def unfold_array(df: DataFrame, keep: Sequence[str], array: Column, element: str, position: str = "_position") -> DataFrame:
    """One row per array element, with its position from 0; empty and null arrays give none.

    The outer form with a filter behind it: the inner form makes the optimizer test the
    array's size in a pushed-down filter, and so compute a costly array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, element))
    return rows.where(F.col(position).isNotNull())


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_per_key(df, keys, order, 1, "_first").drop("_first")


def running_number(
    df: DataFrame, group: Sequence[str], bucket: Sequence[Column], order: Sequence[Column], name: str
) -> DataFrame:
    """Row numbers from 1 within ``group`` (or over the whole table) without one task per group.

    ``bucket`` expressions must grow with ``order``. Rows are numbered inside their
    bucket; the sizes of the earlier buckets, a far smaller table, give the offset.
    """
    keys = [f"_bucket{i}" for i in range(len(bucket))]
    tagged = df.select("*", *[b.alias(k) for b, k in zip(bucket, keys)])
    sizes = tagged.groupBy(*group, *keys).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, *keys).orderBy(*order)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*group, *keys])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop(*keys, "_inside", "_offset")
    )


def ordered_number(df: DataFrame, order: Sequence[Column], name: str, first: int = 1, purpose: str = "ordered") -> DataFrame:
    """Row numbers from ``first`` over the whole table in ``order``, for columns of any type.

    The rows are dealt by ranges of the order and written, so a row's range is fixed; only the number of rows per range
    (as many as shuffle partitions) is added up on the driver. No task sees more than a range. Rows equal in the whole
    order are interchangeable, and a crowd of them stays in one range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    stored = written(ranged, purpose)
    sizes = {r["_range"]: r["count"] for r in stored.groupBy("_range").count().collect()}
    rows, total = [], first - 1
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(rows, "_range int, _offset long"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return stored.withColumn("_inside", inside).join(offsets, "_range").withColumn(
        name, F.col("_offset") + F.col("_inside")).drop("_range", "_offset", "_inside")

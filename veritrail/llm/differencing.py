"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows with equal texts form a group that stays together. Differencing keeps partial partitions: each is a tuple of loads,
at first one group alone. The two with the largest spread are combined again and again, one ordered downwards onto the
other ordered upwards, until one is left; unrolling the steps tells every group's shard.

No task sees all groups. They are dealt into parts of about ``PART`` groups, and each part is differenced into
``12 * shards`` bins (an eighth of a part at most) of nearly equal load; a bin then counts as one group on the next level,
which is about eight times smaller. On every level one part is passed on as it is (fine grain for the last step), and so are groups of more than
1/64 of a shard (at most 64 per shard). When at most ``LAST`` items are left, one task differences them into the shards:
its input is bounded by the constants and the number of levels, which grows with the logarithm of the groups. A group
larger than a shard's share fills a shard alone, as no tighter balance exists.

Null texts count as empty and form one group with the empty ones. Repeated rows each have a slot. Slots follow the key
(nulls first) within a hash bucket of it, gapless from 0 in every shard; a shard may stay empty where there are fewer
groups than shards. Other columns are not used.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare, whole
from veritrail.operators.keys import running_number
from veritrail.session import Job

PART = 4_096
LAST = 16_384
BINS_PER_SHARD = 12
OVERHEAD = 16  # bytes a row counts besides its text
SLOT_BUCKET = 20_000  # rows numbered together, about


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The bin, from 0, of every item; ties by place, so the result depends on the order given."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int32)
    loads: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes):
        load = np.zeros(shards, np.int64)
        load[0] = size
        loads[i] = load
        heap.append((-int(size), i))
    heapq.heapify(heap)
    steps: dict[int, tuple[int, int, np.ndarray]] = {}
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads.pop(a) + loads.pop(b)[::-1]
        order = np.argsort(-both, kind="stable").astype(np.int32)
        loads[node] = both[order]
        steps[node] = (a, b, order)
        heapq.heappush(heap, (-int(loads[node][0] - loads[node][-1]), node))
        node += 1
    bins = np.zeros(n, np.int32)
    names = {node - 1: np.arange(shards, dtype=np.int32)}  # which bin every place of a tuple has become
    for at in range(node - 1, -1, -1):
        of = names.pop(at)
        if at < n:
            bins[at] = of[0]
            continue
        a, b, order = steps.pop(at)
        before = np.empty(shards, np.int32)
        before[order] = of
        names[a], names[b] = before, before[::-1]
    return bins


def _binned(items: DataFrame, by: str, bins: int) -> DataFrame:
    """(part, item, bytes, bin): every part differenced in a task of its own."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        return frame.assign(bin=difference(frame["bytes"].to_numpy(), bins))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.groupBy(by).applyInPandas(run, f"{schema}, bin int")


def place_groups(groups: DataFrame, shards: int, job: Job, part: int = PART, last: int = LAST) -> DataFrame:
    """(item, shard) for ``groups`` (item string, bytes long)."""
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = max(1, total // (64 * shards))
    bins = max(shards, min(BINS_PER_SHARD * shards, part // 8))
    ready, levels, items, count = None, [], groups, groups.count()
    while count > last:
        n_parts = -(-count // part)
        dealt = items.withColumn("part", F.when(F.col("bytes") > large, F.lit(0)).otherwise(
            F.pmod(F.xxhash64(F.lit(len(levels)), "item"), F.lit(n_parts))).cast("int"))
        passed = dealt.where("part = 0").select("item", "bytes")
        ready = passed if ready is None else ready.unionByName(passed)
        binned = job.keep(_binned(dealt.where("part > 0"), "part", bins), f"level{len(levels)}")
        name = F.concat_ws(":", F.lit(str(len(levels))), "part", "bin")
        levels.append(binned.select("item", name.alias("parent")))
        items = binned.groupBy(name.alias("item")).agg(F.sum("bytes").alias("bytes"))
        fewer = items.count()
        if fewer >= count:
            break  # parts hold fewer items than bins: nothing to gain
        count = fewer
    final = (items if ready is None else items.unionByName(ready)).withColumn("part", F.lit(0))
    placed = job.keep(_binned(final, "part", shards).select("item", F.col("bin").alias("shard")), "last")
    for level in reversed(levels):
        below = level.join(placed.withColumnRenamed("item", "parent"), "parent").select("item", "shard")
        placed = placed.unionByName(below)
    return placed


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, part: int = PART,
               last: int = LAST) -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row's shard from 0 and its place there."""
    spark = prepare(docs.sparkSession)
    job = Job(spark, "differencing")
    body = whole(text)
    rows = job.keep(docs.select(F.col(key).alias("key"), F.sha2(body, 256).alias("item"),
                                (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
                                F.crc32(body.cast("binary")).alias("text_crc32")), "rows")
    groups = job.keep(rows.groupBy("item").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.join(place_groups(groups, shards, job, part, last), "item").drop("item")
    buckets = max(1, rows.count() // SLOT_BUCKET)
    numbered = running_number(placed, ["shard"], [F.pmod(F.xxhash64("key"), F.lit(buckets))],
                              [F.col("key"), F.col("size"), F.col("text_crc32")], "slot")
    return job.finish(numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard",
                                      (F.col("slot") - 1).cast("long").alias("slot")))

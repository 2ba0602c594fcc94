"""Analyses that stopped making progress, judged at a given time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritrail import lookups as L
from veritrail.operators.keys import first_per_key
from veritrail.streaming.runs import append_to_files, finish, per_batch, state_on_disk

STALLS = "analysis_id long, stalled_ms long, reason string, partial_answers long"

# As for the progress events: the processor travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def last_signs(events: DataFrame) -> DataFrame:
    """Per analysis: latest answer, start and latest heartbeat. Partial sums keep hot analyses cheap."""

    def time_of(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("ts"))

    return events.groupBy("analysis_id").agg(
        F.max(time_of("answer")).alias("last_answer"),
        F.min(time_of("started")).alias("started_at"),
        F.max(time_of("heartbeat")).alias("heartbeat_at"),
        F.count(time_of("answer")).alias("partial_answers"),
    )


def judge(signs: DataFrame, as_of: Column, idle_seconds: int, startup_seconds: int, heartbeat_seconds: int) -> DataFrame:
    """Keep the stalled ones, with the reason. A recent heartbeat clears an analysis."""

    def older(column: str, seconds: int) -> Column:
        return F.col(column) < as_of - F.expr(f"INTERVAL '{seconds}' SECOND")

    alive = F.coalesce(
        F.col("heartbeat_at") > as_of - F.expr(f"INTERVAL '{heartbeat_seconds}' SECOND"), F.lit(False)
    )
    reason = (
        F.when(F.col("last_answer").isNotNull(), F.when(older("last_answer", idle_seconds), F.lit("no progress")))
        .when(F.col("started_at").isNull(), F.lit("no start time"))
        .when(older("started_at", startup_seconds), F.lit("no answers"))
    )
    return signs.where(~alive).withColumn("reason", reason).where(F.col("reason").isNotNull())


def stalled_analyses(events: DataFrame, as_of: str, idle_seconds: int = L.IDLE_SECONDS,
                     startup_seconds: int = L.STARTUP_SECONDS, heartbeat_seconds: int = L.HEARTBEAT_SECONDS) -> DataFrame:
    """Stalled analyses at ``as_of``; later events are not looked at."""
    now = F.lit(as_of).cast(events.schema["ts"].dataType)
    known = events.where(F.col("ts") <= now)
    return judge(last_signs(known), now, idle_seconds, startup_seconds, heartbeat_seconds)


def watch_stalls(stream: DataFrame, as_of: str, path: str, idle_seconds: int = L.IDLE_SECONDS,
                 startup_seconds: int = L.STARTUP_SECONDS, heartbeat_seconds: int = L.HEARTBEAT_SECONDS) -> DataFrame:
    """The same from a stream: signs of life are kept as a running aggregate and judged at ``as_of``.

    Every micro-batch writes the analyses that changed to its own folder; writing it again
    replaces it. The newest line of an analysis counts.
    """
    now = F.lit(as_of).cast("timestamp")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    signs = last_signs(timed.where(F.col("ts") <= now))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/signs/batch={batch}")

    with state_on_disk(stream.sparkSession):
        finish(per_batch(signs, path, write, "update"))
    written = stream.sparkSession.read.parquet(f"{path}/signs")
    newest = first_per_key(written, ["analysis_id"], [F.desc("batch")])
    return judge(newest, now, idle_seconds, startup_seconds, heartbeat_seconds)


class StallTimer(StatefulProcessor):
    """Wakes when an analysis's time has run out, without a further row of that analysis.

    Signs of life wait until the watermark has passed them and are then taken in order of time, so the events do not
    depend on how the rows were cut into batches. Each sign sets the deadline anew; a deadline that passes before the
    next sign gives one event. State: the waiting signs (those of the watermark's delay) and five numbers.
    """

    def __init__(self, idle_seconds: int, startup_seconds: int, heartbeat_seconds: int):
        self.idle, self.startup, self.beat = idle_seconds * 1000, startup_seconds * 1000, heartbeat_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, kind string")
        self.known = handle.getValueState(
            "known", "last_answer long, started_at long, heartbeat_at long, answers long, told long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            times = frame["at"].tolist()
            self.waiting.appendList(list(zip(times, frame["kind"].tolist())))
            first = min(times) if first is None else min(first, *times)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        signs = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [s for s in signs if s[0] <= now], [s for s in signs if s[0] > now]
        answer, started, heartbeat, answers, told = self.known.get() if self.known.exists() else (None, None, None, 0, None)
        events = []

        def deadline() -> int | None:
            if answer is not None:
                due = [answer + self.idle]
            else:
                due = [] if started is None else [started + self.startup]
            return max(due + ([] if heartbeat is None else [heartbeat + self.beat]), default=None)

        def passed(time: int) -> bool:
            """Whether the deadline came before ``time``; says so once."""
            due = deadline()
            if due is None or due >= time:
                return False
            if due != told:
                reason = "no progress" if answer is not None else "no start time" if started is None else "no answers"
                events.append((key[0], due, reason, answers))
            return True

        for at, kind in ready:
            if passed(at):
                told = deadline()
            if kind == "answer":
                answer, answers = at if answer is None else max(at, answer), answers + 1
            elif kind == "started":
                started = at if started is None else min(at, started)
            elif kind == "heartbeat":
                heartbeat = at if heartbeat is None else max(at, heartbeat)
        if passed(now):
            told = deadline()
        elif deadline() is not None:
            self.handle.registerTimer(deadline() + 1)
        self.known.update((answer, started, heartbeat, answers, told))
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] + 1)
        if events:
            yield pd.DataFrame(events, columns=["analysis_id", "stalled_ms", "reason", "partial_answers"])

    def close(self) -> None:
        pass


def stall_events(stream: DataFrame, path: str, delay: str, idle_seconds: int = L.IDLE_SECONDS,
                 startup_seconds: int = L.STARTUP_SECONDS, heartbeat_seconds: int = L.HEARTBEAT_SECONDS) -> DataFrame:
    """(analysis_id, stalled_at, reason, partial_answers): every stall of every analysis, at the time its deadline passed.

    Time is that of the events: a stall is told as soon as the watermark, ``delay`` behind the newest event of any analysis,
    has passed its deadline. Rows without a time or an analysis say nothing. Running again goes on where it ended.
    """
    spark = stream.sparkSession
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    signs = timed.where("ts IS NOT NULL AND analysis_id IS NOT NULL").select(
        F.col("analysis_id").cast("long").alias("analysis_id"), "ts", F.unix_millis("ts").alias("at"), "kind")
    events = signs.groupBy("analysis_id").transformWithStateInPandas(
        statefulProcessor=StallTimer(idle_seconds, startup_seconds, heartbeat_seconds), outputStructType=STALLS,
        outputMode="Append", timeMode="EventTime")
    with state_on_disk(spark):
        finish(append_to_files(events, path))
    told = spark.read.schema(STALLS).parquet(f"{path}/data")
    return told.select("analysis_id", F.timestamp_millis("stalled_ms").alias("stalled_at"), "reason", "partial_answers")

"""Progress events of running analyses: first answers, counts and completions, each once."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritrail.operators.scoring import theme_scores
from veritrail.streaming.runs import append_to_files, finish, per_batch, state_on_disk

EVENTS = "analysis_id long, event string, subject string, answered_count long, total long"

ANSWER = ["analysis_id", "question_pk", "theme_id"]
PACKED = "bucket int, analysis_id array<long>, question_pk array<long>, theme_id array<int>"
BUCKET_BITS = 10  # analyses are handled by 1,024 buckets; fixed, as the state is kept by them
PAGE = 2048  # rows in one value of the state, on average (some 30 KB)
NEAR_BITS = 12  # an analysis's questions with neighbouring ids, 4,096 at most, share a page
ROW = 1 << 14  # answers in one row to the state's processor
GATHERED = 1 << 20  # answers held before repeated ones are dropped
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Spark first loads the processor in a Python process of the driver that knows no shipped
# packages, so the processor travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _mixed(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int64).view(np.uint64) * _MIX


def _dealt(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` of every hash."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _distinct(parts: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of ``parts`` put together, without repeated ones; more than ``GATHERED`` distinct ones in pieces."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= GATHERED:
            held = [pd.concat(held, ignore_index=True).drop_duplicates(columns, ignore_index=True)]
            size = len(held[0])
            if size >= GATHERED // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True).drop_duplicates(columns, ignore_index=True)


def packed_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: a task's distinct answers, one row per bucket of analyses.

    An analysis sends at most its catalogue per half a million answers of a task, however hot it is. Spark hands rows to
    the state's processor one at a time, so there are few of them, with many answers each.
    """
    for pdf in _distinct(batches, ANSWER):
        bucket = _dealt(_mixed(pdf["analysis_id"].to_numpy()), BUCKET_BITS)
        order = np.argsort(bucket, kind="stable")
        starts = np.unique(bucket[order], return_index=True)[1]
        cuts = np.unique(np.concatenate([starts, np.arange(0, len(order), ROW)]))  # a crowded bucket takes several rows
        rows = {c: np.split(pdf[c].to_numpy()[order], cuts[1:]) for c in ANSWER}
        yield pd.DataFrame({"bucket": bucket[order][cuts].astype(np.int32)} | {c: pd.Series(v, dtype=object) for c, v in rows.items()})


class Pages:
    """A bucket's rows in a map of the state, dealt by their hash into 2 ** bits pages, columns as bytes.

    Every access to the state is a round trip, so a value holds some ``PAGE`` rows; a batch reads and writes the pages of its
    own rows only. When there are more rows than that a page, all are dealt anew.
    """

    def __init__(self, state, types: list[type], hashed: Callable[[list[np.ndarray]], np.ndarray]):
        self.state, self.types, self.hashed = state, types, hashed

    def read(self, pages: list[int]) -> list[np.ndarray]:
        held = [value for value in map(self.state.getValue, [(n,) for n in pages]) if value]
        return [np.concatenate([np.empty(0, t), *[np.frombuffer(value[i], t) for value in held]]) for i, t in enumerate(self.types)]

    def near(self, columns: list[np.ndarray], size: int, bits: int) -> list[np.ndarray]:
        """The rows of all pages that the rows with these ``columns`` belong to."""
        return self.read(np.unique(_dealt(self.hashed(columns), bits)).tolist() if size else [])

    def write(self, columns: list[np.ndarray], changed: np.ndarray, added: int, size: int, bits: int) -> tuple[int, int]:
        """Rows as ``near`` gave them, with ``added`` new ones among the ``changed``; the new size and bits."""
        page = _dealt(self.hashed(columns), bits)
        if size + added > PAGE << bits:
            rest = self.read(np.setdiff1d(np.arange(1 << bits), page).tolist() if size else [])
            columns = [np.concatenate(both) for both in zip(columns, rest)]
            before, bits = 1 << bits, ((size + added) // PAGE).bit_length()
            page = _dealt(self.hashed(columns), bits)
            pages = np.union1d(page, np.arange(before))  # also those that hold no row any more
        else:
            pages = np.unique(page[changed])
        order = np.argsort(page, kind="stable")
        starts, ends = (np.searchsorted(page[order], pages, side) for side in ("left", "right"))
        columns = [c[order].astype(t) for c, t in zip(columns, self.types)]
        for n, start, end in zip(pages.tolist(), starts.tolist(), ends.tolist()):
            self.state.updateValue((n,), tuple(c[start:end].tobytes() for c in columns))
        return size + added, bits


class ProgressTracker(StatefulProcessor):
    """Remembers the answered questions of a bucket's analyses and says what is new.

    Every row brings its analysis, its question, its theme's order, dimension, name and size and the catalogue's total. The
    state is kept in pages: analysis and question, and for every theme reached the count and the dimension told with it.
    All analyses of a batch are handled at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sizes = handle.getValueState("sizes", "answers long, answer_bits int, reached long, reached_bits int, dimensions array<string>")
        answers = handle.getMapState("answers", "page long", "analysis binary, question binary")
        reached = handle.getMapState("reached", "page long", "analysis binary, theme binary, count binary, dimension binary")
        self.answers = Pages(answers, [np.int64, np.int64], lambda c: _mixed(_mixed(c[0]) ^ _mixed(c[1] >> NEAR_BITS)))
        self.reached = Pages(reached, [np.int64, np.int32, np.int64, np.int32], lambda c: _mixed(_mixed(c[0])))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Answers stored before the stream began are known; nothing is said about them."""
        self._take(self._flat(initialState))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # what is said of a batch is said once, so its distinct answers are put together
        pieces = list(_distinct(map(self._flat, rows), ANSWER))
        events = self._take(pd.concat(pieces, ignore_index=True)) if pieces else None
        if events is not None:
            yield events

    def _flat(self, rows: pd.DataFrame) -> pd.DataFrame:
        """One row per answer, with its theme's columns."""
        return rows

    def _new(self, analysis: np.ndarray, question: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, int, int]:
        """The first rows of the questions that were not known; from now on they are. And the size and bits of their pages."""
        old = self.answers.near([analysis, question], size, bits)
        known = len(old[0])
        a, q = np.concatenate([old[0], analysis]), np.concatenate([old[1], question])
        order = np.lexsort((q, a))  # stable: what is known comes first, then the first row
        a, q = a[order], q[order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (q[1:] != q[:-1])
        fresh = order[first] >= known
        if fresh.any():
            size, bits = self.answers.write([a[first], q[first]], fresh, int(fresh.sum()), size, bits)
        return order[first][fresh] - known, size, bits

    def _take(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Remember the rows' questions; what is new as events, by analysis and in the themes' order."""
        size, bits, reached_size, reached_bits, dimensions = self.sizes.get() or (0, 0, 0, 0, [])
        analysis = rows["analysis_id"].to_numpy(np.int64)
        new, size, bits = self._new(analysis, rows["question_pk"].to_numpy(np.int64), size, bits)
        if not len(new):
            return None
        theme_new = rows["theme_id"].to_numpy(np.int64)[new]
        ids, of = np.unique(analysis[new], return_inverse=True)
        held = self.reached.near([ids], reached_size, reached_bits)
        own = np.isin(held[0], ids)
        at, theme_held, count_held, told_held = np.searchsorted(ids, held[0][own]), *[c[own] for c in held[1:]]

        # analyses x themes, the themes of the batch first and in their order
        said, first = np.unique(theme_new, return_index=True)
        places = rows.iloc[new[first]]
        by = np.lexsort((said, places["display_order"].to_numpy()))
        said, places = said[by], places.iloc[by]
        themes = np.concatenate([said, np.setdiff1d(theme_held, said)])
        column = np.argsort(themes)
        find = lambda wanted: column[np.searchsorted(themes, wanted, sorter=column)]
        before = np.zeros((len(ids), len(themes)), np.int64)
        before[at, find(theme_held)] = count_held
        added = np.bincount(of * len(themes) + find(theme_new), minlength=before.size).reshape(before.shape)
        after = before + added
        dimensions, dimension = list(dimensions), places["dimension"].tolist()
        dimensions += [d for d in dict.fromkeys(dimension) if d not in dimensions]
        code = np.array([dimensions.index(d) for d in dimension])
        told = np.full(before.shape, -1)
        told[at, find(theme_held)] = told_held

        n, names, sizes = len(said), places["name"].to_numpy(object), places["questions"].to_numpy(np.int64)
        total, known, answered = int(rows["total"].iloc[0]), before.sum(axis=1), after.sum(axis=1)
        begun = (before[:, :n] == 0) & (added[:, :n] > 0)
        done = (before[:, :n] < sizes) & (sizes <= after[:, :n]) & (added[:, :n] > 0)
        parts = []

        def say(event: str, who: np.ndarray, place, subject, count, of_total) -> None:
            parts.append(pd.DataFrame({"who": who, "place": place, "kind": len(parts), "analysis_id": ids[who], "event": event,
                                       "subject": subject, "answered_count": count, "total": of_total}))

        for d in np.unique(code).tolist():
            among = np.flatnonzero(code == d)
            who = np.flatnonzero(begun[:, among].any(axis=1) & (told != d).all(axis=1))
            say("dimension_start", who, among[begun[np.ix_(who, among)].argmax(axis=1)], dimensions[d], 0, total)
        who, place = np.nonzero(begun)
        say("theme_start", who, place, names[place], 0, sizes[place])
        who, place = np.nonzero(done)
        say("theme_complete", who, place, names[place], after[who, place], sizes[place])
        say("progress", np.arange(len(ids)), n, None, answered, total)
        who = np.flatnonzero((known < total) & (total <= answered))
        say("analysis_complete", who, n, None, answered[who], total)
        events = pd.concat([p for p in parts if len(p)], ignore_index=True).sort_values(["who", "place", "kind"])

        told[:, :n] = np.where(begun, code, told[:, :n])
        who, place = np.nonzero(after)
        rest = [c[~own] for c in held]  # of other analyses in the same pages
        now = [np.concatenate(both) for both in zip([ids[who], themes[place], after[who, place], told[who, place]], rest)]
        reached = self.reached.write(now, np.arange(len(now[0])) < len(who), int(begun.sum()), reached_size, reached_bits)
        self.sizes.update((size, bits, *reached, dimensions))
        return events[["analysis_id", "event", "subject", "answered_count", "total"]]

    def close(self) -> None:
        pass


class PackedProgress(ProgressTracker):
    """A tracker whose rows are packed answers; what they need of their themes it brings along."""

    def __init__(self, catalogue: pd.DataFrame):
        self.catalogue = catalogue.sort_values("theme_id", kind="stable").drop_duplicates("theme_id").reset_index(drop=True)
        self.total = int(catalogue["questions"].sum())

    def _flat(self, rows: pd.DataFrame) -> pd.DataFrame:
        answers = pd.DataFrame({c: np.concatenate(rows[c].tolist()) for c in ANSWER})
        place = np.searchsorted(self.catalogue["theme_id"].to_numpy(), answers["theme_id"].to_numpy())
        return answers.assign(total=self.total, **{
            c: self.catalogue[c].to_numpy()[place] for c in ("display_order", "dimension", "name", "questions")})


def _packed(answers: DataFrame, themes: list[int]) -> DataFrame:
    """The answers of known themes, packed by bucket of analyses."""
    answered = answers.select(F.col("analysis_id").cast("long").alias("analysis_id"), F.col("question_pk").cast("long").alias("question_pk"),
                              F.col("theme_id").cast("int").alias("theme_id")).dropna().where(F.col("theme_id").isin(themes))
    return answered.mapInPandas(packed_in_task, PACKED)


def progress_events(stream: DataFrame, themes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events from ``stream(analysis_id, question_pk, theme_id)``; repeated answers count once, unknown themes not.

    ``themes`` has theme_id, display_order, dimension, name and question_count. ``stored`` has the columns of the stream:
    answers that were there before it, of which no event is told again. They are the first batch's initial state.
    """
    listed = themes.select(F.col("theme_id").cast("int").alias("theme_id"), F.col("display_order").cast("int").alias("display_order"),
                           "dimension", "name", F.col("question_count").cast("long").alias("questions"))
    catalogue = pd.DataFrame([tuple(r) for r in listed.collect()], columns=listed.columns)  # a few dozen rows
    known = catalogue["theme_id"].tolist()
    earlier = None if stored is None else _packed(stored, known).groupBy("bucket")
    return _packed(stream, known).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=PackedProgress(catalogue), outputStructType=EVENTS, outputMode="Append", timeMode="None", initialState=earlier
    )


def track_progress(stream: DataFrame, themes: DataFrame, path: str, stored: DataFrame | None = None) -> DataFrame:
    """Append progress events to the table under ``path``."""
    spark = stream.sparkSession
    with state_on_disk(spark):
        finish(append_to_files(progress_events(stream, themes, stored), path))
    return spark.read.schema(EVENTS).parquet(f"{path}/data")


def track_scores(stream: DataFrame, themes: DataFrame, questions: DataFrame, read_answers: Callable[[], DataFrame], path: str,
                 stored: DataFrame | None = None) -> DataFrame:
    """(analysis_id, theme_id, answered_count, raw_score, rating) of every theme that completes, with its score at that time.

    ``read_answers`` gives the stored answers, normalised and unique; it is called for every batch, so what was stored
    in the meantime counts. Only the answers of the batch's analyses are read into the scores. A repeated batch replaces its folders.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        at = f"{path}/events/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        done = spark.read.schema(EVENTS).parquet(at).where("event = 'theme_complete'")
        done = done.join(themes.select(F.col("name").alias("subject"), F.col("theme_id").cast("int").alias("theme_id")), "subject")
        answers = read_answers().join(done.select("analysis_id").distinct(), "analysis_id", "left_semi")
        scores = theme_scores(answers, questions).select(
            "analysis_id", F.col("theme_id").cast("int").alias("theme_id"), "raw_score", "rating")
        scored = done.select("analysis_id", "theme_id", "answered_count").join(scores, ["analysis_id", "theme_id"], "left")
        scored.write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    with state_on_disk(spark):
        finish(per_batch(progress_events(stream, themes, stored), path, write))
    return spark.read.schema("analysis_id long, theme_id int, answered_count long, raw_score double, rating string").parquet(
        f"{path}/scores/batch=*")

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veritrail.streaming.answers import add_to_filter, deliver_answers, delivered_after, may_contain
from veritrail.streaming.ingest import ingest_documents
from veritrail.streaming.progress import PackedProgress, ProgressTracker, packed_in_task, track_progress, track_scores
from veritrail.streaming.runs import read_table_stream
from veritrail.streaming.stalls import stall_events, stalled_analyses, watch_stalls

START = datetime(2024, 1, 1)
ANSWERS = "id string, analysis_id long, question_pk long, theme_id int, created_at timestamp"


def add(spark, folder, rows, schema, name):
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    frame.write.mode("append").parquet(str(folder))


def answer(n, analysis=1, question=None, theme=None):
    question = n if question is None else question
    return (f"a{n}", analysis, question, question % 3 if theme is None else theme, START + timedelta(seconds=n))


def test_answers_are_delivered_once_and_resumed(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    add(spark, folder, [answer(1), answer(2), answer(2)], ANSWERS, "1")
    add(spark, folder, [answer(2), answer(3)], ANSWERS, "2")
    stream = lambda: read_table_stream(spark, str(folder), files_per_batch=1)
    assert sorted(r.id for r in deliver_answers(stream(), ["id"], out).collect()) == ["a1", "a2", "a3"]
    add(spark, folder, [answer(3), answer(4)], ANSWERS, "3")
    assert sorted(r.id for r in deliver_answers(stream(), ["id"], out).collect()) == ["a1", "a2", "a3", "a4"]


def test_progress_over_several_batches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    themes = spark.createDataFrame([(0, 2, "social", "Zero", 2), (1, 1, "social", "Um", 2), (2, 3, "governance", "Dois", 1)],
                                   "theme_id int, display_order int, dimension string, name string, question_count long")
    stream = lambda: read_table_stream(spark, str(folder), files_per_batch=1)

    def events():
        rows = track_progress(stream(), themes, out).collect()
        return sorted((r.event, r.subject or "", r.answered_count, r.total) for r in rows if r.analysis_id == 1)

    add(spark, folder, [answer(0), answer(1), answer(1), answer(7, analysis=2)], ANSWERS, "1")
    first = [("dimension_start", "social", 0, 5), ("progress", "", 2, 5), ("theme_start", "Um", 0, 2), ("theme_start", "Zero", 0, 2)]
    assert events() == first
    add(spark, folder, [answer(1), answer(2), answer(3), answer(99, theme=77)], ANSWERS, "2")
    second = [("dimension_start", "governance", 0, 5), ("progress", "", 4, 5), ("theme_complete", "Dois", 1, 1),
              ("theme_complete", "Zero", 2, 2), ("theme_start", "Dois", 0, 1)]
    assert events() == sorted(first + second)
    add(spark, folder, [answer(0)], ANSWERS, "3")  # nothing new: no event
    assert events() == sorted(first + second)
    add(spark, folder, [answer(4)], ANSWERS, "4")
    third = [("progress", "", 5, 5), ("theme_complete", "Um", 2, 2), ("analysis_complete", "", 5, 5)]
    assert events() == sorted(first + second + third)


def test_late_answers_are_not_lost(spark, tmp_path):
    folder = tmp_path / "in"
    add(spark, folder, [answer(100_000)], ANSWERS, "1")
    add(spark, folder, [answer(1), answer(100_000)], ANSWERS, "2")
    add(spark, folder, [answer(2)], ANSWERS, "3")
    stream = read_table_stream(spark, str(folder), files_per_batch=1)
    assert deliver_answers(stream, ["id"], str(tmp_path / "out")).count() == 3


def test_an_id_sent_again_with_another_day_is_delivered_once(spark, tmp_path):
    folder = tmp_path / "in"
    again = lambda n, time: (*answer(n)[:4], time)
    add(spark, folder, [answer(1), answer(2)], ANSWERS, "1")
    add(spark, folder, [again(1, START + timedelta(days=3)), again(2, None), answer(3)], ANSWERS, "2")
    add(spark, folder, [again(3, START - timedelta(days=9)), again(1, START + timedelta(days=5))], ANSWERS, "3")
    stream = read_table_stream(spark, str(folder), files_per_batch=1)
    assert sorted(r.id for r in deliver_answers(stream, ["id"], str(tmp_path / "out")).collect()) == ["a1", "a2", "a3"]


EVENTS = "analysis_id long, kind string, ts timestamp"


def signs():
    at = lambda seconds: START + timedelta(seconds=seconds)
    return [
        (1, "answer", at(100)), (1, "answer", at(700)),  # fresh answer
        (2, "answer", at(100)),  # idle
        (3, "answer", at(100)), (3, "heartbeat", at(900)),  # idle, but alive
        (4, "started", at(600)),  # no answers, started lately
        (5, "started", at(100)),  # no answers for long
        (6, "heartbeat", at(10)),  # no start time, old heartbeat
        (7, "answer", at(100)), (7, "answer", at(5000)),  # later than the as-of time
    ]


def expected():
    return {2: "no progress", 5: "no answers", 6: "no start time", 7: "no progress"}


def test_stalls_batch_and_stream(spark, tmp_path):
    as_of = "2024-01-01 00:15:00"
    rows = signs()
    batch = stalled_analyses(spark.createDataFrame(rows, EVENTS), as_of, 210, 310, 610)
    assert {r.analysis_id: r.reason for r in batch.collect()} == expected()
    folder = tmp_path / "in"
    for n, part in enumerate([rows[:5], rows[5:8], rows[8:]]):
        add(spark, folder, part, EVENTS, str(n))
    stream = read_table_stream(spark, str(folder), files_per_batch=1)
    watched = watch_stalls(stream, as_of, str(tmp_path / "out"), 210, 310, 610)
    assert {r.analysis_id: r.reason for r in watched.collect()} == expected()
    assert {r.analysis_id: r.partial_answers for r in watched.collect()}[7] == 1


def test_ingest_by_batch(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "doc_id long, report_year int, page_count long, text string"
    add(spark, folder, [(9, 2024, 1, " \n "), (8, 2024, 1, None)], schema, "0")  # a batch of blank documents only
    chunks, status = ingest_documents(read_table_stream(spark, str(folder), files_per_batch=1), str(tmp_path / "out"))
    assert chunks.count() == 0 and {(r.doc_id, r.status) for r in status.collect()} == {(9, "error"), (8, "error")}
    add(spark, folder, [(1, 2024, 3, "um dois\n\ntres"), (2, 2024, 1, " \n ")], schema, "1")
    add(spark, folder, [(3, 2023, 2, " ".join(["w"] * 600) + "\n\nfim")], schema, "2")
    stream = lambda: read_table_stream(spark, str(folder), files_per_batch=1)
    chunks, status = ingest_documents(stream(), str(tmp_path / "out"))
    assert {(r.doc_id, r.status, r.chunk_count, r.page_count) for r in status.collect()} == {
        (9, "error", 0, 0), (8, "error", 0, 0), (1, "ready", 1, 3), (2, "error", 0, 0), (3, "ready", 2, 2)}
    assert chunks.where(F.col("report_year") == 2023).count() == 2
    add(spark, folder, [(4, 2023, 1, "novo")], schema, "3")
    chunks, status = ingest_documents(stream(), str(tmp_path / "out"))
    assert status.count() == 6 and chunks.count() == 4


def test_a_table_in_several_files_is_read_whole(spark, tmp_path):
    rows = [(n, 2024, 1, "texto" if n else " ") for n in range(4)]
    documents = spark.createDataFrame(rows, "doc_id long, report_year int, page_count long, text string")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    _, status = ingest_documents(read_table_stream(spark, str(tmp_path), "documents.parquet"), str(tmp_path / "out"))
    assert sorted((r.doc_id, r.status) for r in status.collect()) == [(0, "error"), (1, "ready"), (2, "ready"), (3, "ready")]


def test_a_stream_without_files_gives_empty_tables(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("doc_id long, report_year int, page_count long, text string").parquet(str(folder))
    assert [t.count() for t in ingest_documents(stream, str(tmp_path / "out"))] == [0, 0]
    stream = spark.readStream.schema(ANSWERS).parquet(str(folder))
    assert deliver_answers(stream, ["id"], str(tmp_path / "answers")).count() == 0


def test_delivery_is_numbered_in_created_order_and_resumable(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    add(spark, folder, [answer(n) for n in (9, 3, 30, 12)], ANSWERS, "1")
    add(spark, folder, [answer(n) for n in (3, 1, 40, 9, 41)], ANSWERS, "2")
    stream = lambda: read_table_stream(spark, str(folder), files_per_batch=1)
    rows = deliver_answers(stream(), ["id"], out, buckets=4).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, 8))
    batches = [[r.id for r in rows[:4]], [r.id for r in rows[4:]]] if len(rows) == 7 else None
    assert ["a3", "a9", "a12", "a30"] in batches or ["a1", "a3", "a9", "a40", "a41"] == [r.id for r in rows[:5]]
    add(spark, folder, [answer(n) for n in (2, 30, 50)], ANSWERS, "3")
    deliver_answers(stream(), ["id"], out, buckets=4)
    later = delivered_after(spark, out, 6).orderBy("sequence").collect()
    assert [(r.sequence, r.id) for r in later] == [(7, rows[6].id), (8, "a2"), (9, "a50")]
    assert delivered_after(spark, out, 9).count() == 0


def test_filters_never_miss():
    rng = np.random.default_rng(1)
    held, added = None, []
    for _ in range(3):
        new = rng.integers(-2 ** 63, 2 ** 63 - 1, 2_000)
        held, added = add_to_filter(held, new), [*added, *new]
        assert may_contain(held, np.array(added)).all()
    assert may_contain(held, rng.integers(-2 ** 63, 2 ** 63 - 1, 10_000)).mean() < 0.01
    assert not may_contain(None, np.array(added)).any()


def test_stall_events_come_without_a_further_event_of_the_analysis(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    at = lambda seconds: START + timedelta(seconds=seconds)
    stream = lambda: read_table_stream(spark, str(folder), files_per_batch=1)

    def told():
        found = stall_events(stream(), out, "20 seconds", 100, 200, 300)
        return sorted((r.analysis_id, int((r.stalled_at - START).total_seconds()), r.reason, r.partial_answers) for r in found.collect())

    add(spark, folder, [(1, "started", at(0)), (2, "answer", at(15)), (2, "answer", at(10)), (None, "answer", at(1)), (3, "answer", None)],
        EVENTS, "1")
    assert told() == []
    add(spark, folder, [(1, "answer", at(50)), (9, "answer", at(114)), (3, "heartbeat", at(95))], EVENTS, "2")
    assert told() == []  # the deadline of 2 is 115, the watermark 94
    add(spark, folder, [(9, "answer", at(140))], EVENTS, "3")
    assert told() == [(2, 115, "no progress", 2)]  # 2 itself sent nothing
    add(spark, folder, [(2, "answer", at(145)), (1, "answer", at(148)), (9, "answer", at(230)), (9, "started", at(240))], EVENTS, "4")
    assert told() == [(2, 115, "no progress", 2)]  # alive again; 1 came in time
    add(spark, folder, [(9, "heartbeat", at(450))], EVENTS, "5")
    later = [(1, 248, "no progress", 2), (2, 115, "no progress", 2), (2, 245, "no progress", 3), (3, 395, "no start time", 0),
             (9, 330, "no progress", 3)]
    assert told() == later
    assert told() == later  # nothing new, nothing told again


def test_stall_events_do_not_depend_on_the_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 5_000, 400))
    rows = [(int(rng.integers(1, 9)), str(rng.choice(["answer", "answer", "heartbeat", "started"])), START + timedelta(seconds=int(t)))
            for t in times]
    results = []
    for name, size in (("one", 400), ("some", 130)):
        for n, start in enumerate(range(0, 400, size)):
            part = rows[start:start + size]
            add(spark, tmp_path / name, [part[i] for i in rng.permutation(len(part))], EVENTS, str(n))
        stream = read_table_stream(spark, str(tmp_path / name), files_per_batch=1)
        found = stall_events(stream, str(tmp_path / f"{name}-out"), "10 seconds", 60, 90, 70)
        results.append(sorted(map(tuple, found.collect())))
    assert results[0] == results[1] and len(results[0]) > 20


def test_stored_answers_start_the_progress(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    themes = spark.createDataFrame([(0, 2, "social", "Zero", 2), (1, 1, "social", "Um", 2), (2, 3, "governance", "Dois", 1)],
                                   "theme_id int, display_order int, dimension string, name string, question_count long")
    stored = spark.createDataFrame([answer(0), answer(1), answer(0), answer(2, analysis=2), answer(5, analysis=3)], ANSWERS)
    stream = lambda: read_table_stream(spark, str(folder), files_per_batch=1)

    def events():
        return sorted((r.analysis_id, r.event, r.subject or "", r.answered_count, r.total)
                      for r in track_progress(stream(), themes, out, stored).collect())

    add(spark, folder, [answer(0), answer(1), answer(4), answer(2, analysis=2)], ANSWERS, "1")
    first = [(1, "progress", "", 3, 5), (1, "theme_complete", "Um", 2, 2)]
    assert events() == first
    add(spark, folder, [answer(2), answer(3), answer(4), answer(5, analysis=3)], ANSWERS, "2")
    second = [(1, "analysis_complete", "", 5, 5), (1, "dimension_start", "governance", 0, 5), (1, "progress", "", 5, 5),
              (1, "theme_complete", "Dois", 1, 1), (1, "theme_complete", "Zero", 2, 2), (1, "theme_start", "Dois", 0, 1)]
    assert events() == sorted(first + second)


def test_completed_themes_carry_the_score_of_their_time(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    themes = spark.createDataFrame([(0, 1, "social", "Zero", 2), (1, 2, "social", "Um", 1)],
                                   "theme_id int, display_order int, dimension string, name string, question_count long")
    questions = spark.createDataFrame([(n, n % 3, "Sim") for n in range(6)], "question_pk long, theme_id int, expected_answer string")
    given = {0: "Sim", 1: "Não"}

    def answers():
        return spark.createDataFrame([(1, 7, 2024, q, a) for q, a in given.items()],
                                     "analysis_id long, company_id long, report_year int, question_pk long, answer string")

    def scores():
        stream = read_table_stream(spark, str(folder), files_per_batch=1)
        return sorted((r.theme_id, r.answered_count, r.raw_score) for r in track_scores(stream, themes, questions, answers, out).collect())

    add(spark, folder, [answer(0), answer(1)], ANSWERS, "1")
    assert scores() == [(1, 1, 0.0)]
    given.update({1: "Sim", 3: "Não"})  # the first theme's answer is mended later; its completion was told already
    add(spark, folder, [answer(3)], ANSWERS, "2")
    assert scores() == [(0, 2, 5.0), (1, 1, 0.0)]


class _Handle:
    """State in memory that counts its round trips."""

    def __init__(self):
        self.calls, self.maps, self.values = 0, {}, {}

    def getMapState(self, name, *_):
        return _State(self, self.maps.setdefault(name, {}))

    def getValueState(self, name, *_):
        return _State(self, self.values.setdefault(name, {}))


class _State:
    def __init__(self, handle, held):
        self.handle, self.held = handle, held

    def getValue(self, key):
        self.handle.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.held[key] = value

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    containsKey = lambda self, key: self.getValue(key) is not None
    exists = lambda self: self.get() is not None


def test_progress_state_is_read_by_pages_not_by_question():
    def rows(questions):
        return pd.DataFrame([(1, q, q % 2, q % 2, "social", f"T{q % 2}", 300, 600) for q in questions],
                            columns=["analysis_id", "question_pk", "theme_id", "display_order", "dimension", "name", "questions", "total"])

    handle, tracker = _Handle(), ProgressTracker()
    tracker.init(handle)
    say = lambda questions: [r for part in tracker.handleInputRows((1,), iter([rows(questions)]), None)
                             for r in part.itertuples(index=False, name=None)]
    far = [-5, 2**40, 2**40 + 1]  # ids of pages of their own
    told = say([*range(500), *range(500), *far])
    assert ("progress", 503, 600) == (told[-1][1], *told[-1][3:]) and handle.calls <= 10
    assert say([3, 499, *far]) == []  # known ones
    told = say([2**40, 2**40 + 2, *range(490, 596)])
    assert [e[1] for e in told] == ["theme_complete", "theme_complete", "progress", "analysis_complete"] and told[2][3] == 600


def test_progress_of_many_analyses_is_kept_in_shared_pages():
    rng, calls = np.random.default_rng(5), []
    catalogue = pd.DataFrame([(t, 9 - t, f"D{t % 3}", f"T{t}", 40) for t in range(8)],
                             columns=["theme_id", "display_order", "dimension", "name", "questions"])
    handle, tracker = _Handle(), PackedProgress(catalogue)
    tracker.init(handle)
    known, ids = {}, rng.choice(10**9, 300, replace=False).tolist()
    for batch in range(4):
        rows = [(ids[i], int(q) * 1000) for i, q in zip(rng.integers(0, 300 if batch < 3 else 2, 9_000), rng.integers(0, 120, 9_000))]
        flat = pd.DataFrame([(a, q, q // 1000 % 8) for a, q in rows], columns=["analysis_id", "question_pk", "theme_id"])
        parts = [flat.iloc[:5_000], flat.iloc[5_000:]]
        packed = pd.DataFrame([(0, *[p[c].to_numpy() for c in flat.columns]) for p in parts], columns=["bucket", *flat.columns])
        handle.calls = 0
        told = [r for part in tracker.handleInputRows((0,), iter([packed]), None) for r in part.itertuples(index=False, name=None)]
        calls.append(handle.calls)
        want = set()
        for a in {a for a, _ in rows}:
            had = known.setdefault(a, set())
            now = had | {q for b, q in rows if b == a}
            count = lambda seen, t: sum(q // 1000 % 8 == t for q in seen)
            for t in range(8):
                if not count(had, t) and count(now, t):
                    want.add((a, "theme_start", f"T{t}", 0, 40))
                if count(had, t) < 40 <= count(now, t):
                    want.add((a, "theme_complete", f"T{t}", count(now, t), 40))
                if count(now, t) and not any(count(had, s) for s in range(8) if s % 3 == t % 3):
                    want.add((a, "dimension_start", f"D{t % 3}", 0, 320))
            if now != had:
                want.add((a, "progress", None, len(now), 320))
            known[a] = now
        assert len(told) == len(want) and set(told) == want
        places = [(ids.index(a), event) for a, event, *_ in told]
        assert all(e == "progress" for (a, e), (b, _) in zip(places, [*places[1:], (None, None)]) if a != b)  # an analysis's events lie together
    assert max(calls) < 200 and calls[3] < 100  # not per analysis or question


def test_answers_are_packed_by_bucket():
    rng = np.random.default_rng(6)
    flat = pd.DataFrame({"analysis_id": [7] * 40_000 + rng.integers(-10**12, 10**12, 4_000).tolist(),
                         "question_pk": [*range(20_000), *range(20_000), *range(4_000)], "theme_id": 1})
    rows = pd.concat(packed_in_task(iter([flat.iloc[:30_000], flat.iloc[30_000:]])))
    assert len(rows) < 1_030 and max(map(len, rows["question_pk"])) <= 1 << 14
    back = [(a, q) for r in rows.itertuples() for a, q in zip(r.analysis_id, r.question_pk)]
    assert len(back) == len(set(back)) == 24_000 and set(back) == set(zip(flat["analysis_id"], flat["question_pk"]))
    buckets = {}
    for r in rows.itertuples():
        assert all(buckets.setdefault(a, r.bucket) == r.bucket for a in set(r.analysis_id.tolist()))

"""The streaming jobs, run over the test tables as streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.plans.checks import sql_rating
from veritrail.plans.fixtures import VIEWS
from veritrail.plans.registry import query
from veritrail.plans.scoring_queries import stored_answers
from veritrail.session import work_path
from veritrail.streaming.answers import deliver_answers, delivered_after
from veritrail.streaming.ingest import ingest_documents
from veritrail.streaming.progress import track_progress, track_scores
from veritrail.streaming.runs import read_table_stream
from veritrail.streaming.stalls import stall_events, watch_stalls

ANSWER_ID = ["l_orderkey", "l_linenumber", "analysis_id", "question_pk", "created_at", "answer"]


def stream_of(fx, view: str, table: str):
    """A view whose only table is read as a stream."""
    return fx.spark.sql(VIEWS[view], **{table: read_table_stream(fx.spark, fx.folder, f"{table}.parquet")})


@query("stream_answers", """
SELECT DISTINCT l_orderkey, l_linenumber, analysis_id, question_pk, created_at, answer FROM {d_answers_raw}""")
def _(fx):
    stream = stream_of(fx, "d_answers_raw", "lineitem").select(*ANSWER_ID)
    return deliver_answers(stream, ANSWER_ID, work_path(fx.spark, "answers")).drop("sequence")


# One batch here, so the numbers follow the created order of the whole table; a reader goes on behind the first thousand.
@query("resumed_delivery", """
SELECT *, row_number() OVER (ORDER BY created_at, l_orderkey, l_linenumber, analysis_id, question_pk, answer) AS sequence
FROM (SELECT DISTINCT l_orderkey, l_linenumber, analysis_id, question_pk, created_at, answer FROM {d_answers_raw}) QUALIFY sequence > 1000""")
def _(fx):
    stream, path = stream_of(fx, "d_answers_raw", "lineitem").select(*ANSWER_ID), work_path(fx.spark, "answers")
    deliver_answers(stream, ANSWER_ID, path)
    return delivered_after(fx.spark, path, 1000)


# A theme counts as answered with two to four questions here, so that some complete.
_NEEDED = "2 + theme_id % 3"


@query("stream_progress", f"""
WITH themes AS (SELECT theme_id, name, dimension, CAST({_NEEDED} AS BIGINT) AS needed FROM {{d_themes}}),
whole AS (SELECT CAST(sum(needed) AS BIGINT) AS total FROM themes),
counts AS (SELECT analysis_id, theme_id, count(DISTINCT question_pk) AS n FROM {{d_answers_raw}} JOIN {{d_questions}} USING (question_pk) GROUP BY 1, 2),
totals AS (SELECT analysis_id, CAST(sum(n) AS BIGINT) AS answered FROM counts GROUP BY 1)
SELECT DISTINCT analysis_id, 'dimension_start' AS event, dimension AS subject, 0::BIGINT AS answered_count, total FROM counts JOIN themes USING (theme_id), whole
UNION ALL SELECT analysis_id, 'theme_start', name, 0, needed FROM counts JOIN themes USING (theme_id)
UNION ALL SELECT analysis_id, 'theme_complete', name, n, needed FROM counts JOIN themes USING (theme_id) WHERE n >= needed
UNION ALL SELECT analysis_id, 'progress', NULL, answered, total FROM totals, whole
UNION ALL SELECT analysis_id, 'analysis_complete', NULL, answered, total FROM totals, whole WHERE answered >= total""")
def _(fx):
    questions = fx["d_questions"].select("question_pk", "theme_id")
    stream = stream_of(fx, "d_answers_raw", "lineitem").select("analysis_id", "question_pk").join(questions, "question_pk")
    themes = fx["d_themes"].withColumn("question_count", F.expr(_NEEDED))
    return track_progress(stream, themes, work_path(fx.spark, "progress"))


# The answers of the first two lines are stored already when the stream of all answers begins.
@query("resumed_progress", f"""
WITH themes AS (SELECT theme_id, name, dimension, CAST({_NEEDED} AS BIGINT) AS needed FROM {{d_themes}}),
whole AS (SELECT CAST(sum(needed) AS BIGINT) AS total FROM themes),
counts AS (SELECT analysis_id, theme_id, count(DISTINCT question_pk) AS n,
    count(DISTINCT question_pk) FILTER (WHERE l_linenumber <= 2) AS k FROM {{d_answers_raw}} JOIN {{d_questions}} USING (question_pk) GROUP BY 1, 2),
sides AS (SELECT analysis_id, dimension, sum(k) AS k FROM counts JOIN themes USING (theme_id) GROUP BY 1, 2),
totals AS (SELECT analysis_id, CAST(sum(n) AS BIGINT) AS answered, CAST(sum(k) AS BIGINT) AS k FROM counts GROUP BY 1)
SELECT analysis_id, 'dimension_start' AS event, dimension AS subject, 0::BIGINT AS answered_count, total FROM sides, whole WHERE k = 0
UNION ALL SELECT analysis_id, 'theme_start', name, 0, needed FROM counts JOIN themes USING (theme_id) WHERE k = 0
UNION ALL SELECT analysis_id, 'theme_complete', name, n, needed FROM counts JOIN themes USING (theme_id) WHERE k < needed AND n >= needed
UNION ALL SELECT analysis_id, 'progress', NULL, answered, total FROM totals, whole WHERE answered > k
UNION ALL SELECT analysis_id, 'analysis_complete', NULL, answered, total FROM totals, whole WHERE k < total AND answered >= total""")
def _(fx):
    questions = fx["d_questions"].select("question_pk", "theme_id")
    stream = stream_of(fx, "d_answers_raw", "lineitem").select("analysis_id", "question_pk").join(questions, "question_pk")
    stored = fx["d_answers_raw"].where("l_linenumber <= 2").join(questions, "question_pk")
    themes = fx["d_themes"].withColumn("question_count", F.expr(_NEEDED))
    return track_progress(stream, themes, work_path(fx.spark, "progress"), stored)


@query("completion_scores", f"""
WITH themes AS (SELECT theme_id, {_NEEDED} AS needed FROM {{d_themes}}),
counts AS (SELECT analysis_id, theme_id, count(DISTINCT question_pk) AS answered_count
  FROM {{d_answers_raw}} JOIN {{d_questions}} USING (question_pk) GROUP BY 1, 2)
SELECT analysis_id, CAST(theme_id AS INT) AS theme_id, answered_count, raw_score, {sql_rating('raw_score')} AS rating
FROM counts JOIN themes USING (theme_id) LEFT JOIN {{o_theme_scores}} USING (analysis_id, theme_id) WHERE answered_count >= needed""")
def _(fx):
    questions = fx["d_questions"].select("question_pk", "theme_id")
    stream = stream_of(fx, "d_answers_raw", "lineitem").select("analysis_id", "question_pk").join(questions, "question_pk")
    themes = fx["d_themes"].withColumn("question_count", F.expr(_NEEDED))
    return track_scores(stream, themes, fx["d_questions"], lambda: stored_answers(fx), work_path(fx.spark, "scores"))


@query("stream_stalls", """
WITH seen AS (SELECT analysis_id, max(ts) FILTER (WHERE kind = 'answer') AS last_answer,
    min(ts) FILTER (WHERE kind = 'started') AS started_at, max(ts) FILTER (WHERE kind = 'heartbeat') AS heartbeat_at,
    count(*) FILTER (WHERE kind = 'answer') AS partial_answers
  FROM {d_progress} WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
aged AS (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_answer) AS idle,
    epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(started_at) AS age,
    epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(heartbeat_at) AS beat FROM seen)
SELECT analysis_id, partial_answers, CASE WHEN last_answer IS NOT NULL THEN 'no progress'
       WHEN started_at IS NULL THEN 'no start time' ELSE 'no answers' END AS reason
FROM aged WHERE (beat IS NULL OR beat >= 36000) AND CASE WHEN last_answer IS NOT NULL THEN idle > 43200
       WHEN started_at IS NULL THEN TRUE ELSE age > 86400 END""")
def _(fx):
    stream = stream_of(fx, "d_progress", "events")
    stalled = watch_stalls(stream, "2024-01-31 00:00:00", work_path(fx.spark, "stalls"), 43200, 86400, 36000)
    return stalled.select("analysis_id", "partial_answers", "reason")


# Every stall that the watermark, an hour behind the newest event, has passed.
@query("stall_events", """
WITH signs AS (SELECT analysis_id, epoch_us(ts) // 1000 AS ms, count(*) FILTER (WHERE kind = 'answer') AS n,
    bool_or(kind = 'started') AS s, bool_or(kind = 'heartbeat') AS h FROM {d_progress} GROUP BY 1, 2),
running AS (SELECT analysis_id, ms, max(CASE WHEN n > 0 THEN ms END) OVER w AS last_answer, min(CASE WHEN s THEN ms END) OVER w AS started_at,
    max(CASE WHEN h THEN ms END) OVER w AS heartbeat_at, CAST(sum(n) OVER w AS BIGINT) AS partial_answers, lead(ms) OVER w AS following
  FROM signs WINDOW w AS (PARTITION BY analysis_id ORDER BY ms)),
timed AS (SELECT *, greatest(CASE WHEN last_answer IS NOT NULL THEN last_answer + 43200000 ELSE started_at + 86400000 END,
    heartbeat_at + 36000000) AS due FROM running)
SELECT DISTINCT analysis_id, make_timestamp(due * 1000) AS stalled_at, partial_answers,
       CASE WHEN last_answer IS NOT NULL THEN 'no progress' WHEN started_at IS NULL THEN 'no start time' ELSE 'no answers' END AS reason
FROM timed WHERE due < coalesce(following, due + 1) AND due < (SELECT max(epoch_us(ts) // 1000) - 3600000 FROM {d_progress})""")
def _(fx):
    stream = stream_of(fx, "d_progress", "events")
    return stall_events(stream, work_path(fx.spark, "stall-events"), "1 hour", 43200, 86400, 36000)


@query("stream_ingest", """
SELECT doc_id, report_year, CASE WHEN n IS NULL OR doc_id % 50 = 0 THEN 'error' ELSE 'ready' END AS status,
       CASE WHEN doc_id % 50 = 0 THEN 0 ELSE coalesce(n, 0) END AS chunk_count,
       CASE WHEN n IS NULL OR doc_id % 50 = 0 THEN 0 ELSE page_count END AS page_count
FROM {d_documents} LEFT JOIN (SELECT doc_id, count(*) AS n FROM {o_chunks} GROUP BY 1) USING (doc_id)""")
def _(fx):
    emptied = F.when(F.col("doc_id") % 50 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    stream = stream_of(fx, "d_documents", "documents").withColumn("text", emptied)
    _, status = ingest_documents(stream, work_path(fx.spark, "ingest"))
    return status.drop("batch")

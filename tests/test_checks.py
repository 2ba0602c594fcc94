"""Every registered query against its SQL at the smallest scale, and the shape of its plan."""

import os

import pytest

from __spark_entry__ import entry
from tests.compare import compare, connect
from veritrail.plans.registry import check_sql, spark_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")
QUERIES, CHECKS = spark_queries(), check_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    problem, rows = compare(spark, duck, FOLDER, QUERIES[name], CHECKS.get(name))
    assert problem is None, problem
    assert rows > 0 or name == "embedding_backlog"  # every document has a vector at this scale


def test_every_query_has_sql():
    assert set(CHECKS) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_invariants(spark):
    scores = QUERIES["overall_scores"](spark, FOLDER).collect()
    assert all(0 <= r.overall_score <= 10 for r in scores)
    ordered = sorted(scores, key=lambda r: -r.overall_score)
    letters = [r.overall_rating for r in ordered]
    assert letters == sorted(letters)
    filled = QUERIES["fill_answers"](spark, FOLDER)
    assert filled.count() == filled.select("analysis_id", "question_pk").distinct().count()
    log = QUERIES["replay_log"](spark, FOLDER).where("event = 'question_answered'").groupBy("analysis_id").count()
    stream = QUERIES["stream_progress"](spark, FOLDER).where("event = 'progress'")
    assert {(r[0], r[1]) for r in log.collect()} == {(r.analysis_id, r.answered_count) for r in stream.collect()}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    from veritrail.plans.fixtures import fixtures

    text = plan(fixtures(spark, FOLDER)["d_questions"].where("question_pk = 7").select("question_id"))
    assert "EqualTo(p_partkey,7)" in text
    scan = text[text.index("ReadSchema"):]
    assert "p_name" not in scan and "p_size" not in scan


@pytest.mark.parametrize("name", ["dedup_answers_last", "dedup_answers_first", "latest_documents", "keyword_topk"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["page_text", "page_links", "rank_links"])
def test_page_jobs_stay_row_local(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "Exchange" not in text
    assert "Python" not in text and "Pandas" not in text


def test_chunker_stays_in_the_jvm(spark):
    text = plan(QUERIES["chunks"](spark, FOLDER))
    assert "Python" not in text and "Pandas" not in text
    assert text.count("aggregate(") == 1  # the packing is computed once, not again in a size filter

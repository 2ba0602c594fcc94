"""What the larger jobs sort, shuffle and measure: small tests of how the work is laid out."""

import re

from pyspark.sql import functions as F

from veritrail.operators import answers as A
from veritrail.operators import reports as R
from veritrail.plans import scoring_queries as Q
from veritrail.plans.fixtures import fixtures
from veritrail.plans.registry import spark_queries
from veritrail.plans.retrieval_queries import searchable_chunks
from veritrail.plans.source_queries import text_chunks
from veritrail.session import Job
from veritrail.sources.payloads import ingest_answers
from veritrail.streaming.answers import deliver_answers
from veritrail.streaming.runs import read_table_stream

FOLDER = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_answers_are_made_after_the_latest_are_picked(spark):
    plan = optimized(Q.usable_details(fixtures(spark, FOLDER)))
    above, window, below = plan.partition("Window [")
    assert window and "Trecho" in above and "Trecho" not in below


def test_control_characters_are_listed_one_by_one(spark):
    text = "".join(map(chr, range(0x200))) + "—😀"
    kept = "".join(c for c in text if c in "\t\n\r" or not (ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0))
    assert spark.range(1).select(R._printable(F.lit(text))).first()[0] == kept
    assert "-" not in R._CONTROL


def test_stored_answers_leave_out_what_only_orders_them(spark):
    columns = Q.stored_answers(fixtures(spark, FOLDER)).columns
    assert columns == ["analysis_id", "company_id", "report_year", "question_pk", "created_at", "confidence_score", "answer"]


def test_question_texts_are_not_joined_before_the_scores(spark):
    answers = spark.createDataFrame([(1, 1, "Sim"), (1, 2, "Não"), (2, 9, "Sim")], "analysis_id int, question_pk int, answer string")
    questions = spark.createDataFrame([(1, 5, "um"), (2, 6, "dois")], "question_pk int, theme_id int, question_text string")
    themes = spark.createDataFrame([(5, "T", "social", 1)], "theme_id int, name string, dimension string, display_order int")
    scores = spark.createDataFrame([(1, 5, 2.5, "D")], "analysis_id int, theme_id int, raw_score double, rating string")
    found = R.analysis_results(answers, questions, themes, scores)
    got = {(r["analysis_id"], r["question_pk"]): tuple(r) for r in found.collect()}
    assert got == {(1, 1): (1, 5, 1, "Sim", "um", "T", "social", 1, 2.5, "D"),
                   (1, 2): (1, 6, 2, "Não", "dois", None, None, None, None, None),
                   (2, 9): (2, None, 9, "Sim", None, None, None, None, None, None)}
    lines = [line for line in optimized(found).splitlines() if "Join LeftOuter" in line]
    with_score = [line for line in lines if "analysis_id" in line]
    assert len(lines) == 4 and lines.index(with_score[0]) == 2  # the last but one to be read, so the second to be joined


def test_records_are_cut_before_their_questions_are_looked_up(spark):
    fx = fixtures(spark, FOLDER)
    questions = fx["d_questions"].join(fx["d_themes"].select("theme_id", "dimension"), "theme_id")
    records = A.answer_records(fx["d_answer_details"], questions)
    above, join, below = optimized(records).partition("Join Inner")
    assert join and "substring" not in above and "substring" in below
    assert "SortMergeJoin" not in records._jdf.queryExecution().executedPlan().toString()


def test_replies_are_not_trimmed_at_both_ends(spark):
    item = '{"question_id": "1.1", "answer": "Sim"}'
    texts = [f" \n{item}　\t", f"\x1c[{item}]  ", f' {{"answers": {item}}} ']
    replies = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    found = ingest_answers(replies, ["i"])
    assert sorted((r.i, r.question_id, r.answer) for r in found.collect()) == [(i, "1.1", "Sim") for i in range(3)]
    assert not re.search(r"(?i)(?<![lr])trim\(", optimized(found))


def test_numbered_answers_are_written_once(spark, tmp_path, monkeypatch):
    kept, keep = [], Job.keep
    monkeypatch.setattr(Job, "keep", lambda job, df, name, *by: kept.append(name) or keep(job, df, name, *by))
    rows = [(f"a{i}", f"2024-01-{i % 28 + 1:02d}") for i in range(200)]
    spark.createDataFrame(rows, "id string, created_at string").write.parquet(str(tmp_path / "in"))
    stream = read_table_stream(spark, str(tmp_path / "in"))
    found = deliver_answers(stream, ["id"], str(tmp_path / "out"), buckets=4).orderBy("sequence").collect()
    assert [(r.created_at, r.id, r.sequence) for r in found] == [(d, a, n + 1) for n, (d, a) in enumerate(sorted((d, a) for a, d in rows))]
    assert spark.read.parquet(str(tmp_path / "out" / "ids")).count() == 200 and kept == ["new"]


def test_slots_of_the_replies_are_a_table(spark):
    fx = fixtures(spark, FOLDER)
    spark_queries()["take_in_answers"](spark, FOLDER)
    assert "slots" in fx._frames


def test_answers_are_numbered_once_for_the_themes_of_a_log(spark):
    plan = optimized(spark_queries()["replay_log"](spark, FOLDER))
    assert plan.count("Window [row_number()") == 2  # the answers and the events; the themes reached are a table


def test_texts_of_searchable_chunks_are_not_shuffled(spark):
    fx = fixtures(spark, FOLDER)
    found = searchable_chunks(fx)
    documents = fx["d_documents"].where("status = 'ready'").select("company_id", "report_year", "doc_id", "filename")
    joined = text_chunks(fx).join(documents, "doc_id").select(*found.columns)
    assert found.count() == joined.count() > 0 and found.exceptAll(joined).isEmpty()
    assert "Join" not in optimized(found)
    assert not {"company_id", "report_year", "filename", "status"} & set(text_chunks(fx).columns)

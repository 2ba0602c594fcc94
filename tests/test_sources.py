import json

from pyspark.sql import functions as F

from veritrail.operators.reports import export_detail
from veritrail.sources.cells import extract_questionnaire, extraction_summary
from veritrail.sources.payloads import ingest_answers, rejected_replies
from veritrail.sources.sinks import write_chunks, write_export, write_json
from veritrail.sources.tables import read_chunks, read_page_files


def test_payload_shapes(spark):
    a, b = {"question_id": "1.1", "answer": "Sim", "confidence_score": 0.5}, {"question_id": "1.2", "answer": "Não", "extra": [1]}
    payloads = [
        json.dumps(a), json.dumps([a, b]), json.dumps({"answers": [a, b]}), json.dumps({"results": [b]}), json.dumps({"respostas": [a]}),
        json.dumps({"answers": a}), json.dumps({"answers": [a], "results": [b, b]}), "not json", "", "[]", json.dumps({"answers": []}),
        " " + json.dumps({"note": {"answers": 1}, "results": [b]}), json.dumps({"answers": [a, b]})[:-9], "5", '"text"', "null",
    ]
    frame = spark.createDataFrame(list(enumerate(payloads)), "i int, payload string")
    got: dict = {}
    for r in ingest_answers(frame, ["i"]).orderBy("i", "ordinal").collect():
        got.setdefault(r.i, []).append((r.ordinal, r.question_id, r.answer))
    one, two = (0, "1.1", "Sim"), (1, "1.2", "Não")
    assert {i: got[i] for i in (0, 1, 2, 3, 4, 5, 6, 11)} == {
        0: [one], 1: [one, two], 2: [one, two], 3: [(0, "1.2", "Não")], 4: [one], 5: [one], 6: [one], 11: [(0, "1.2", "Não")],
    }
    assert not {7, 8, 9, 10, 12, 13, 14, 15} & set(got)


def test_payload_numbers_and_strings(spark):
    rows = [("[{\"question_id\": 1.1, \"answer\": \"Sim\", \"confidence_score\": \"0.9\"}, {\"confidence_score\": 1}, {\"confidence_score\": \"high\"}]",)]
    got = ingest_answers(spark.createDataFrame(rows, "payload string"), []).orderBy("ordinal").collect()
    assert [(r.question_id, r.confidence_score) for r in got] == [("1.1", 0.9), (None, 1.0), (None, None)]


def test_cells(spark):
    rows = [
        ("T", 1, "B", "1.1.1 Possui meta?", True), ("T", 1, "E", " Sim ", True), ("T", 1, "F", "", True), ("T", 1, "L", "p. 3", True),
        ("T", 2, "A", "2.1", True), ("T", 2, "C", "curto", True), ("T", 2, "D", "texto bem comprido", True),
        ("T", 3, "C", "pergunta sem id longa", True), ("T", 3, "E", "N/A", True),
        ("T", 4, "C", "sem id curta", True), ("T", 4, "E", "Sim", True),
        ("T", 5, "B", "1.2", False), ("T", 5, "C", "12345678901234", False), ("T", 5, "F", "0.0", False), ("T", 5, "L", "x", True),
        ("T", 6, "B", "Seção 3.1", True), ("T", 6, "C", "3.1.2", True), ("T", 6, "Z", "ignored", True),
        ("Capa", 1, "B", "1.1.1 x", True),
    ]
    cells = spark.createDataFrame(rows, "sheet string, row_number int, col string, value string, is_text boolean")
    got = extract_questionnaire(cells)
    by_row = {r.row_number: (r.question_id, r.question_text, r.answer, r.source) for r in got.collect()}
    assert by_row == {
        1: ("1.1.1", "Possui meta?", "Sim", "p. 3"), 2: ("2.1", "texto bem comprido", None, None),
        3: (None, "pergunta sem id longa", "N/A", None), 5: ("1.2", None, None, "x"), 6: ("3.1.2", None, None, None),
    }
    assert [tuple(r) for r in extraction_summary(got).collect()] == [("T", 5, 1)]


def test_chunk_table_is_read_by_year(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "a", 1, None, None, 2023), (2, 0, "b", 1, 4, [4], 2024)],
                                   "doc_id long, chunk_index int, content string, token_count int, page_number int, page_range array<int>, report_year int")
    write_chunks(chunks, str(tmp_path / "chunks"))
    year = read_chunks(spark, str(tmp_path / "chunks"), 2024)
    assert [(r.doc_id, r.page_range) for r in year.collect()] == [(2, [4])]
    assert "PartitionFilters: [isnotnull(report_year" in year._jdf.queryExecution().executedPlan().toString()
    assert read_chunks(spark, str(tmp_path / "chunks")).count() == 2


def test_json_keeps_nulls(spark, tmp_path):
    write_json(spark.createDataFrame([("1.1", None)], "question_id string, answer string"), str(tmp_path / "j"))
    lines = [json.loads(line) for f in (tmp_path / "j").glob("*.json") for line in f.read_text().splitlines()]
    assert lines == [{"question_id": "1.1", "answer": None}]


def test_export(spark, tmp_path):
    asked = spark.createDataFrame([(1, 1), (1, 2)], "analysis_id long, question_pk long")
    questions = spark.createDataFrame([(1, 5, 1, "1.1", "1.1. P\u0007"), (2, 5, 2, "1.2", "Q")],
                                      "question_pk long, theme_id int, display_order int, question_id string, question_text string")
    themes = spark.createDataFrame([(5, "social", 3)], "theme_id int, dimension string, display_order int")
    answers = spark.createDataFrame([(1, 1, "Sim", 0.456, 'a "b"\u0000\u009f,c\nd', None, "m")],
                                    "analysis_id long, question_pk long, answer string, confidence_score double, justification string, source_reference string, improvement_points string")
    detail = export_detail(asked, questions, themes, answers)
    rows = {r.question_pk: r for r in detail.collect()}
    assert (rows[1].answer, rows[1].confidence, rows[1].justification) == ("Sim", 0.46, 'a "b",c\nd')
    assert (rows[2].answer, rows[2].confidence, rows[2].question) == ("—", None, "Q")
    write_export(detail, str(tmp_path / "x"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "x"))
    assert {(r.dimension, r.question_pk, r.answer, r.justification) for r in back.collect()} == {
        ("social", "1", "Sim", 'a "b",c\nd'), ("social", "2", "—", None)}


def test_page_files_are_decoded_with_replacement(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("olá ".encode() + b"\xff" + b" fim")
    row = read_page_files(spark, str(tmp_path)).select(F.element_at(F.split("url", "/"), -1).alias("f"), "html").first()
    assert (row.f, row.html) == ("a.html", "olá � fim")


def test_page_files_take_their_address_from_the_manifest(spark, tmp_path):
    (tmp_path / "site").mkdir()
    for name in ("a.html", "b.html"):
        (tmp_path / "site" / name).write_text(name)
    manifest = spark.createDataFrame([("site/a.html", "https://x.org/ri/")], "path string, url string")
    rows = {r.html: r.url for r in read_page_files(spark, str(tmp_path), manifest).collect()}
    assert rows["a.html"] == "https://x.org/ri/" and rows["b.html"].endswith("/site/b.html")


def test_objects_without_a_question_id_are_rejected(spark):
    rows = [(1, '{"data": [{"question_id": "1.1"}]}'), (2, '[{"question_id": " "}, {"question_id": "1.2", "answer": "Sim"}, {"answer": "Sim"}]'), (3, '{"question_id": 7}')]
    frame = spark.createDataFrame(rows, "i int, payload string")
    assert {(r.i, r.question_id) for r in ingest_answers(frame, ["i"]).where("trim(question_id) <> ''").collect()} == {(2, "1.2"), (3, "7")}
    odd = sorted((r.i, r.reason, r.payload) for r in rejected_replies(frame, ["i"]).collect())
    assert odd == [(1, "no question id", rows[0][1].replace(" ", "")), (2, "no question id", '{"answer":"Sim"}'), (2, "no question id", '{"question_id":" "}')]


def test_replies_with_equal_keys_are_judged_apart(spark):
    frame = spark.createDataFrame([(1, "nada"), (1, '[{"question_id": "1.1"}, 5]'), (None, "7")], "i int, payload string")
    odd = sorted((r.i or 0, r.reason, r.payload) for r in rejected_replies(frame, ["i"]).collect())
    assert odd == [(0, "no answer", "7"), (1, "no answer", "nada"), (1, "not an object", "5")]

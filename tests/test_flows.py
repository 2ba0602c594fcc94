"""Page to chunk, question to prompt, reply to score, on a few inline rows."""

import json

from veritrail.plans import flow_queries, flows
from veritrail.plans.fixtures import fixtures

WEB = "<html><body><nav>menu</nav><article>" + "".join(f"<p>Bloco {i} " + "texto " * 60 + "</p>" for i in range(12)) + "</article></body></html>"


def test_pages_to_chunks(spark):
    pages = spark.createDataFrame([(1, "u", WEB), (2, "u", "<p>curto</p>")], "page_id int, url string, html string")
    rows = flows.chunk_web_pages(pages, ["page_id"]).orderBy("chunk_index").collect()
    assert [(r.page_id, r.chunk_index) for r in rows] == [(1, 0), (1, 1)]
    assert rows[0].token_count == 496 and rows[1].content.startswith("Bloco 7")


def test_questions_to_scores(spark):
    themes = spark.createDataFrame([(1, "Energia renovável", "environmental"), (2, "Conselho", "governance")], "theme_id int, name string, dimension string")
    questions = spark.createDataFrame(
        [(10 + i, 1, i, f"1.1.{i}", f"1.1.{i}. Possui metas energéticas?", "Sim", "environmental") for i in range(1, 7)]
        + [(20, 2, 9, "2.1.1", "Possui conselho independente?", "Não", "governance")],
        "question_pk long, theme_id int, display_order int, question_id string, question_text string, expected_answer string, dimension string")
    documents = spark.createDataFrame([(1, 7, 2024, "rel.pdf", "ready"), (2, 7, 2024, "x.pdf", "error")],
                                      "doc_id long, company_id long, report_year int, filename string, status string")
    chunks = spark.createDataFrame(
        [(1, 0, "Energia solar e metas energéticas", 3, [3]), (1, 1, "Conselho independente", None, None), (2, 0, "energia", 1, [1])],
        "doc_id long, chunk_index int, content string, page_number int, page_range array<int>")
    hits = flows.retrieve(themes, questions, chunks, documents)
    assert {(r.query_id, r.chunk_index) for r in hits.collect()} == {(1, 0), (2, 1)}

    asked = questions.selectExpr("1L AS analysis_id", "7L AS company_id", "2024 AS report_year", "question_pk")
    prompts = flows.build_prompts(asked, questions, hits).orderBy("theme_id", "batch").collect()
    assert [(r.theme_id, r.batch, r.questions) for r in prompts] == [(1, 1, 5), (1, 2, 1), (2, 1, 1)]
    assert prompts[0].context == "[FONTE: rel.pdf, p.3]\nEnergia solar e metas energéticas"
    had = spark.createDataFrame([(1, 11), (1, 12)], "analysis_id long, question_pk long")
    rest = flows.build_prompts(asked, questions, hits, had).orderBy("theme_id", "batch").collect()
    assert [(r.theme_id, r.batch, r.questions) for r in rest] == [(1, 1, 4), (2, 1, 1)]

    replies = spark.createDataFrame([
        (1, 1, 1, json.dumps({"answers": [
            {"question_id": "1.1.1", "answer": "sim", "source_reference": "N/A", "confidence_score": 2},
            {"question_id": "ID 1.1.2", "answer": "Nao", "source_reference": "rel.pdf, p.9"},
            {"question_id": "1.1.3", "answer": "não sei"}]})),
        (1, 1, 2, json.dumps([{"question_id": "1.1.6", "answer": "Sim"}])),
        (1, 2, 1, json.dumps({"question_id": "2.1.1", "answer": "Não", "justification": "trecho"})),
    ], "analysis_id long, theme_id int, batch long, payload string")
    records = flows.take_in_answers(flows.question_slots(asked, questions), replies, questions, hits)
    rows = {r.question_pk: r for r in records.collect()}
    assert {q: (r.answer, r.score) for q, r in rows.items()} == {
        11: ("Sim", 10.0), 12: ("Não", 0.0), 13: ("N/A", 0.0), 14: ("N/A", 0.0), 15: ("N/A", 0.0), 16: ("Sim", 10.0), 20: ("Não", 10.0)}
    assert (rows[11].source_reference, rows[11].confidence_score) == ("rel.pdf, p.3", 1.0)
    assert (rows[12].source_reference, rows[20].source_reference) == ("rel.pdf, p.9", "rel.pdf")
    assert rows[14].justification.startswith("Não foi possível") and rows[20].agent_name == "Agente Governança"

    stored = asked.join(records.drop("analysis_id"), "question_pk")
    companies = spark.createDataFrame([(7, "Energia")], "company_id long, sector string")
    weights = spark.createDataFrame([("Energia", 1, 2.0)], "sector string, theme_id int, weight double")
    themed, overall = flows.score_analyses(stored, questions, themes, companies, weights)
    assert {(r.theme_id, r.raw_score, r.weighted_score) for r in themed.collect()} == {(1, 6.67, 13.34), (2, 10.0, 10.0)}
    row = overall.first()
    assert (row.environmental_score, row.social_score, row.governance_score) == (6.67, 0.0, 10.0)
    assert (row.overall_score, row.overall_rating) == (round(6.67 * 0.35 + 3.5, 2), "C")


def test_second_reply_white_space_and_missing_values(spark):
    questions = spark.createDataFrame([(1, 1, 1, "1.1.1", "a", "Sim", "social"), (2, 1, 2, "1.1.2", "b", "Sim", "social")],
                                      "question_pk long, theme_id int, display_order int, question_id string, question_text string, expected_answer string, dimension string")
    asked = questions.selectExpr("1L AS analysis_id", "7L AS company_id", "2024 AS report_year", "question_pk")
    replies = spark.createDataFrame([
        (1, 1, 1, 0, '\n\t{"answers": [{"question_id": "1.1.1", "answer": "Sim"}]}'),
        (1, 1, 1, 1, ' \t["x", {"question_id": "1.1.2", "justification": "porque", "confidence_score": "0.7"}]'),
        (1, 1, 1, 2, "nothing"),
    ], "analysis_id long, theme_id int, batch long, reply int, payload string")
    hits = spark.createDataFrame([], "company_id long, report_year int, query_id int, rank int, filename string, page_number int, page_range array<int>")
    rows = {r.question_pk: r for r in flows.take_in_answers(flows.question_slots(asked, questions), replies, questions, hits).collect()}
    assert len(rows) == 2 and rows[1].answer == "Sim"
    assert (rows[2].answer, rows[2].justification, rows[2].confidence_score) == ("N/A", "porque", 0.7)
    from veritrail.sources.payloads import rejected_replies
    odd = rejected_replies(replies, ["analysis_id", "reply"]).collect()
    assert sorted((r.reply, r.reason, r.payload) for r in odd) == [(1, "not an object", "x"), (2, "no answer", "nothing")]


def test_a_resumed_run_reaches_its_questions(spark):
    questions = spark.createDataFrame([(i, 1, i, f"1.1.{i}", f"texto {i}", "Sim", "social") for i in range(1, 13)],
                                      "question_pk long, theme_id int, display_order int, question_id string, question_text string, expected_answer string, dimension string")
    asked = questions.selectExpr("1L AS analysis_id", "7L AS company_id", "2024 AS report_year", "question_pk")
    stored = asked.where("question_pk <= 6").selectExpr("analysis_id", "question_pk", "'Não' AS answer", "10.0D AS score")
    hits = spark.createDataFrame([], "company_id long, report_year int, query_id int, rank int, filename string, page_number int, page_range array<int>, content string")
    slots = flows.question_slots(asked, questions, stored)
    prompts = {(r.batch, r.question_text) for r in flows.prompt_slots(slots, hits).collect()}
    assert sorted(b for b, _ in prompts) == [1, 2] and all("1.1.12" in t for b, t in prompts if b == 2)
    reply = lambda ids: json.dumps([{"question_id": f"1.1.{i}", "answer": "Sim"} for i in ids])
    replies = spark.createDataFrame([(1, 1, 1, 0, reply([7, 8])), (1, 1, 1, 1, reply([9, 10, 11])), (1, 1, 2, 0, reply([12]))],
                                    "analysis_id long, theme_id int, batch long, reply int, payload string")
    rows = flows.resume_analyses(stored, slots, replies, questions, hits).collect()
    assert sorted((r.question_pk, r.answer) for r in rows) == [(i, "Não" if i <= 6 else "Sim") for i in range(1, 13)]


def test_replies_are_dealt_before_their_texts_are_made(spark):
    fx = fixtures(spark, "/root/testdata/sf0.001")
    for view, slots in (("d_reply_items", "d_slots"), ("d_open_items", "d_open_slots")):
        table = fx.stored(f"{slots}-test", lambda: fx[slots])
        items = flow_queries.reply_items(fx, view, table)
        assert items.columns == fx[view].columns and items.count() == fx[view].count()
        assert items.exceptAll(fx[view]).isEmpty()
        plan = flow_queries.reply_payloads(fx, view, table)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("Join") <= 1

import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions.answers import is_generic_source, normalize_answer, question_complexity, strip_question_id
from veritrail.operators import answers as A
from veritrail.operators import evaluation as E
from veritrail.operators import scoring as S
from veritrail.operators.companies import company_search, sector_class, sector_list
from veritrail.operators.documents import latest_documents, seed_missing
from veritrail.operators.keys import running_number
from veritrail.operators.routing import route_questions


def one(spark, build, *values):
    columns = [F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]
    return spark.range(1).select(build(*columns)).first()[0]


@pytest.mark.parametrize("given, expected", [
    ("Nao", "Não"), ("NAO", "Não"), ("não", "Não"), ("Não", "Não"), ("sim", "Sim"), ("SIM", "Sim"), ("Sim", "Sim"),
    ("N/A", "N/A"), ("NÃO", "N/A"), ("talvez", "N/A"), ("", "N/A"), (None, "N/A"),
])
def test_normalize(spark, given, expected):
    assert one(spark, normalize_answer, given) == expected


@pytest.mark.parametrize("text, expected", [
    ("A empresa possui política?", "simple"), ("Qual a EVOLUCAO do indicador?", "complex"),
    ("A empresa possui plano de ação?", "complex"), ("palavra " * 15, "simple"), ("palavra " * 16, "complex"),
    ("É signatária de pacto?", "simple"), ("São auditadas " + "x " * 30, "simple"), ("Há cenários climáticos", "complex"),
])
def test_complexity(spark, text, expected):
    assert one(spark, question_complexity, text) == expected


@pytest.mark.parametrize("source, generic", [
    (None, True), ("", True), ("  ", True), ("N/A", True), ("Relatório.pdf, p.3", False), ("ver documentos ANALISADOS", True),
    ("Plan/Ambiental.pdf", True), ("Não Aplicável", True),
])
def test_generic_source(spark, source, generic):
    assert one(spark, is_generic_source, source) is generic


@pytest.mark.parametrize("text, qid, expected", [
    ("1.1.1. A empresa", "1.1.1", "A empresa"), ("1.1.1 .. B", "1.1.1", "B"), ("C 1.1.1", "1.1.1", "C 1.1.1"), ("1.1", "1.1", ""),
])
def test_strip_id(spark, text, qid, expected):
    assert one(spark, strip_question_id, text, qid) == expected


def brute_match(questions, answers):
    """Equal id first (last value, first place), else the earliest that contains or is contained."""
    replies: dict = {}
    for _, qid, row in sorted(answers):
        key = qid.strip().lower()
        if key:
            replies[key] = row
    out = []
    for qid in questions:
        key = qid.strip().lower()
        loose = next((r for k, r in replies.items() if key in k or k in key), None) if key else None
        out.append(replies.get(key, loose))
    return out


def test_match_answers_against_brute_force(spark):
    generator = random.Random(5)
    ids = ["1.1", "1.1.1", "11.1.2", "2.3", "2.3.4", "Q2.3", " 1.1 ", "x", "", "1", "Pergunta 2.3.4:", "3.1.1.1", "3.1.1"]
    questions, answers, expected = [], [], {}
    for batch in range(60):
        asked = generator.sample([i for i in ids if i.strip()], 5)
        replies = [(n, generator.choice(ids), f"{batch}-{n}") for n in range(generator.randint(0, 6))]
        questions += [(batch, p, q) for p, q in enumerate(asked)]
        answers += [(batch, *r) for r in replies]
        expected[batch] = brute_match(asked, replies)
    q = spark.createDataFrame(questions, "batch int, position int, question_id string")
    a = spark.createDataFrame(answers, "batch int, ordinal int, question_id string, answer_row string")
    got = {(r.batch, r.position): r.answer_row for r in A.match_answers(q, a, ["batch"]).collect()}
    assert got == {(b, p): row for b, rows in expected.items() for p, row in enumerate(rows)}


def test_match_answers_hot_batch(spark):
    q = spark.range(2000).selectExpr("1 AS batch", "concat('9.', id) AS question_id")
    a = spark.range(4000).selectExpr("1 AS batch", "CAST(id AS INT) AS ordinal", "concat('id ', 3999 - id) AS question_id", "CAST(id AS STRING) AS answer_row")
    assert A.match_answers(q, a, ["batch"]).where("match = 'contained'").count() == 0
    b = a.withColumn("question_id", F.concat(F.lit("9."), F.substring("question_id", 4, 9), F.lit("!")))
    assert A.match_answers(q, b, ["batch"]).where("match = 'contained'").count() == 2000


def test_match_answers_with_crowded_batches_among_others(spark):
    generator = random.Random(8)
    ids = [f"{a}.{b}{c}" for a in range(1, 13) for b in range(1, 9) for c in ("", ".1", ".12")]
    spelled = ["{}", " {} ", "Q{}", "{}.1", "ID {}", "{}!"]
    questions, answers, expected = [], [], {}
    for batch, size in enumerate([0, 1, 5, 63, 64, 65, 66, 300, 40, 70]):
        asked = generator.sample(ids, 30)
        replies = [(n, generator.choice(spelled).format(generator.choice(ids)), f"{batch}-{n}") for n in range(size)]
        questions += [(batch, p, q) for p, q in enumerate(asked)]
        answers += [(batch, *r) for r in replies]
        expected[batch] = brute_match(asked, replies)
    questions.append((None, 0, "1.1"))
    q = spark.createDataFrame(questions, "batch int, position int, question_id string")
    a = spark.createDataFrame(answers + [(None, 1, "1.1", "nowhere")], "batch long, ordinal int, question_id string, answer_row string")
    rows = A.match_answers(q, a, ["batch"]).collect()
    assert {(r.batch, r.position): r.answer_row for r in rows} == {
        (b, p): row for b, found in expected.items() for p, row in enumerate(found)} | {(None, 0): None}
    assert len(rows) == len(questions) and {r.match for r in rows} == {"exact", "contained", "none"}
    assert all((r.match == "none") == (r.answer_row is None) for r in rows)


def test_match_answers_shuffles_both_sides_once(spark):
    q = spark.range(40).selectExpr("id % 9 AS batch", "concat('9.', id) AS question_id")
    a = spark.range(80).selectExpr("id % 9 AS batch", "id AS ordinal", "concat('id 9.', id) AS question_id", "CAST(id AS STRING) AS answer_row")
    plan = A.match_answers(q, a, ["batch"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_parts_that_no_id_of_the_batch_can_equal_are_left_out(spark):
    wanted = spark.createDataFrame([(1, "2.3.4"), (1, "x")], "batch int, _key string")
    sizes = wanted.groupBy("batch").agg(F.collect_set(F.length("_key")).alias("n"), A.marks(F.col("_key")).alias("m"))
    reply = F.lit("pergunta 2.3.4: abcdefghij x").alias("reply")
    parts, every = sizes.select(A._cuts(reply, F.col("n"), F.col("m")), A._cuts(reply, F.col("n"), F.lit(-1).cast("long"))).first()
    assert {"2.3.4", "x"} <= set(parts) <= set(every) and len(parts) < len(every) / 4


def test_fill_and_remaining(spark):
    asked = spark.createDataFrame([(1, 1), (1, 2)], "analysis_id long, question_pk long")
    got = spark.createDataFrame(
        [(1, 1, "Sim", "j", "s", None, 0.5)],
        "analysis_id long, question_pk long, answer string, justification string, source_reference string, improvement_points string, confidence_score double",
    )
    rows = {r.question_pk: r for r in A.fill_answers(asked, got).collect()}
    assert (rows[1].answer, rows[1].confidence_score) == ("Sim", 0.5)
    assert (rows[2].answer, rows[2].confidence_score, rows[2].source_reference) == ("N/A", 0.0, None)
    assert rows[2].justification.startswith("Não foi possível")
    assert [r.question_pk for r in A.remaining_questions(asked, got).collect()] == [2]


def test_records_cut_and_clamp(spark):
    answers = spark.createDataFrame(
        [(1, 1, "sim", "j" * 900, "s" * 300, "", 1.7), (1, 2, "Nao", None, "", "i" * 400, -0.2)],
        "analysis_id long, question_pk long, answer string, justification string, source_reference string, improvement_points string, confidence_score double",
    )
    questions = spark.createDataFrame([(1, None, "social"), (2, "Não", "other")], "question_pk long, expected_answer string, dimension string")
    first, second = A.answer_records(answers, questions).orderBy("question_pk").collect()
    assert (len(first.justification), len(first.source_reference), first.improvement_points, first.confidence_score) == (800, 200, None, 1.0)
    assert (first.agent_name, first.score, second.agent_name, second.score) == ("Agente Social", 10.0, "Agente ESG", 10.0)
    assert (second.justification, second.source_reference, len(second.improvement_points), second.confidence_score) == ("", None, 300, 0.0)


def test_conditional_only_for_four_levels(spark):
    rows = [(1, "1.1.1", "Não"), (1, "1.1.1.1", "Sim"), (1, "1.1.1.2", "Não"), (1, "1.1", "Não"), (1, "1.1.2", "Sim"), (2, "1.1.1.1", "Sim")]
    answers = spark.createDataFrame(rows, "analysis_id long, question_id string, answer string")
    got = {(r.analysis_id, r.question_id): r.answer for r in A.apply_conditional(answers).collect()}
    assert got[1, "1.1.1.1"] == got[1, "1.1.1.2"] == "N/A"
    assert got[1, "1.1.2"] == got[2, "1.1.1.1"] == "Sim" and got[1, "1.1.1"] == "Não"


def scored(spark, answers, questions, weights=()):
    key = "analysis_id long, company_id long, report_year int"
    a = spark.createDataFrame([(1, 1, 2024, *x) for x in answers], key + ", question_pk long, answer string")
    q = spark.createDataFrame(questions, "question_pk long, theme_id int, expected_answer string")
    themes = spark.createDataFrame([(1, "environmental"), (2, "social"), (3, "governance"), (4, "environmental")], "theme_id int, dimension string")
    companies = spark.createDataFrame([(1, "S")], "company_id long, sector string")
    w = spark.createDataFrame(list(weights), "sector string, theme_id int, weight double")
    scores = S.theme_scores(a, q)
    return scores, S.overall_scores(S.weight_themes(scores, companies, themes, w))


def test_scores_by_hand(spark):
    questions = [(i, 1 if i < 4 else 4 if i < 6 else 2, None if i == 1 else "Sim") for i in range(1, 8)]
    answers = [(1, "Sim"), (2, "Não"), (3, "N/A"), (4, "Sim"), (5, "Sim"), (6, "N/A"), (99, "Sim")]
    scores, overall = scored(spark, answers, questions, [("S", 1, 3.0), ("S", 4, 0.5)])
    got = {r.theme_id: (r.raw_score, r.rating) for r in scores.collect()}
    assert got == {1: (5.0, "C"), 4: (10.0, "A"), 2: (0.0, "E")}
    row = overall.first()
    assert row.environmental_score == round((5 * 3 + 10 * 0.5) / 3.5, 2)
    assert (row.social_score, row.governance_score) == (0.0, 0.0)
    assert row.overall_score == round((20 / 3.5) * 0.35, 2) and row.overall_rating == "D"


def test_zero_weights_score_zero(spark):
    _, overall = scored(spark, [(1, "Sim")], [(1, 1, "Sim")], [("S", 1, 0.0)])
    assert overall.first().environmental_score == 0.0


def test_theme_score_rounds_like_the_exact_value(spark):
    questions = [(i, 1, "Sim") for i in range(16)]
    scores, _ = scored(spark, [(i, "Sim" if i < 1 else "Não") for i in range(16)], questions)
    assert scores.first().raw_score == round(10.0 / 16, 2) == 0.62


def test_accuracy_by_hand(spark):
    answers = spark.createDataFrame([(1, 1, 2024, q, a) for q, a in [(1, "Sim"), (2, "Sim"), (3, "N/A"), (4, "Não"), (9, "Sim")]],
                                    "analysis_id long, company_id long, report_year int, question_pk long, answer string")
    reference = spark.createDataFrame([(1, "Sim"), (2, "Não"), (3, "Sim"), (4, "N/A"), (5, "Sim")], "question_pk long, answer string")
    row = E.accuracy(answers, reference).first()
    assert (row.matches, row.mismatches, row.skipped, row.not_found, row.accuracy) == (1, 2, 1, 1, 33.3)


def test_reference_headers_and_unknown_sheets(spark):
    rows = [("Ecodesign", "1.1", "Sim"), ("Ecodesign", "0.1", "Sim"), ("Ecodesign", "1.1.1", " Não "), ("Ecodesign", "1.1.2", "Parcial"),
            ("Resultado", "1.1.1", "Sim"), ("Outra", "1.1.1", "Sim"), ("Ecodesign", None, "Sim"), ("Ecodesign", "7.7.7", "N/A"), ("Ecodesign", "1.1.3", None)]
    workbook = spark.createDataFrame([(*r, "p.1") for r in rows], "sheet string, question_id string, answer string, source string")
    themes = spark.createDataFrame([(5, "Ecodesign")], "theme_id int, name string")
    questions = spark.createDataFrame([(50, 5, "1.1.1"), (51, 6, "7.7.7"), (52, 5, "0.1")], "question_pk long, theme_id int, question_id string")
    got = {r.question_id: (r.question_pk, r.answer, r.matched) for r in E.match_reference(workbook, themes, questions).collect()}
    assert got == {"0.1": (52, "Sim", True), "1.1.1": (50, "Não", True), "7.7.7": (None, "N/A", False)}


@pytest.mark.parametrize("sector, expected", [
    ("Energia", "Energia"), ("ENERGIA ELETRICA", "Utilities"), ("bancos", "Serviços financeiros"), ("Varejo Online", "Consumo cíclico"),
    ("", "Materiais"), (None, "Materiais"), ("  ", "Materiais"), ("Outro", "Materiais"), ("saude", "Saúde"), ("Industria", "Industrial"),
])
def test_sector_class(spark, sector, expected):
    assert one(spark, sector_class, sector) == expected


def test_company_lookups(spark):
    companies = spark.createDataFrame([(1, "Alfa", None, "Varejo"), (2, "Beta", "ALF3", None), (3, "Gama", "GAM3", "")],
                                      "company_id long, name string, ticker string, sector string")
    assert sorted(r.company_id for r in company_search(companies, "ALF").collect()) == [1, 2]
    assert [r.sector for r in sector_list(companies, ["Saúde", "Varejo"]).collect()] == ["Saúde", "Varejo"]


def test_replacement_and_seeding(spark):
    documents = spark.createDataFrame([(1, 1, "a.pdf"), (2, 1, "a.pdf"), (3, 2, "a.pdf")], "doc_id long, company_id long, filename string")
    assert sorted(r.doc_id for r in latest_documents(documents).collect()) == [2, 3]
    stored = spark.createDataFrame([("1.1", "old")], "question_id string, origin string")
    seeds = spark.createDataFrame([("1.1", "new"), ("1.2", "new")], "question_id string, origin string")
    once = seed_missing(stored, seeds, ["question_id"])
    assert {(r.question_id, r.origin) for r in once.collect()} == {("1.1", "old"), ("1.2", "new")}
    assert seed_missing(once, seeds, ["question_id"]).count() == 2


def test_routing(spark):
    questions = spark.createDataFrame([("A empresa possui x?",), ("Descreva",)], "question_text string")
    assert [r.model for r in route_questions(questions, "d", "s", "c").collect()] == ["s", "c"]
    assert [r.model for r in route_questions(questions, "d", "s").collect()] == ["d", "d"]


def test_running_number_in_a_hot_group(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 END AS g", "id")
    got = running_number(rows, ["g"], [F.floor(F.col("id") / 100)], [F.col("id")], "n").collect()
    by_group: dict = {}
    for r in sorted(got, key=lambda r: r.id):
        by_group[r.g] = by_group.get(r.g, 0) + 1
        assert r.n == by_group[r.g]
    assert len(got) == 5000

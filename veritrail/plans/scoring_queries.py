"""Answer reconciliation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.answers import (
    answer_score,
    question_complexity,
    strip_question_id,
)
from veritrail.operators import answers as A
from veritrail.operators import scoring as S
from veritrail.operators.routing import route_questions
from veritrail.plans.checks import EARLIEST, LATEST, NORMAL, RAW_ORDER, sql_rating
from veritrail.plans.fixtures import VIEWS
from veritrail.plans.registry import query

ID = ["analysis_id", "question_pk"]


def clean_answers(fx):
    """Raw answers -> one normalised answer per question, the latest one."""
    return A.normalize(A.keep_last(fx["d_answers_raw"], RAW_ORDER))


def theme_scores(fx):
    return S.theme_scores(clean_answers(fx), fx["d_questions"])


def weighted_scores(fx):
    return S.weight_themes(theme_scores(fx), fx["d_companies"], fx["d_themes"], fx["d_materiality"])


@query("overall_scores", "SELECT * FROM {o_overall}")
def overall_scores(fx):
    return S.overall_scores(weighted_scores(fx))


# The stored tables that reports, exports and evaluations read.
def stored_answers(fx):
    kept = ["analysis_id", "company_id", "report_year", "question_pk", "created_at", "confidence_score", "answer"]
    return fx.stored("answers", lambda: clean_answers(fx).select(*kept))


def stored_theme_scores(fx):
    return fx.stored("theme_scores", lambda: S.theme_scores(stored_answers(fx), fx["d_questions"]))


def stored_scores(fx):
    weighted = lambda: S.weight_themes(
        stored_theme_scores(fx), fx["d_companies"], fx["d_themes"], fx["d_materiality"]
    )
    return fx.stored("scores", lambda: S.overall_scores(weighted()))


@query("theme_scores", f"""
SELECT analysis_id, company_id, report_year, theme_id, scored, matches, raw_score, {sql_rating('raw_score')} AS rating
FROM {{o_theme_scores}}""")
def _(fx):
    return theme_scores(fx)


@query("weighted_theme_scores", """
SELECT analysis_id, theme_id, sector, dimension, raw_score, weight, weighted_score FROM {o_weighted}""")
def _(fx):
    return weighted_scores(fx).select(
        "analysis_id", "theme_id", "sector", "dimension", "raw_score", "weight", "weighted_score"
    )


@query("dimension_scores", """
SELECT analysis_id, company_id, report_year, dimension, count(*) AS themes,
       round(CASE WHEN sum(weight) > 0 THEN sum(raw_score::DECIMAL(4,2) * weight::DECIMAL(12,6))::DOUBLE
             / sum(weight::DECIMAL(12,6))::DOUBLE ELSE 0 END, 6) AS score
FROM {o_weighted} GROUP BY ALL""")
def _(fx):
    return S.dimension_scores(weighted_scores(fx)).withColumn("score", F.round("score", 6))


@query("normalize_answers", f"""
SELECT answer AS given, {NORMAL} AS answer, count(*) AS n FROM {{d_answers_raw}} GROUP BY 1, 2""")
def _(fx):
    raw = fx["d_answers_raw"].withColumn("given", F.col("answer"))
    return A.normalize(raw).groupBy("given", "answer").agg(F.count("*").alias("n"))


_STORED = "analysis_id, question_pk, created_at, answer, round(confidence_score, 6) AS confidence_score"


@query("dedup_answers_first", f"""
SELECT {_STORED} FROM {{d_answers_raw}}
QUALIFY row_number() OVER (PARTITION BY analysis_id, question_pk ORDER BY {EARLIEST}) = 1""")
def _(fx):
    kept = A.keep_first(fx["d_answers_raw"], RAW_ORDER)
    return kept.select(*ID, "created_at", "answer", F.round("confidence_score", 6).alias("confidence_score"))


@query("dedup_answers_last", f"""
SELECT {_STORED} FROM {{d_answers_raw}}
QUALIFY row_number() OVER (PARTITION BY analysis_id, question_pk ORDER BY {LATEST}) = 1""")
def _(fx):
    kept = A.keep_last(fx["d_answers_raw"], RAW_ORDER)
    return kept.select(*ID, "created_at", "answer", F.round("confidence_score", 6).alias("confidence_score"))


@query("answer_scores", """
SELECT analysis_id, question_pk, answer, expected_answer,
       CASE WHEN answer <> 'N/A' AND answer = expected_answer THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM {o_answers} JOIN {d_questions} USING (question_pk)""")
def _(fx):
    joined = clean_answers(fx).join(fx["d_questions"].select("question_pk", "expected_answer"), "question_pk")
    return joined.select(
        *ID, "answer", "expected_answer", answer_score(F.col("answer"), F.col("expected_answer")).alias("score")
    )


@query("answer_records", f"""
SELECT analysis_id, question_pk, {NORMAL} AS answer, left(coalesce(justification, ''), 800) AS justification,
       nullif(left(source_reference, 200), '') AS source_reference,
       nullif(left(improvement_points, 300), '') AS improvement_points,
       round(least(greatest(coalesce(confidence_score, 0), 0), 1), 6) AS confidence_score,
       CASE dimension WHEN 'environmental' THEN 'Agente Ambiental' WHEN 'social' THEN 'Agente Social'
            WHEN 'governance' THEN 'Agente Governança' ELSE 'Agente ESG' END AS agent_name,
       CASE WHEN {NORMAL} <> 'N/A' AND {NORMAL} = expected_answer THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
       CASE WHEN {NORMAL} <> 'N/A' AND {NORMAL} = expected_answer THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS weighted_score
FROM {{d_answer_details}} JOIN {{d_questions}} USING (question_pk) JOIN {{d_themes}} USING (theme_id)""")
def _(fx):
    questions = fx["d_questions"].join(fx["d_themes"].select("theme_id", "dimension"), "theme_id")
    records = A.answer_records(fx["d_answer_details"], questions)
    return records.withColumn("confidence_score", F.round("confidence_score", 6))


@query("remaining_questions", """
SELECT analysis_id, company_id, report_year, question_pk FROM {d_asked}
WHERE NOT EXISTS (SELECT 1 FROM {d_answers_raw} a WHERE a.analysis_id = d_asked.analysis_id
                  AND a.question_pk = d_asked.question_pk AND a.answer <> 'talvez')""")
def _(fx):
    usable = fx["d_answers_raw"].where(F.col("answer") != "talvez")
    return A.remaining_questions(fx["d_asked"], usable).select("analysis_id", "company_id", "report_year", "question_pk")


_DETAIL_LAST = f"""
SELECT * FROM {{d_answer_details}} WHERE answer <> 'talvez'
QUALIFY row_number() OVER (PARTITION BY analysis_id, question_pk ORDER BY {LATEST}) = 1"""


def usable_details(fx):
    """The latest usable answers; their texts are made of the rows that stay, so none is sorted or shuffled to be dropped."""
    usable = fx["d_answers_raw"].where(F.col("answer") != "talvez")
    return fx.spark.sql(VIEWS["d_answer_details"], d_answers_raw=A.keep_last(usable, RAW_ORDER))


@query("fill_answers", f"""
WITH details AS ({_DETAIL_LAST})
SELECT q.analysis_id, q.question_pk, coalesce(d.answer, 'N/A') AS answer,
       CASE WHEN d.answer IS NULL THEN 'Não foi possível processar esta pergunta.' ELSE d.justification END AS justification,
       d.source_reference, d.improvement_points, round(coalesce(d.confidence_score, 0), 6) AS confidence_score
FROM {{d_asked}} q LEFT JOIN details d USING (analysis_id, question_pk)""")
def _(fx):
    answers = usable_details(fx).select(
        *ID, "answer", "justification", "source_reference", "improvement_points", "confidence_score"
    )
    filled = A.fill_answers(fx["d_asked"].select(*ID), answers)
    return filled.withColumn("confidence_score", F.round("confidence_score", 6))


# A reply table: questions by batch of theme and year, ids spelled in many ways, some nested.
_BATCH_SQL = """
SELECT analysis_id, theme_id, question_pk,
       CASE WHEN question_pk % 5 = 0 THEN concat(question_id, '.1') ELSE question_id END AS question_id
FROM {d_asked} JOIN {d_questions} USING (question_pk)"""
_REPLY_SQL = """
SELECT analysis_id, theme_id, question_pk * 10 + CAST(l_linenumber AS BIGINT) AS ordinal,
       CASE l_linenumber % 7 WHEN 0 THEN concat('Pergunta ', question_id, ': ') WHEN 1 THEN concat(' ', question_id, ' ')
            WHEN 2 THEN substr(question_id, 1, length(question_id) - 1) WHEN 3 THEN concat(question_id, '.1')
            WHEN 4 THEN '' WHEN 5 THEN concat('Q', question_id) ELSE question_id END AS question_id,
       concat(answer, '|', CAST(l_orderkey AS STRING), '|', CAST(created_at AS STRING)) AS answer_row
FROM {d_answers_raw} JOIN {d_questions} USING (question_pk)"""


@query("match_answers", f"""
WITH questions AS ({_BATCH_SQL}), replies AS ({_REPLY_SQL}),
keyed AS (SELECT analysis_id, theme_id, lower(trim(question_id)) AS k, min(ordinal) AS place,
                 arg_max(answer_row, struct_pack(ordinal, answer_row)) AS answer_row
          FROM replies WHERE trim(question_id) <> '' GROUP BY 1, 2, 3),
exact AS (SELECT q.*, lower(trim(q.question_id)) AS k, e.answer_row AS found FROM questions q
          LEFT JOIN keyed e ON e.analysis_id = q.analysis_id AND e.theme_id = q.theme_id AND e.k = lower(trim(q.question_id))),
loose AS (SELECT x.analysis_id, x.theme_id, x.k, arg_min(r.answer_row, struct_pack(r.place, r.answer_row)) AS answer_row
          FROM (SELECT DISTINCT analysis_id, theme_id, k FROM exact WHERE found IS NULL) x
          JOIN keyed r ON r.analysis_id = x.analysis_id AND r.theme_id = x.theme_id
                       AND (contains(r.k, x.k) OR contains(x.k, r.k)) GROUP BY 1, 2, 3)
SELECT e.analysis_id, e.theme_id, e.question_pk, e.question_id,
       CASE WHEN e.found IS NOT NULL THEN 'exact' WHEN l.answer_row IS NOT NULL THEN 'contained' ELSE 'none' END AS match,
       coalesce(e.found, l.answer_row) AS answer_row
FROM exact e LEFT JOIN loose l ON l.analysis_id = e.analysis_id AND l.theme_id = e.theme_id AND l.k = e.k AND e.found IS NULL""")
def _(fx):
    questions = fx["d_asked"].join(fx["d_questions"].select("question_pk", "theme_id", "question_id"), "question_pk")
    asked_id = F.when(F.col("question_pk") % 5 == 0, F.concat("question_id", F.lit(".1"))).otherwise(F.col("question_id"))
    asked = questions.select("analysis_id", "theme_id", "question_pk", asked_id.alias("question_id"))
    raw = fx["d_answers_raw"].join(fx["d_questions"].select("question_pk", "theme_id", "question_id"), "question_pk")
    spelled = F.expr("""CASE l_linenumber % 7 WHEN 0 THEN concat('Pergunta ', question_id, ': ')
        WHEN 1 THEN concat(' ', question_id, ' ') WHEN 2 THEN substr(question_id, 1, length(question_id) - 1)
        WHEN 3 THEN concat(question_id, '.1') WHEN 4 THEN '' WHEN 5 THEN concat('Q', question_id) ELSE question_id END""")
    replies = raw.select(
        "analysis_id", "theme_id",
        (F.col("question_pk") * 10 + F.col("l_linenumber")).alias("ordinal"),
        spelled.alias("question_id"),
        F.concat_ws("|", "answer", F.col("l_orderkey").cast("string"), F.col("created_at").cast("string")).alias("answer_row"),
    )
    return A.match_answers(asked, replies, ["analysis_id", "theme_id"])


@query("question_complexity", """
SELECT question_pk, CASE
  WHEN list_any_value(list_filter(['tendencia', 'trajetoria', 'ultimos 3 anos', 'ultimos tres anos', 'melhoria nos ultimos',
    'reducao nos ultimos', 'evolucao', 'resposta satisfatoria', 'mitigacao de danos', 'qual participacao', 'representa qual',
    'mais de 50%', 'mais de 20%', 'corresponde a mais de', 'eficacia', 'efetividade', 'avalie', 'avaliacao', 'como a empresa',
    'de que forma', 'descreva', 'controversia severa', 'controversia muito severa', 'gestao socioambiental', 'plano de acao',
    'estrategia', 'metas quantitativas', 'metas de reducao', 'integracao de fatores', 'cadeia de producao', 'risco',
    'oportunidade', 'cenarios climaticos'], lambda p: contains(strip_accents(lower(question_text)), p))) IS NOT NULL THEN 'complex'
  WHEN list_any_value(list_filter(['a empresa possui', 'a empresa publica', 'a empresa divulga', 'a empresa esta no',
    'a empresa tem', 'a empresa participa', 'a empresa e signataria', 'a empresa reporta', 'a empresa monitora',
    'a empresa realiza', 'os compromissos abrangem', 'o programa inclui', 'ceo e presidente', 'sao a mesma pessoa',
    'sao auditadas', 'e auditada', 'codigo de etica', 'canal de denuncia', 'politica ou compromisso', 'possui comite',
    'possui conselho'], lambda p: contains(strip_accents(lower(question_text)), p))) IS NOT NULL THEN 'simple'
  WHEN len(list_filter(string_split_regex(question_text, '\\s+'), lambda w: w <> '')) <= 15 THEN 'simple'
  ELSE 'complex' END AS complexity
FROM {d_question_texts}""")
def _(fx):
    return fx["d_question_texts"].select("question_pk", question_complexity(F.col("question_text")).alias("complexity"))


@query("strip_qid", """
SELECT question_pk, question_id, CASE WHEN starts_with(question_text, question_id)
  THEN ltrim(substr(question_text, length(question_id) + 1), ' .') ELSE question_text END AS question
FROM {d_question_texts}""")
def _(fx):
    return fx["d_question_texts"].select(
        "question_pk", "question_id", strip_question_id(F.col("question_text"), F.col("question_id")).alias("question")
    )


# Sub-questions X.Y.Z.W hang on their parent's answer of the same analysis.
@query("conditional_na", """
WITH tree AS (SELECT analysis_id, question_id, answer FROM {o_answers} JOIN {d_questions} USING (question_pk)
  UNION ALL SELECT analysis_id, concat(question_id, '.', CAST(question_pk % 3 + 1 AS VARCHAR)),
                   CASE WHEN question_pk % 2 = 0 THEN 'Não' ELSE 'Sim' END
            FROM {o_answers} JOIN {d_questions} USING (question_pk))
SELECT t.analysis_id, t.question_id, CASE WHEN p.question_id IS NOT NULL THEN 'N/A' ELSE t.answer END AS answer
FROM tree t LEFT JOIN (SELECT DISTINCT analysis_id, question_id FROM tree WHERE answer = 'Não') p
  ON p.analysis_id = t.analysis_id AND length(t.question_id) - length(replace(t.question_id, '.', '')) >= 3
     AND p.question_id = regexp_replace(t.question_id, '\\.\\d+$', '')""")
def _(fx):
    placed = stored_answers(fx).join(fx["d_questions"].select("question_pk", "question_id"), "question_pk")
    own = placed.select("analysis_id", "question_id", "answer")
    sub = placed.select(
        "analysis_id",
        F.concat_ws(".", "question_id", (F.col("question_pk") % 3 + 1).cast("string")).alias("question_id"),
        F.when(F.col("question_pk") % 2 == 0, F.lit(L.NO)).otherwise(F.lit(L.YES)).alias("answer"),
    )
    return A.apply_conditional(own.unionByName(sub))


@query("route_counts", """
SELECT theme_id, complexity, CASE complexity WHEN 'simple' THEN 'small-model' ELSE 'large-model' END AS model, count(*) AS questions
FROM (SELECT theme_id, CASE
  WHEN regexp_matches(strip_accents(lower(question_text)), 'evolucao|ultimos 3 anos|avaliacao|risco') THEN 'complex'
  WHEN regexp_matches(strip_accents(lower(question_text)), 'a empresa possui|politica ou compromisso|sao auditadas') THEN 'simple'
  WHEN len(list_filter(string_split_regex(question_text, '\\s+'), lambda w: w <> '')) <= 15 THEN 'simple' ELSE 'complex' END AS complexity
  FROM {d_question_texts}) GROUP BY ALL""")
def _(fx):
    routed = route_questions(fx["d_question_texts"], "default-model", "small-model", "large-model")
    return routed.groupBy("theme_id", "complexity", "model").agg(F.count("*").alias("questions"))


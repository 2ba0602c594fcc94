"""Progress, listings, exports, histories and the replay log."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import companies as K
from veritrail.operators import reports as R
from veritrail.plans.checks import LATEST, sql_round
from veritrail.plans.registry import query
from veritrail.plans.scoring_queries import stored_answers, stored_scores, stored_theme_scores, usable_details
from veritrail.plans.source_queries import text_chunks
from veritrail.streaming import replay, stalls

KNOWN_SECTORS = ["Energia", "Financeiro", "Saúde", "Varejo", "Tecnologia"]


@query("progress", f"""
SELECT analysis_id, answered, total, {sql_round('x', 1)} AS percentage
FROM (SELECT analysis_id, count(question_pk) AS answered, (SELECT count(*) FROM {{d_questions}}) AS total,
             count(question_pk)::DOUBLE / (SELECT count(*) FROM {{d_questions}}) * 100 AS x
      FROM {{d_analyses}} LEFT JOIN {{o_answers}} USING (analysis_id) GROUP BY analysis_id)""")
def _(fx):
    return R.progress(fx["d_analyses"], stored_answers(fx), fx["d_questions"])


@query("analysis_results", """
SELECT a.analysis_id, a.question_pk, a.answer, q.question_id, q.question_text, q.expected_answer, q.display_order,
       t.name AS theme_name, t.dimension, t.display_order AS theme_order, s.raw_score
FROM {o_answers} a LEFT JOIN {d_questions} q USING (question_pk) LEFT JOIN {d_themes} t USING (theme_id)
LEFT JOIN {o_theme_scores} s ON s.analysis_id = a.analysis_id AND s.theme_id = q.theme_id""")
def _(fx):
    answers = stored_answers(fx).select("analysis_id", "question_pk", "answer")
    results = R.analysis_results(answers, fx["d_questions"], fx["d_themes"], stored_theme_scores(fx))
    return results.drop("theme_id", "rating")


@query("themes_by_dimension", """
SELECT dimension, count(*) AS themes, string_agg(name, '; ' ORDER BY display_order, theme_id) AS names
FROM {d_themes} WHERE dimension IN ('environmental', 'social', 'governance') GROUP BY 1""")
def _(fx):
    return R.themes_by_dimension(fx["d_themes"])


@query("catalog_counts", """
SELECT (SELECT count(*) FROM {d_questions}) AS questions, (SELECT count(*) FROM {d_themes}) AS themes""")
def _(fx):
    return R.catalog_counts(fx["d_questions"], fx["d_themes"])


@query("question_catalog", """
SELECT q.*, t.name AS theme_name, t.dimension, t.theme_number FROM {d_questions} q LEFT JOIN {d_themes} t USING (theme_id)""")
def _(fx):
    return R.question_catalog(fx["d_questions"], fx["d_themes"])


@query("company_history", """
SELECT *, bool_or(status = 'completed') OVER (PARTITION BY company_id, report_year) AS year_completed FROM {d_analyses}""")
def _(fx):
    return R.company_history(fx["d_analyses"])


@query("document_summary", """
WITH counted AS (SELECT doc_id, count(*) AS chunk_count FROM {o_chunks} GROUP BY 1)
SELECT company_id, report_year, count(*) AS documents, count(*) FILTER (WHERE status = 'ready') AS ready,
       CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages,
       count(*) FILTER (WHERE source_type = 'url') AS urls, count(*) FILTER (WHERE source_type <> 'url') AS pdfs
FROM {d_documents} LEFT JOIN counted USING (doc_id) GROUP BY ROLLUP (company_id, report_year)""")
def _(fx):
    counts = text_chunks(fx).groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return R.document_summary(fx["d_documents"].drop("text").join(counts, "doc_id", "left"))


@query("dimension_progress", """
SELECT analysis_id, dimension, questions, coalesce(answered, 0) AS answered
FROM (SELECT analysis_id, unnest(['environmental', 'social', 'governance']) AS dimension FROM {d_analyses})
LEFT JOIN (SELECT dimension, count(*) AS questions FROM {d_questions} JOIN {d_themes} USING (theme_id) GROUP BY 1) USING (dimension)
LEFT JOIN (SELECT analysis_id, dimension, count(*) AS answered FROM {o_answers} JOIN {d_questions} USING (question_pk)
           JOIN {d_themes} USING (theme_id) GROUP BY 1, 2) USING (analysis_id, dimension)""")
def _(fx):
    return R.dimension_progress(fx["d_analyses"], stored_answers(fx), fx["d_questions"], fx["d_themes"])


@query("latest_analyses", """
WITH newest AS (SELECT * FROM {d_analyses} ORDER BY created_at DESC, analysis_id DESC LIMIT 5)
SELECT analysis_id, company_id, report_year, status, count(question_pk) AS answers
FROM newest LEFT JOIN {o_answers} USING (analysis_id, company_id, report_year) GROUP BY ALL""")
def _(fx):
    latest = R.latest_analyses(fx["d_analyses"], stored_answers(fx))
    return latest.select("analysis_id", "company_id", "report_year", "status", "answers")


@query("document_listing", """
SELECT doc_id, filename, source_type, status, page_count, c.name AS company_name
FROM (SELECT * FROM {d_documents} ORDER BY doc_id DESC LIMIT 10) LEFT JOIN {d_companies} c USING (company_id)""")
def _(fx):
    listing = R.document_listing(fx["d_documents"], fx["d_companies"])
    return listing.select("doc_id", "filename", "source_type", "status", "page_count", "company_name")


@query("latest_completed", """
SELECT analysis_id, company_id, report_year, completed_at FROM {d_analyses} WHERE status = 'completed'
ORDER BY completed_at DESC, analysis_id DESC LIMIT 1""")
def _(fx):
    return R.latest_completed(fx["d_analyses"]).select("analysis_id", "company_id", "report_year", "completed_at")


@query("export_detail", f"""
WITH kept AS (SELECT * FROM {{d_answer_details}} WHERE answer <> 'talvez'
  QUALIFY row_number() OVER (PARTITION BY analysis_id, question_pk ORDER BY {LATEST}) = 1)
SELECT s.analysis_id, s.question_pk, t.dimension, t.display_order AS theme_order, q.display_order, q.question_id,
       CASE WHEN starts_with(q.question_text, q.question_id)
            THEN ltrim(substr(q.question_text, length(q.question_id) + 1), ' .') ELSE q.question_text END AS question,
       coalesce(k.answer, '—') AS answer, {sql_round('k.confidence_score', 2)} AS confidence,
       k.justification, k.source_reference, k.improvement_points
FROM {{d_asked}} s JOIN {{d_question_texts}} q USING (question_pk) JOIN {{d_themes}} t USING (theme_id)
LEFT JOIN kept k ON k.analysis_id = s.analysis_id AND k.question_pk = s.question_pk""")
def _(fx):
    answers = usable_details(fx).select(
        "analysis_id", "question_pk", "answer", "confidence_score", "justification", "source_reference", "improvement_points"
    )
    return R.export_detail(fx["d_asked"], fx["d_question_texts"], fx["d_themes"], answers)


@query("export_summary", f"""
SELECT a.analysis_id, t.display_order, concat(CAST(t.theme_number AS VARCHAR), '. ', t.name) AS theme,
       CASE t.dimension WHEN 'environmental' THEN 'Ambiental' WHEN 'social' THEN 'Social' ELSE 'Governança' END AS dimension,
       (SELECT count(*) FROM {{d_questions}} q WHERE q.theme_id = t.theme_id) AS questions,
       coalesce(s.raw_score, 0)::DOUBLE AS score,
       CASE WHEN s.raw_score IS NULL THEN '-' WHEN s.raw_score >= 8 THEN 'A' WHEN s.raw_score >= 6 THEN 'B'
            WHEN s.raw_score >= 4 THEN 'C' WHEN s.raw_score >= 2 THEN 'D' ELSE 'E' END AS rating
FROM {{d_analyses}} a CROSS JOIN {{d_themes}} t
LEFT JOIN {{o_theme_scores}} s ON s.analysis_id = a.analysis_id AND s.theme_id = t.theme_id""")
def _(fx):
    return R.export_summary(fx["d_analyses"], fx["d_themes"], fx["d_questions"], stored_theme_scores(fx))


@query("sector_class", """
SELECT company_id, sector, CASE sector WHEN 'Energia' THEN 'Energia' WHEN 'bancos' THEN 'Serviços financeiros'
  WHEN 'Varejo Online' THEN 'Consumo cíclico' WHEN 'Saneamento' THEN 'Utilities' ELSE 'Materiais' END AS industry_class
FROM {d_companies}""")
def _(fx):
    return fx["d_companies"].select("company_id", "sector", K.sector_class(F.col("sector")).alias("industry_class"))


@query("company_search", """
SELECT company_id, name, ticker, sector FROM {d_companies}
WHERE contains(lower(name), 'varejo') OR contains(lower(ticker), 'varejo') OR contains(lower(sector), 'varejo')""")
def _(fx):
    return K.company_search(fx["d_companies"], "VAREJO")


@query("company_autocomplete", """
SELECT company_id, name, ticker, sector FROM {d_companies}
WHERE contains(lower(name), 'ck1') OR contains(lower(ticker), 'ck1') OR contains(lower(sector), 'ck1')
ORDER BY company_id LIMIT 15""")
def _(fx):
    return K.company_search(fx["d_companies"], "ck1", 15)


@query("sector_list", """
SELECT unnest(['Energia', 'Financeiro', 'Saúde', 'Varejo', 'Tecnologia']) AS sector
UNION SELECT sector FROM {d_companies}""")
def _(fx):
    return K.sector_list(fx["d_companies"], KNOWN_SECTORS)


@query("distinct_companies", """
SELECT company_id, name, ticker, sector FROM {d_companies}
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY company_id) = 1""")
def _(fx):
    return K.distinct_companies(fx["d_companies"])


@query("stalled_analyses", """
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
    return stalls.stalled_analyses(
        fx["d_progress"], "2024-01-31 00:00:00", idle_seconds=43200, startup_seconds=86400, heartbeat_seconds=36000
    ).select("analysis_id", "partial_answers", "reason")


_REPLAY = """
WITH placed AS (SELECT a.analysis_id, a.answer, a.confidence_score, q.question_pk, q.question_id, q.display_order, q.theme_id,
    left(CASE WHEN starts_with(q.question_text, q.question_id) THEN ltrim(substr(q.question_text, length(q.question_id) + 1), ' .')
         ELSE q.question_text END, 120) AS text, t.display_order AS theme_order, t.dimension, t.name
  FROM {o_answers} a JOIN {d_question_texts} q USING (question_pk) JOIN {d_themes} t USING (theme_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY theme_order, theme_id, display_order, question_pk) AS answered FROM placed),
themes AS (SELECT analysis_id, theme_id, theme_order, dimension, name, max(answered) AS answered FROM numbered GROUP BY ALL),
turns AS (SELECT *, lag(dimension) OVER (PARTITION BY analysis_id ORDER BY theme_order, theme_id) AS before FROM themes),
events AS (
  SELECT analysis_id, 0 AS phase, -1 AS theme_order, -1 AS theme_id, 0 AS kind, -1::BIGINT AS display_order, 'analysis_start' AS event,
         NULL AS subject, NULL AS answer, 0::BIGINT AS answered_count, NULL::DOUBLE AS score, NULL AS rating FROM {o_overall}
  UNION ALL SELECT analysis_id, 1, theme_order, theme_id, 1, -1, 'dimension_start', dimension, NULL, 0, NULL, NULL
    FROM turns WHERE before IS NULL OR before <> dimension
  UNION ALL SELECT analysis_id, 1, theme_order, theme_id, 2, -1, 'theme_start', name, NULL, 0, NULL, NULL FROM themes
  UNION ALL SELECT analysis_id, 1, theme_order, theme_id, 3, answered, 'question_answered', text, answer, answered, NULL, NULL FROM numbered
  UNION ALL SELECT analysis_id, 1, theme_order, theme_id, 4, -1, 'theme_complete', name, NULL, answered, s.raw_score,
    CASE WHEN s.raw_score >= 8 THEN 'A' WHEN s.raw_score >= 6 THEN 'B' WHEN s.raw_score >= 4 THEN 'C' WHEN s.raw_score >= 2 THEN 'D' ELSE 'E' END
    FROM themes JOIN {o_theme_scores} s USING (analysis_id, theme_id)
  UNION ALL SELECT o.analysis_id, 2, -1, -1, 5, -1, 'analysis_complete', NULL, NULL, n, overall_score, overall_rating
    FROM {o_overall} o JOIN (SELECT analysis_id, count(*) AS n FROM numbered GROUP BY 1) USING (analysis_id))
SELECT analysis_id, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY phase, theme_order, theme_id, kind, display_order) AS INT) AS seq,
       event, subject, answer, answered_count, score, rating FROM events"""


@query("replay_log", _REPLAY)
def _(fx):
    log = replay.replay_log(
        stored_answers(fx), fx["d_question_texts"], fx["d_themes"], stored_theme_scores(fx), stored_scores(fx)
    )
    return log.select("analysis_id", "seq", "event", "subject", "answer", "answered_count", "score", "rating")

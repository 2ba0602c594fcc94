"""Comparison with the analyst's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.operators import evaluation as E
from veritrail.plans.checks import sql_round
from veritrail.plans.registry import query
from veritrail.plans.scoring_queries import stored_answers, stored_scores

_MATCH = """
WITH refs AS (SELECT q.question_pk, w.question_id, w.sheet AS theme_name, trim(w.answer) AS answer, w.source,
                     q.question_pk IS NOT NULL AS matched
  FROM {d_workbook_answers} w JOIN {d_themes} t ON t.name = w.sheet
  LEFT JOIN {d_questions} q ON q.theme_id = t.theme_id AND q.question_id = w.question_id
  WHERE w.sheet NOT IN ('Controvérsias', 'Materialidade', 'Resultado') AND trim(w.answer) IN ('Sim', 'Não', 'N/A')
    AND (length(w.question_id) - length(replace(w.question_id, '.', '')) >= 2 OR starts_with(w.question_id, '0.')))
"""


def reference(fx):
    return E.match_reference(fx["d_workbook_answers"], fx["d_themes"], fx["d_questions"])


@query("match_reference", _MATCH + "SELECT * FROM refs")
def _(fx):
    return reference(fx)


@query("answer_distribution", _MATCH + """
SELECT v.answer, count(r.answer) AS n FROM (SELECT unnest(['Sim', 'Não', 'N/A']) AS answer) v
LEFT JOIN refs r ON r.answer = v.answer AND r.matched GROUP BY 1""")
def _(fx):
    return E.answer_distribution(reference(fx).where("matched"))


@query("expected_answers", _MATCH + """
SELECT question_pk, theme_id, question_id, CASE WHEN question_pk IN (SELECT question_pk FROM refs WHERE matched AND answer = 'Não')
       THEN 'Não' ELSE expected_answer END AS expected_answer FROM {d_questions}""")
def _(fx):
    updated = E.expected_answers(fx["d_questions"], reference(fx).where("matched"))
    return updated.select("question_pk", "theme_id", "question_id", "expected_answer")


@query("accuracy", f"""
WITH judged AS (SELECT analysis_id, company_id, report_year, count(*) FILTER (WHERE a.answer = r.answer) AS matches,
         count(*) FILTER (WHERE a.answer <> r.answer) AS mismatches
  FROM {{o_answers}} a LEFT JOIN (SELECT * FROM {{d_reference}} WHERE answer <> 'N/A') r USING (question_pk) GROUP BY 1, 2, 3),
shares AS (SELECT *, CASE WHEN matches + mismatches > 0 THEN matches::DOUBLE / (matches + mismatches) * 100 ELSE 0 END AS x FROM judged)
SELECT analysis_id, company_id, report_year, matches, mismatches,
       (SELECT count(*) FROM {{d_reference}} WHERE answer = 'N/A') AS skipped,
       (SELECT count(*) FROM {{d_reference}} WHERE answer <> 'N/A') - matches - mismatches AS not_found,
       {sql_round('x', 1)} AS accuracy
FROM shares""")
def _(fx):
    return E.accuracy(stored_answers(fx), fx["d_reference"])


@query("mismatches", """
SELECT question_pk, r.question_id, r.theme_id, a.analysis_id, r.answer AS expected, a.answer AS got,
       round(a.confidence_score, 6) AS confidence_score
FROM {o_answers} a JOIN {d_reference} r USING (question_pk) WHERE r.answer <> 'N/A' AND a.answer <> r.answer
QUALIFY row_number() OVER (PARTITION BY a.analysis_id ORDER BY question_pk) <= 20""")
def _(fx):
    found = E.mismatches(stored_answers(fx), fx["d_reference"])
    return found.withColumn("confidence_score", F.round("confidence_score", 6))


def analyst_scores(fx):
    """A second set of scores per analysis, on a coarser scale."""
    names = [f"{d}_score" for d in L.DIMENSIONS] + ["overall_score"]
    return stored_scores(fx).select(
        "analysis_id", "company_id", "report_year", *[(F.floor(F.col(n)) + 0.53).alias(n) for n in names]
    )


_DELTAS = ", ".join(
    f"{sql_round(f'abs({n}_score - (floor({n}_score) + 0.53::DOUBLE))', 2)} AS {n}_delta"
    for n in [*L.DIMENSIONS, "overall"]
)


@query("score_delta", f"SELECT analysis_id, company_id, report_year, {_DELTAS} FROM {{o_overall}}")
def _(fx):
    return E.score_delta(stored_scores(fx), analyst_scores(fx))

"""Whole flows over the fixture: taking in replies, and asking what is still open."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.plans import flows
from veritrail.plans.fixtures import VIEWS
from veritrail.plans.registry import query
from veritrail.plans.retrieval_queries import _CONTEXT, _SOURCE, SCOPE, hybrid_texts
from veritrail.sources import payloads

BATCH = ["analysis_id", "theme_id", "batch"]

VIEWS["d_batches"] = """
SELECT question_pk, theme_id, question_id, CAST(floor((position - 1) / 5) AS BIGINT) + 1 AS batch
FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY display_order, question_pk) AS position FROM {d_questions}) p"""

# Two replies for a batch: the first leaves questions out, the second has those and some again. Ids are spelled loosely.
VIEWS["d_reply_items"] = """
SELECT a.analysis_id, b.theme_id, b.batch, a.reply, a.question_pk,
       CASE (a.question_pk + a.reply) % 5 WHEN 1 THEN concat('  ', b.question_id) WHEN 2 THEN concat('ID ', b.question_id)
            WHEN 3 THEN concat(b.question_id, '.9') ELSE b.question_id END AS question_id,
       CASE (a.analysis_id + a.question_pk + a.reply) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'sim' WHEN 2 THEN 'Nao' WHEN 3 THEN 'N/A'
            ELSE 'Sim' END AS answer,
       concat('Motivo ', CAST(a.question_pk AS STRING), ' da resposta ', CAST(a.reply AS STRING)) AS justification,
       CASE WHEN a.question_pk % 2 = 0 THEN 'n/a' ELSE concat('Relatorio ', CAST(a.question_pk AS STRING), '.pdf') END AS source_reference
FROM (SELECT analysis_id, question_pk, 0 AS reply FROM {d_asked} WHERE (question_pk + analysis_id) % 3 <> 0
      UNION ALL SELECT analysis_id, question_pk, 1 FROM {d_asked} WHERE (question_pk + analysis_id) % 3 <> 1) a
JOIN {d_batches} b ON b.question_pk = a.question_pk
WHERE (a.question_pk + a.analysis_id) % 11 <> 0"""
VIEWS["d_slots"] = """
SELECT a.analysis_id, a.company_id, a.report_year, a.question_pk, b.question_id, b.theme_id, b.batch
FROM {d_asked} a JOIN {d_batches} b ON b.question_pk = a.question_pk"""

# What a resumed run still has to ask, numbered anew, and the replies to its batches: two attempts, ids spelled loosely.
VIEWS["d_open_slots"] = """
SELECT analysis_id, company_id, report_year, question_pk, question_id, theme_id, CAST(floor((position - 1) / 5) AS BIGINT) + 1 AS batch
FROM (SELECT a.*, q.question_id, q.theme_id,
             row_number() OVER (PARTITION BY a.analysis_id, q.theme_id ORDER BY q.display_order, q.question_pk) AS position
      FROM {d_asked} a JOIN {d_questions} q ON q.question_pk = a.question_pk
      WHERE a.question_pk % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM {d_answers_raw} r
            WHERE r.analysis_id = a.analysis_id AND r.question_pk = a.question_pk AND r.answer <> 'talvez')) p"""
VIEWS["d_open_items"] = """
SELECT s.analysis_id, s.theme_id, s.batch, t.reply, s.question_pk,
       CASE (s.question_pk + t.reply) % 4 WHEN 1 THEN concat(s.question_id, ' ') WHEN 2 THEN concat('[', s.question_id, ']') ELSE s.question_id END AS question_id,
       CASE (s.analysis_id + s.question_pk + t.reply) % 4 WHEN 0 THEN 'não' WHEN 1 THEN 'sim' WHEN 2 THEN 'Sim' ELSE 'N/A' END AS answer,
       concat('Retomada ', CAST(s.question_pk AS STRING), ' tentativa ', CAST(t.reply AS STRING)) AS justification,
       CASE WHEN s.question_pk % 3 = 0 THEN 'n/a' ELSE concat('Anexo ', CAST(s.question_pk AS STRING), '.pdf') END AS source_reference
FROM {d_open_slots} s JOIN (SELECT 0 AS reply UNION ALL SELECT 1 AS reply) t ON (s.question_pk + s.analysis_id) % 2 <= t.reply
WHERE s.question_pk % 13 <> 0"""


# Which replies to a batch have a slot's question, as the items' views say.
_REPLIES = {
    "d_reply_items": "CASE WHEN (question_pk + analysis_id) % 11 <> 0 THEN filter(array(0, 1), r -> (question_pk + analysis_id) % 3 <> r) END",
    "d_open_items": "CASE WHEN question_pk % 13 <> 0 THEN filter(array(0, 1), r -> (question_pk + analysis_id) % 2 <= r) END",
}


def slots_of(fx):
    """A table, as ``question_slots`` writes it: it is read several times."""
    return fx.stored("slots", lambda: fx["d_slots"])


def reply_items(fx, view, slots):
    """The rows of an items' view from its slots: dealt by reply while they are narrow, so that texts are made and not shuffled."""
    asked = slots.select(*BATCH, "question_pk", "question_id", F.explode(F.expr(_REPLIES[view])).alias("reply")).repartition(*BATCH, "reply")
    names = {name: F.struct(*asked.columns).alias(name) for name in ("a", "b", "s", "t")}  # what the view calls its tables
    return fx.spark.sql(f"{VIEWS[view].split('FROM')[0]} FROM {{asked}}", asked=asked.select(*names.values()))


def reply_payloads(fx, view="d_reply_items", slots=None):
    """The items as replies: led by line breaks and tabs; the second ones bare arrays with an element that is no object."""
    fields = ["question_id", "answer", "justification", "source_reference"]
    items = reply_items(fx, view, slots_of(fx) if slots is None else slots).select(
        *BATCH, "reply", F.struct("question_pk", *fields).alias("item"))
    rows = items.groupBy(*BATCH, "reply").agg(F.array_sort(F.collect_list("item")).alias("items"))
    texts = F.array_join(F.transform("items", lambda i: F.to_json(F.struct(*[i[f].alias(f) for f in fields]))), ", ")
    first = F.concat(F.lit("\n\t{\"answers\": [\n"), texts, F.lit("]}\n"))
    second = F.concat(F.lit(" \t["), F.lit('"sem objeto", '), texts, F.lit("]"))
    return rows.select(*BATCH, "reply", F.when(F.col("reply") == 0, first).otherwise(second).alias("payload"))


def sql_records(items: str, slots: str) -> str:
    """The answer records of ``slots`` from the reply ``items``, both names of views."""
    return f"""
WITH placed AS (SELECT *, reply * 1000 + row_number() OVER (PARTITION BY analysis_id, theme_id, batch, reply ORDER BY question_pk) AS ordinal,
                       lower(trim(question_id)) AS k FROM {{{items}}}),
keyed AS (SELECT analysis_id, theme_id, batch, k, min(ordinal) AS place, max(ordinal) AS latest FROM placed GROUP BY ALL),
asked AS (SELECT b.analysis_id, b.company_id, b.report_year, b.question_pk, b.theme_id, b.batch, lower(b.question_id) AS k FROM {{{slots}}} b),
exact AS (SELECT a.*, e.latest FROM asked a LEFT JOIN keyed e USING (analysis_id, theme_id, batch, k)),
loose AS (SELECT x.analysis_id, x.theme_id, x.batch, x.k, arg_min(r.latest, (r.place, r.k)) AS latest
          FROM exact x JOIN keyed r ON r.analysis_id = x.analysis_id AND r.theme_id = x.theme_id AND r.batch = x.batch
               AND (contains(r.k, x.k) OR contains(x.k, r.k)) WHERE x.latest IS NULL GROUP BY ALL),
found AS (SELECT e.analysis_id, e.company_id, e.report_year, e.theme_id, e.batch, e.question_pk, coalesce(e.latest, l.latest) AS latest
          FROM exact e LEFT JOIN loose l USING (analysis_id, theme_id, batch, k)),
given AS (SELECT f.*, p.ordinal IS NOT NULL AS got, p.answer, p.justification, p.source_reference FROM found f LEFT JOIN placed p
          ON p.analysis_id = f.analysis_id AND p.theme_id = f.theme_id AND p.batch = f.batch AND p.ordinal = f.latest),
normal AS (SELECT *, CASE WHEN answer IN ('Nao', 'nao', 'NAO', 'não') THEN 'Não' WHEN answer IN ('sim', 'SIM') THEN 'Sim'
                  WHEN answer IN ('Sim', 'Não', 'N/A') THEN answer ELSE 'N/A' END AS a FROM given),
sources AS ({_SOURCE})
SELECT analysis_id, question_pk, a AS answer, CASE WHEN got THEN justification ELSE 'Não foi possível processar esta pergunta.' END AS justification,
       CASE WHEN source_reference IS NULL OR source_reference = 'n/a' THEN left(coalesce(s.derived_source, 'Documentos da empresa'), 200)
            ELSE source_reference END AS source_reference,
       CASE WHEN a <> 'N/A' AND a = q.expected_answer THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM normal n JOIN {{d_questions}} q USING (question_pk) LEFT JOIN sources s
  ON s.company_id = n.company_id AND s.report_year = n.report_year AND s.query_id = n.theme_id"""


RECORD = ["analysis_id", "question_pk", "answer", "justification", "source_reference", "score"]


def catalogue(fx):
    return fx["d_questions"].join(fx["d_themes"].select("theme_id", "dimension"), "theme_id")


@query("take_in_answers", sql_records("d_reply_items", "d_slots"))
def _(fx):
    return flows.take_in_answers(slots_of(fx), reply_payloads(fx), catalogue(fx), hybrid_texts(fx)).select(*RECORD)


# The answers a resumed run starts with, as stored records.
VIEWS["d_stored_records"] = """
SELECT a.analysis_id, a.question_pk, 'Sim' AS answer, 'antes' AS justification, 'antes.pdf' AS source_reference, 10.0E0 AS score
FROM {d_asked} a WHERE NOT EXISTS (SELECT 1 FROM {d_open_slots} s WHERE s.analysis_id = a.analysis_id AND s.question_pk = a.question_pk)"""


@query("resume_answers", f"""
SELECT analysis_id, question_pk, answer, justification, source_reference, score FROM ({sql_records("d_open_items", "d_open_slots")})
UNION ALL SELECT * FROM {{d_stored_records}}""")
def _(fx):
    asked = fx.stored("asked", lambda: fx["d_asked"].sortWithinPartitions("analysis_id", "question_pk"))
    left = fx.stored("open_slots", lambda: fx.spark.sql(
        VIEWS["d_open_slots"], d_asked=asked, d_questions=fx["d_questions"], d_answers_raw=fx["d_answers_raw"]))
    stored = fx.stored("stored_records", lambda: fx.spark.sql(VIEWS["d_stored_records"], d_asked=asked, d_open_slots=left))
    questions = catalogue(fx).withColumn("question_text", F.col("question_id"))
    slots = flows.question_slots(asked, questions, stored)
    return flows.resume_analyses(stored, slots, reply_payloads(fx, "d_open_items", left), questions, hybrid_texts(fx))


@query("rejected_replies", """
SELECT DISTINCT analysis_id, theme_id, batch, reply, 'not an object' AS reason, 'sem objeto' AS payload
FROM {d_reply_items} WHERE reply = 1""")
def _(fx):
    return payloads.rejected_replies(reply_payloads(fx), [*BATCH, "reply"])


@query("resume_prompts", f"""
WITH remaining AS (SELECT * FROM {{d_asked}} a WHERE NOT EXISTS (SELECT 1 FROM {{d_answers_raw}} r
    WHERE r.analysis_id = a.analysis_id AND r.question_pk = a.question_pk AND r.answer <> 'talvez')),
ranked AS (SELECT r.*, q.theme_id, q.question_id, q.question_text,
    row_number() OVER (PARTITION BY r.analysis_id, q.theme_id ORDER BY q.display_order, q.question_pk) AS position
  FROM remaining r JOIN {{d_question_texts}} q USING (question_pk)),
lines AS (SELECT analysis_id, company_id, report_year, theme_id, (position - 1) // 5 + 1 AS batch, count(*) AS questions,
    string_agg(((position - 1) % 5 + 1) || '. [ID: ' || question_id || '] ' || CASE WHEN starts_with(question_text, question_id)
      THEN ltrim(substr(question_text, length(question_id) + 1), ' .') ELSE question_text END, chr(10) ORDER BY position) AS question_text
  FROM ranked GROUP BY 1, 2, 3, 4, 5)
SELECT l.analysis_id, l.company_id, l.report_year, l.theme_id, CAST(l.batch AS BIGINT) AS batch, CAST(l.questions AS INT) AS questions,
       l.question_text, coalesce(c.context, 'Nenhum trecho relevante encontrado.') AS context
FROM lines l LEFT JOIN ({_CONTEXT}) c ON c.company_id = l.company_id AND c.report_year = l.report_year AND c.query_id = l.theme_id""")
def _(fx):
    usable = fx["d_answers_raw"].where(F.col("answer") != "talvez")
    return flows.build_prompts(fx["d_asked"], fx["d_question_texts"], hybrid_texts(fx), usable)

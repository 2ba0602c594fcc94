"""Documents, chunks, workbook cells, answer payloads, deletes and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import chunking as C
from veritrail.operators import documents as D
from veritrail.plans.registry import query
from veritrail.plans.scoring_queries import clean_answers, theme_scores
from veritrail.session import work_path
from veritrail.sources import cells, payloads
from veritrail.sources.document_store import DocumentStore


@query("ready_documents", """
SELECT doc_id, company_id, report_year, filename FROM {d_documents} WHERE status = 'ready'""")
def _(fx):
    return D.ready_documents(fx["d_documents"]).select("doc_id", "company_id", "report_year", "filename")


def fresh_chunks(fx):
    return C.chunk_texts(fx["d_documents"], ["doc_id"])


PLACE = ["company_id", "report_year", "filename", "status"]


def placed_chunks(fx):
    """The stored chunk table with what is known of the document: joined to it later, all the texts would be shuffled."""
    return fx.stored("chunks", lambda: C.chunk_texts(fx["d_documents"], ["doc_id", *PLACE]))


def text_chunks(fx):
    """The stored chunk table, which retrieval and reports read."""
    return placed_chunks(fx).drop(*PLACE)


def paged_documents(fx):
    """Conversations as documents whose turns are the pages."""
    pages = F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("page"), "text")))
    return fx["conversations"].groupBy(F.col("conv_id").alias("doc_id")).agg(pages.alias("pages"))


@query("chunks", "SELECT doc_id, chunk_index, content, token_count, page_number FROM {o_chunks}")
def _(fx):
    return fresh_chunks(fx).drop("page_range")


@query("paged_chunks", """
SELECT doc_id, chunk_index, content, token_count, page_number, array_to_string(page_range, ',') AS page_range
FROM {o_paged_chunks}""")
def _(fx):
    chunks = C.chunk_pages(paged_documents(fx), ["doc_id"])
    return chunks.withColumn("page_range", F.array_join("page_range", ","))


@query("chunk_stats", """
SELECT doc_id, chunk_count, tokens, max_tokens,
       CAST(round_even(tokens::DOUBLE / chunk_count, 0) AS BIGINT) AS avg_tokens
FROM (SELECT doc_id, count(*) AS chunk_count, CAST(sum(token_count) AS BIGINT) AS tokens, max(token_count) AS max_tokens
      FROM {o_chunks} GROUP BY doc_id)""")
def _(fx):
    return C.chunk_stats(text_chunks(fx), ["doc_id"])


def embedded_chunks(fx):
    """Chunks with the vector of their document where the embeddings table has one."""
    vectors = fx["embeddings"].select(F.col("vec_id").alias("doc_id"), "embedding")
    return text_chunks(fx).join(vectors, "doc_id", "left")


@query("embedding_backlog", """
SELECT doc_id, chunk_index, left(content, 8000) AS input,
       CAST((row_number() OVER (ORDER BY chunk_index, doc_id) - 1) // 20 + 1 AS BIGINT) AS batch,
       CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS batches
FROM {o_chunks} WHERE NOT EXISTS (SELECT 1 FROM {embeddings} WHERE vec_id = doc_id)""")
def _(fx):
    return C.embedding_backlog(embedded_chunks(fx))


# Chunks of the documents of two in three, as if the others had their vectors.
@query("document_batches", """
SELECT doc_id, chunk_index, left(content, 8000) AS input,
       CAST((row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) // 20 + 1 AS BIGINT) AS batch,
       CAST(ceil(count(*) OVER (PARTITION BY doc_id) / 20) AS BIGINT) AS batches
FROM {o_chunks} WHERE doc_id % 3 <> 0""")
def _(fx):
    vector = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0)))
    return C.document_batches(text_chunks(fx).withColumn("embedding", vector))


@query("embedding_coverage", """
SELECT count(vec_id) AS embedded, count(*) AS chunks FROM {o_chunks} LEFT JOIN {embeddings} ON vec_id = doc_id""")
def _(fx):
    return C.embedding_coverage(embedded_chunks(fx))


@query("latest_documents", """
SELECT doc_id, company_id, filename, report_year, status FROM {d_documents}
QUALIFY row_number() OVER (PARTITION BY company_id, filename ORDER BY doc_id DESC) = 1""")
def _(fx):
    return D.latest_documents(fx["d_documents"].drop("text")).select(
        "doc_id", "company_id", "filename", "report_year", "status"
    )


@query("cascade_delete", """
WITH gone AS (SELECT company_id FROM {d_companies} WHERE sector = 'Outro')
SELECT 'companies' AS entity, count(*) AS remaining FROM {d_companies} WHERE company_id NOT IN (FROM gone)
UNION ALL SELECT 'documents', count(*) FROM {d_documents} WHERE company_id NOT IN (FROM gone)
UNION ALL SELECT 'analyses', count(*) FROM {d_analyses} WHERE company_id NOT IN (FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM {o_chunks} JOIN {d_documents} USING (doc_id) WHERE company_id NOT IN (FROM gone)
UNION ALL SELECT 'answers', count(*) FROM {o_answers} WHERE company_id NOT IN (FROM gone)
UNION ALL SELECT 'theme_scores', count(*) FROM {o_theme_scores} WHERE company_id NOT IN (FROM gone)""")
def _(fx):
    companies = fx["d_companies"]
    tables = D.cascade_delete(
        companies.where(F.col("sector") == "Outro"), companies, fx["d_documents"].select("doc_id", "company_id"),
        fx["d_analyses"], text_chunks(fx).select("doc_id", "chunk_index"), clean_answers(fx), theme_scores(fx),
    )
    counts = [t.agg(F.count("*").alias("remaining")).select(F.lit(n).alias("entity"), "remaining") for n, t in tables.items()]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


# Three uploads in order of age, then the companies of a sector are deleted, and the touched buckets compacted.
@query("stored_chunks", """
WITH latest AS (SELECT doc_id, company_id FROM {d_documents}
  QUALIFY row_number() OVER (PARTITION BY company_id, filename ORDER BY doc_id DESC) = 1)
SELECT doc_id, chunk_index, content FROM {o_chunks} JOIN latest USING (doc_id)
WHERE company_id NOT IN (SELECT company_id FROM {d_companies} WHERE sector = 'Outro')""")
def _(fx):
    store = DocumentStore(fx.spark, work_path(fx.spark, "document-store"), buckets=16)
    documents, chunks = fx["d_documents"].drop("text"), text_chunks(fx).select("doc_id", "chunk_index", "content")
    third = F.floor(3 * F.col("doc_id") / (documents.select(F.max("doc_id")).first()[0] + 1))
    for upload in range(3):
        store.put(documents.where(third == upload), chunks.where(third == upload))
    store.remove_companies(fx["d_companies"].where("sector = 'Outro'"))
    store.compact()
    return store.chunks()


@query("seed_questions", """
SELECT q.question_pk, q.question_id, CASE WHEN EXISTS (SELECT 1 FROM {d_answers_raw} a WHERE a.question_pk = q.question_pk
       AND a.answer = 'sim' AND a.report_year = 1996) THEN 'stored' ELSE 'seeded' END AS origin FROM {d_questions} q""")
def _(fx):
    used = fx["d_answers_raw"].where((F.col("answer") == "sim") & (F.col("report_year") == 1996))
    questions = fx["d_questions"].select("question_pk", "question_id")
    stored = questions.join(used.select("question_pk"), "question_pk", "left_semi").withColumn("origin", F.lit("stored"))
    return D.seed_missing(stored, questions.withColumn("origin", F.lit("seeded")), ["question_id"])


_EXTRACT = """
WITH grid AS (SELECT sheet, row_number, max(value) FILTER (WHERE col = 'A') AS a, max(value) FILTER (WHERE col = 'B') AS b,
   max(value) FILTER (WHERE col = 'C') AS c, max(value) FILTER (WHERE col = 'D') AS d, max(value) FILTER (WHERE col = 'E') AS e,
   max(value) FILTER (WHERE col = 'F') AS f, max(value) FILTER (WHERE col = 'L') AS l FROM {d_cells} GROUP BY ALL),
picked AS (SELECT *, list_filter([trim(b), trim(c), trim(d), trim(a)], lambda s: regexp_matches(s, '^\\d+\\.\\d+'))[1] AS cell FROM grid
   WHERE sheet NOT IN ('Capa', 'Sumário', 'Conceito&Orientações', 'Dados da empresa', 'Abrev_Temas', 'Assinaturas',
                       'Padronização_dados', 'Padronização', 'Notas')),
ids AS (SELECT *, nullif(regexp_extract(cell, '^(\\d+\\.\\d+(?:\\.\\d+)*)', 1), '') AS question_id FROM picked),
texts AS (SELECT *, coalesce(nullif(trim(substr(cell, length(question_id) + 1)), ''),
   CASE WHEN length(c) > 10 THEN c WHEN length(d) > 10 THEN d END) AS t FROM ids),
extracted AS (SELECT sheet, row_number, question_id, left(t, 500) AS question_text, trim(e) AS answer,
   left(coalesce(nullif(f, ''), nullif(l, '')), 1000) AS source FROM texts WHERE question_id IS NOT NULL OR length(t) > 15)
"""


@query("extract_questionnaire", _EXTRACT + "SELECT * FROM extracted")
def _(fx):
    return cells.extract_questionnaire(fx["d_cells"])


@query("extract_summary", _EXTRACT + """
SELECT sheet, count(*) AS questions, count(*) FILTER (WHERE answer NOT IN ('', 'None', 'N/A')) AS answered
FROM extracted GROUP BY sheet""")
def _(fx):
    return cells.extraction_summary(cells.extract_questionnaire(fx["d_cells"]))


def reply_payloads(fx):
    """Raw answers as JSON replies: single objects, bare arrays and the three named arrays."""
    raw = fx["d_answer_details"].join(fx["d_questions"].select("question_pk", "question_id"), "question_pk")
    one = F.struct("question_id", "answer", "justification", "source_reference", "improvement_points", "confidence_score")
    sub = F.struct(F.concat("question_id", F.lit(".1")).alias("question_id"), F.lit("N/A").alias("answer"))
    shape = F.col("l_linenumber") % 6
    body = (
        F.when(shape == 0, F.to_json(one))
        .when(shape == 1, F.concat(F.lit("["), F.to_json(one), F.lit("]")))
        .when(shape == 2, F.concat(F.lit('{"answers": ['), F.to_json(one), F.lit(", "), F.to_json(sub), F.lit("]}")))
        .when(shape == 3, F.concat(F.lit('{"results": ['), F.to_json(one), F.lit("]}")))
        .when(shape == 4, F.concat(F.lit('{"respostas": ['), F.to_json(one), F.lit(", "), F.to_json(sub), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"answers": '), F.to_json(one), F.lit("}")))
    )
    return raw.select("analysis_id", "l_orderkey", "l_linenumber", "created_at", body.alias("payload"))


@query("ingest_answers", """
WITH raw AS (SELECT * FROM {d_answer_details} JOIN {d_questions} USING (question_pk))
SELECT analysis_id, l_orderkey, l_linenumber, 0 AS ordinal, question_id, answer, justification, source_reference,
       improvement_points, round(confidence_score, 6) AS confidence_score FROM raw
UNION ALL SELECT analysis_id, l_orderkey, l_linenumber, 1, concat(question_id, '.1'), 'N/A', NULL, NULL, NULL, NULL
FROM raw WHERE l_linenumber % 6 IN (2, 4)""")
def _(fx):
    rows = payloads.ingest_answers(reply_payloads(fx), ["analysis_id", "l_orderkey", "l_linenumber"])
    return rows.withColumn("confidence_score", F.round("confidence_score", 6))

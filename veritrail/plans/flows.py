"""The jobs from end to end, for all companies and years at once.

Each flow reads tables and gives tables; what crosses to an outside service (the prompts
out, the replies and the vectors in) is a table too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.operators import answers as A
from veritrail.operators import chunking as C
from veritrail.operators import links as K
from veritrail.operators import pages as P
from veritrail.operators import retrieval as R
from veritrail.operators import scoring as S
from veritrail.operators.documents import ready_documents
from veritrail.session import written
from veritrail.sources.payloads import ingest_answers

SCOPE = ["company_id", "report_year"]
HIT = ["doc_id", "chunk_index"]


def discover_documents(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Crawled pages -> ranked document candidates with the names they will be stored under."""
    ranked = K.rank_links(K.dedup_links(K.find_links(pages)))
    return K.document_names(K.candidates(ranked, list(keys)))


def usable_pages(pages: DataFrame) -> DataFrame:
    """Crawled pages -> text and page count of the pages that can be used."""
    return P.extract_pages(pages).where(F.col("unusable").isNull()).drop("html", "unusable")


def chunk_web_pages(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Crawled pages -> chunks of the usable ones."""
    return C.chunk_texts(usable_pages(pages), list(keys))


def retrieve(themes: DataFrame, questions: DataFrame, chunks: DataFrame, documents: DataFrame,
             vectors: DataFrame | None = None, k: int = L.SEARCH_DEPTH) -> DataFrame:
    """The best chunks per company, year and theme, with their text and file name.

    ``chunks`` holds doc_id, chunk_index, content, page columns and, with ``vectors``
    (query_id = theme, embedding), the chunk's own embedding.
    """
    placed = chunks.join(ready_documents(documents).select(*SCOPE, "doc_id", "filename"), "doc_id")
    hits = R.keyword_topk(placed, R.theme_terms(themes, questions), HIT, SCOPE, k)
    if vectors is not None:
        hits = R.hybrid_topk(R.vector_topk(placed, vectors, HIT, SCOPE, k), hits, SCOPE)
    texts = placed.select(*HIT, "filename", "page_number", "page_range", "content")
    return written(hits.join(texts, HIT), "hits")


def question_slots(asked: DataFrame, questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """The questions still to be asked, each with its place: theme, position and batch of its analysis.

    ``asked`` has analysis_id, company_id, report_year, question_pk. With the ``answers`` an analysis already has, only
    the remaining questions are numbered. Batch numbers hold for one run only: prompts and replies of a run must both
    use the slots made at its start, or answers would be looked for in other batches than they were asked in.
    The table is written, so it stays the same when answers arrive meanwhile.
    """
    open_questions = asked if answers is None else A.remaining_questions(asked, answers)
    wanted = open_questions.select("analysis_id", *SCOPE, "question_pk").join(
        questions.select("question_pk", "question_id", "question_text", "theme_id", "display_order"), "question_pk")
    return written(R.question_batches(wanted, scope=["analysis_id"]), "slots")


def prompt_slots(slots: DataFrame, hits: DataFrame) -> DataFrame:
    """One prompt row per analysis, theme and batch of ``slots``."""
    return R.prompt_rows(slots, R.theme_context(hits, SCOPE).drop("chunks"), SCOPE, ["analysis_id"])


def build_prompts(asked: DataFrame, questions: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One prompt row per analysis, theme and five asked questions; of a resumed analysis only for what is still open."""
    return prompt_slots(question_slots(asked, questions, answers), hits)


def take_in_answers(slots: DataFrame, replies: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """JSON replies -> one stored answer record per slot.

    ``slots`` are those the prompts were made of: analysis_id, company_id, report_year, question_pk, question_id,
    theme_id, batch; ``replies`` has analysis_id, theme_id, batch and payload, and ``reply`` (its number in the batch)
    where a batch is asked again; ``questions`` carries the theme's dimension. What could not be read is in
    ``sources.payloads.rejected_replies``.
    """
    batch = ["analysis_id", "theme_id", "batch"]
    fields = ["answer", "justification", "source_reference", "improvement_points", "confidence_score"]
    numbered = replies if "reply" in replies.columns else replies.withColumn("reply", F.lit(0))
    given = ingest_answers(numbered, [*batch, "reply"]).withColumn("answer_row", F.struct(*fields)).withColumn(
        "ordinal", F.struct("reply", "ordinal"))
    expected = slots.select(*batch, *SCOPE, "question_pk", "question_id")
    matched = A.match_answers(expected, given.select(*batch, "question_id", "ordinal", "answer_row"), batch)
    # hits and misses come from the same match, so the questions are not joined to their answers once more
    known = F.col("answer_row").isNotNull()
    filled = A.with_defaults(matched.select(*expected.columns, known.alias("_given"), "answer_row.*"))
    # written, so that its size is known: a short text per company, year and theme
    sources = written(R.derived_source(hits, SCOPE).withColumnRenamed("query_id", "theme_id"), "sources")
    return A.answer_records(A.backfill_source(filled, sources, [*SCOPE, "theme_id"]).drop("theme_id"), questions)


def resume_analyses(stored: DataFrame, slots: DataFrame, replies: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """All answer records of resumed analyses: the ``stored`` ones as they are, and one for every slot of the resumed run."""
    return stored.unionByName(take_in_answers(slots, replies, questions, hits).select(*stored.columns))


def score_analyses(answers: DataFrame, questions: DataFrame, themes: DataFrame, companies: DataFrame,
                   weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored answers (unique per question) -> weighted theme scores and overall scores, always from all answers."""
    scores = S.theme_scores(A.normalize(answers), questions)
    weighted = written(S.weight_themes(scores, companies, themes, weights), "theme-scores")
    return weighted, S.overall_scores(weighted)

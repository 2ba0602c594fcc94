"""Document selection, replacement, cascading deletes and seeding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators.keys import first_per_key


def ready_documents(documents: DataFrame, company_id: int | None = None, report_year: int | None = None) -> DataFrame:
    """Documents that can be searched, of one company and year or of all."""
    chosen = documents.where(F.col("status") == "ready")
    if company_id is not None:
        chosen = chosen.where(F.col("company_id") == company_id)
    if report_year is not None:
        chosen = chosen.where(F.col("report_year") == report_year)
    return chosen


def latest_documents(documents: DataFrame, recency: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A document replaces an older one of the same company and file name."""
    return first_per_key(documents, ["company_id", "filename"], [F.col(c).desc() for c in recency])


def drop_children(children: DataFrame, deleted: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Child rows whose parent is not among the deleted keys."""
    keys = [key] if isinstance(key, str) else list(key)
    return children.join(deleted.select(*keys), keys, "left_anti")


def cascade_delete(deleted: DataFrame, companies: DataFrame, documents: DataFrame, analyses: DataFrame,
                   chunks: DataFrame, answers: DataFrame, theme_scores: DataFrame) -> dict[str, DataFrame]:
    """All tables without the deleted companies and what hangs on them."""
    gone_documents = documents.join(deleted.select("company_id"), "company_id", "left_semi")
    gone_analyses = analyses.join(deleted.select("company_id"), "company_id", "left_semi")
    return {
        "companies": drop_children(companies, deleted, "company_id"),
        "documents": drop_children(documents, deleted, "company_id"),
        "analyses": drop_children(analyses, deleted, "company_id"),
        "chunks": drop_children(chunks, gone_documents, "doc_id"),
        "answers": drop_children(answers, gone_analyses, "analysis_id"),
        "theme_scores": drop_children(theme_scores, gone_analyses, "analysis_id"),
    }


def seed_missing(existing: DataFrame, seeds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows plus the seeds whose key is not there yet; running it twice adds nothing."""
    return existing.unionByName(seeds.join(existing.select(*key), list(key), "left_anti"))

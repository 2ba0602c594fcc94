"""Crawled pages -> text, and the pages whose text is no use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.html import page_text
from veritrail.functions.text import contains_any, let, strip
from veritrail.operators.keys import unfold_array


def unusable_reason(text: Column, html: Column) -> Column:
    """Why a page's text cannot be used, or null: too short, an error dump, or rendered by scripts."""
    size = F.length(strip(text))
    markup = F.lower(html)
    scripts = (F.length(markup) - F.length(F.replace(markup, F.lit("<script"), F.lit("")))) / len("<script")
    garbage = text.rlike("(?is)" + "|".join(L.GARBAGE_PATTERNS))
    tables = contains_any(markup, ["<table", "data-table"])
    numbers = F.regexp_count(text, F.lit(L.BRAZILIAN_NUMBER_PATTERN))
    return (
        F.when(size < L.MIN_USEFUL_CHARS, F.lit("short"))
        .when(garbage, F.lit("garbage"))
        .when((scripts > 5) & (size < 1000), F.lit("scripts"))
        .when(contains_any(markup, L.FRAMEWORK_MARKS) & (scripts > 3) & tables & (numbers <= 3), F.lit("unrendered table"))
    )


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, the estimated page count and ``unusable`` (the reason, or null).

    The three come as one unfolded struct, so that a filter on them cannot be pushed below
    and have the text extracted a second time.
    """

    def describe(text: Column) -> Column:
        estimate = F.greatest(F.lit(1), F.floor(F.length(text) / L.CHARS_PER_PAGE))
        return F.struct(
            text.alias("text"), estimate.cast("int").alias("page_count"),
            unusable_reason(text, F.col(html)).alias("unusable"),
        )

    described = unfold_array(pages, pages.columns, F.array(let(page_text(F.col(html)), describe)), "_page")
    return described.select(*pages.columns, "_page.*")

"""Document links of a page: found, deduplicated, ranked and named.

A page is one row and its links are one array column, so nothing here shuffles;
``unfold`` turns the array into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.html import attribute, element_at_start, inner_text, raw_attribute, without_scripts
from veritrail.functions.text import let, strip, unescape
from veritrail.operators.keys import unfold_array
from veritrail.functions.urls import (
    file_type,
    is_document_url,
    url_decoded,
    url_filename,
    url_join,
    url_path,
    without_query,
)

_NO_LINKS = "array<struct<generator:int,position:int,url:string,text:string>>"


def _tagged(urls: Column, generator: int) -> Column:
    return F.transform(
        urls,
        lambda u, i: F.struct(
            F.lit(generator).alias("generator"), i.alias("position"), u["url"].alias("url"), u["text"].alias("text")
        ),
    )


def _link(url: Column, text: Column) -> Column:
    return F.struct(url.alias("url"), text.alias("text"))


def _anchors(markup: Column, base: Column) -> Column:
    def link(piece: Column) -> Column:
        inside = F.regexp_extract(piece, r"(?is)^<[^>]*>(.*?)(?:</a\b|\z)", 1)
        return F.struct(strip(attribute(piece, "href")).alias("href"), inside.alias("inside"))

    def useful(a: Column) -> Column:
        href = a["href"]
        skipped = (href == "") | href.startswith("#") | href.startswith("mailto:") | href.startswith("javascript:")
        return href.isNotNull() & ~skipped

    pieces = F.filter(F.split(markup, r"(?i)(?=<a\b)"), lambda p: p.rlike(r"(?i)^<a\b"))
    found = F.filter(F.transform(pieces, link), useful)
    return F.transform(found, lambda a: _link(url_join(base, a["href"]), inner_text(a["inside"])))


def _attribute_pdfs(markup: Column) -> Column:
    """PDF URLs in click and download attributes, with the text of the element that has them."""
    names = "|".join(L.PDF_ATTRIBUTES)
    opening = rf"<[a-z][a-z0-9]*\b[^>]*(?<![\w-])(?:{names})\s*="

    def links(pieces: Column) -> Column:
        def of_piece(piece: Column, i: Column) -> Column:
            rest = F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "")
            name = F.lower(F.regexp_extract(piece, "^<([a-zA-Z][a-zA-Z0-9]*)", 1))
            values = unescape(F.concat_ws("\n", *[raw_attribute(piece, n) for n in L.PDF_ATTRIBUTES]))
            urls = F.regexp_extract_all(values, F.lit(L.PDF_IN_ATTRIBUTE_PATTERN), 1)
            text = inner_text(element_at_start(rest, name))
            return F.when(
                piece.rlike(rf"(?is)^{opening}") & F.contains(F.lower(piece), F.lit(".pdf")),
                let(text, lambda t: F.transform(urls, lambda u: _link(u, t))),
            )

        return F.flatten(F.filter(F.transform(pieces, of_piece), lambda p: p.isNotNull()))

    return let(F.split(markup, f"(?is)(?={opening})"), links)


def _frames(markup: Column, base: Column) -> Column:
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)(<iframe\b[^>]*>)"), 1)
    sources = F.filter(
        F.transform(tags, lambda t: strip(attribute(t, "src"))),
        lambda s: s.isNotNull() & (F.contains(F.lower(s), F.lit(".pdf")) | F.contains(F.lower(s), F.lit("document"))),
    )
    return F.transform(sources, lambda s: _link(url_join(base, s), F.lit(L.EMBEDDED_LINK_TEXT)))


def _source_pdfs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(L.PDF_IN_SOURCE_PATTERN), 1), lambda u: _link(u, F.lit("")))


def find_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``links``: anchors, pdf attributes, document frames and raw pdf URLs, in this order."""
    markup = pages.withColumn("_markup", without_scripts(F.col(html)))
    base_tag = F.regexp_extract("_markup", r"""(?is)(<base\b[^>]*(?<![\w-])href\s*=[^>]*>)""", 1)
    with_base = markup.withColumn("_base", F.coalesce(attribute(base_tag, "href"), F.col(url)))
    m, b = F.col("_markup"), F.col("_base")
    links = F.concat(
        _tagged(_anchors(m, b), 1), _tagged(_attribute_pdfs(m), 2),
        _tagged(_frames(m, b), 3), _tagged(_source_pdfs(F.col(html)), 4),
    )
    found = F.when(F.length(html) >= L.MIN_PAGE_CHARS, links).otherwise(F.array().cast(_NO_LINKS))
    return with_base.withColumn("links", found).drop("_markup", "_base")


def dedup_links(pages: DataFrame) -> DataFrame:
    """Keep the first link to every address; fragment and trailing slashes do not tell addresses apart."""
    keyed = F.transform(
        "links",
        lambda a: F.struct(
            F.rtrim(F.substring_index(a["url"], "#", 1), F.lit("/")).alias("key"),
            a["generator"].alias("generator"), a["position"].alias("position"), a["url"].alias("url"), a["text"].alias("text"),
        ),
    )
    firsts = let(
        F.array_sort(keyed),
        lambda s: F.filter(s, lambda a, i: (i == 0) | (F.get(s, i - 1)["key"] != a["key"])),
    )
    ordered = F.array_sort(
        F.transform(firsts, lambda a: F.struct(a["generator"].alias("generator"), a["position"].alias("position"),
                                               a["url"].alias("url"), a["text"].alias("text")))
    )
    return pages.withColumn("links", ordered)


def rank_links(pages: DataFrame, keywords: list[str] = L.LINK_KEYWORDS) -> DataFrame:
    """Keep documents and links on the subject, score them, best first (then in page order)."""
    words = F.array(*[F.lit(k) for k in keywords])

    def scored(a: Column) -> Column:
        def build(haystack: Column) -> Column:
            hits = F.size(F.filter(words, lambda w: F.contains(haystack, w)))
            pdf = F.endswith(without_query(a["url"]), F.lit(".pdf"))
            return F.struct(
                (-(hits + F.when(pdf, F.lit(L.PDF_BONUS)).otherwise(F.lit(0)))).alias("order"),
                a["generator"].alias("generator"), a["position"].alias("position"),
                a["url"].alias("url"), a["text"].alias("text"), (hits > 0).alias("relevant"),
            )

        return let(F.lower(F.concat(a["text"], F.lit(" "), url_decoded(a["url"]))), build)

    kept = F.filter(F.transform("links", scored), lambda a: a["relevant"] | is_document_url(a["url"]))
    return pages.withColumn("links", F.array_sort(kept))


def link_name(url: Column, text: Column) -> Column:
    """The link's text without size and download remarks, else the file name made readable."""
    bare = strip(text)
    sized = F.regexp_replace(bare, L.SIZE_SUFFIX_PATTERN, "")
    by_text = strip(F.regexp_replace(sized, L.DOWNLOAD_SUFFIX_PATTERN, ""))
    file = url_decoded(F.substring_index(url_path(url), "/", -1))
    words = F.translate(F.regexp_replace(file, L.NAME_EXTENSION_PATTERN, ""), "-_", "  ")
    by_file = F.coalesce(F.nullif(strip(words), F.lit("")), F.lit(L.DEFAULT_DOCUMENT_NAME))
    return F.when((F.length(bare) > 5) & (F.length(bare) < 200), by_text).otherwise(by_file)


def unfold(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per link, numbered from 1 within its page."""
    rows = unfold_array(pages, keys, F.col("links"), "_link", "_i")
    return rows.select(*keys, (F.col("_i") + 1).alias("rank"), "_link.*")


def candidates(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked links as document candidates."""
    return unfold(ranked, keys).select(
        *keys, "rank", "url",
        link_name(F.col("url"), F.col("text")).alias("name"),
        file_type(F.col("url")).alias("file_type"),
        (-F.col("order")).alias("relevance_score"),
        F.substring("text", 1, 200).alias("link_text"),
    )


def selected(found: DataFrame, min_score: int = 2) -> DataFrame:
    """PDFs that score high enough to be taken without asking."""
    return found.where((F.col("file_type") == "pdf") & (F.col("relevance_score") >= min_score))


def document_names(found: DataFrame) -> DataFrame:
    """File names under which candidates are stored; a pdf's ends with ``.pdf``."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), url_filename(F.col("url")))
    needs = (F.col("file_type") == "pdf") & ~F.endswith(F.lower("filename"), F.lit(".pdf"))
    return found.withColumn("filename", name).withColumn(
        "filename", F.when(needs, F.concat("filename", F.lit(".pdf"))).otherwise(F.col("filename"))
    )

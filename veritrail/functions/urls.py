"""URL expressions. They never fail: a malformed URL gives a best effort, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.text import let

_SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*:"


def without_query(url: Column) -> Column:
    """Lower case, cut at the first question mark: where a file extension would stand."""
    return F.lower(F.substring_index(url, "?", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, rf"^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, rf"^(?:{_SCHEME})?//([^/?#]*)", 1)


def url_decoded(url: Column) -> Column:
    """Percent-decoded; plus signs and stray percent signs stay as they are."""
    safe = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), url)


def ends_with_any(text: Column, endings: list[str]) -> Column:
    hit = F.lit(False)
    for ending in endings:
        hit = hit | F.endswith(text, F.lit(ending))
    return hit


def content_type(url: Column, header: Column) -> Column:
    """``pdf`` by the URL's ending or the header, else ``html``."""
    by_header = F.coalesce(F.contains(F.lower(header), F.lit("application/pdf")), F.lit(False))
    return F.when(F.endswith(without_query(url), F.lit(".pdf")) | by_header, F.lit("pdf")).otherwise(F.lit("html"))


def file_type(url: Column) -> Column:
    bare = without_query(url)
    return (
        F.when(F.endswith(bare, F.lit(".pdf")), F.lit("pdf"))
        .when(ends_with_any(bare, [".xlsx", ".xls"]), F.lit("excel"))
        .when(F.endswith(bare, F.lit(".docx")), F.lit("word"))
        .otherwise(F.lit("html"))
    )


def is_document_url(url: Column) -> Column:
    return ends_with_any(without_query(url), L.DOCUMENT_EXTENSIONS)


def url_filename(url: Column) -> Column:
    """A readable file name: the last path segment, else the host."""

    def named(segment: Column) -> Column:
        host = F.replace(url_host(url), F.lit("www."), F.lit(""))
        return (
            F.when(F.contains(segment, F.lit(".")), F.substring(segment, 1, 120))
            .when(segment != "", F.concat(F.substring(segment, 1, 80), F.lit(".html")))
            .otherwise(F.concat(F.substring(host, 1, 60), F.lit(".html")))
        )

    return let(F.substring_index(F.rtrim(url_path(url), F.lit("/")), "/", -1), named)


def _resolve_dots(segments: Column) -> Column:
    """Path segments with ``.`` and ``..`` worked off."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def url_join(base: Column, link: Column) -> Column:
    """The URL a link on a page leads to."""
    origin = F.regexp_extract(base, rf"^((?:{_SCHEME})?(?://[^/?#]*)?)", 1)
    base_path = F.regexp_extract(base, rf"^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_extract(link, "^([^?#]*)", 1)
    rest = F.regexp_extract(link, "^[^?#]*(.*)$", 1)

    folder = F.split(F.regexp_replace(base_path, "[^/]*$", ""), "/", -1)
    relative = F.concat(F.slice(folder, 1, F.size(folder) - 1), F.split(path, "/", -1))
    inner = F.slice(relative, 2, F.greatest(F.size(relative) - 2, F.lit(0)))
    squeezed = F.concat(
        F.slice(relative, 1, 1), F.filter(inner, lambda s: s != ""),
        F.when(F.size(relative) > 1, F.slice(relative, -1, 1)).otherwise(F.array().cast("array<string>")),
    )
    segments = F.when(F.startswith(path, F.lit("/")), F.split(path, "/", -1)).otherwise(squeezed)
    joined = let(segments, lambda s: F.array_join(_resolve_dots(s), "/"))
    rooted = let(joined, lambda p: F.when((origin != "") & ~F.startswith(p, F.lit("/")), F.concat(F.lit("/"), p)).otherwise(p))
    return (
        F.when(link == "", base)
        .when(link.rlike(f"^{_SCHEME}"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, f"^({_SCHEME})?", 1), link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, "^([^#]*)", 1), link))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), link))
        .otherwise(F.concat(origin, rooted, rest))
    )

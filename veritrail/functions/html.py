"""HTML expressions on whole page strings, inside the JVM.

Tags are found with regular expressions, nesting is followed by a fold over the few
pieces between tags of one name. Removed parts leave ``<!>`` behind, so the texts on
either side stay separate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.text import clean_text, let, non_empty, unescape

_TAG = r"<[a-zA-Z/!?][^>]*>"
_GAP = "<!>"
_RAW = ["script", "style"]  # their content is not markup
_FLAT = ["noscript", "iframe"]  # cannot contain themselves


def without_elements(html: Column, tags: list[str]) -> Column:
    """Without comments and without these (not self-nesting) elements, unclosed ones to the end."""
    names = "|".join(tags)
    return F.regexp_replace(
        html, rf"(?is)<!--.*?(?:-->|\z)|<({names})\b[^>]*>.*?(?:</\1\s*>|\z)", _GAP
    )


def without_scripts(html: Column) -> Column:
    return without_elements(html, _RAW)


def without_nested(html: Column, tags: list[str]) -> Column:
    """Without these elements, whatever they contain."""
    names = "|".join(tags)
    start = F.struct(F.lit("").alias("tag"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, rf"(?i)^</?({names})\b", 1))
        closing = F.startswith(piece, F.lit("</"))
        alone = piece.rlike(r"^<[^>]*/>")
        after = F.concat(F.lit(_GAP), F.regexp_replace(piece, "^[^>]*>?", ""))
        outside = acc["depth"] == 0
        opens = outside & (name != "") & ~closing & ~alone
        same = ~outside & (name == acc["tag"])
        depth = (
            F.when(opens, F.lit(1))
            .when(same & closing, acc["depth"] - 1)
            .when(same & ~alone, acc["depth"] + 1)
            .otherwise(acc["depth"])
        )
        left = same & closing & (acc["depth"] == 1)
        keep = F.when(opens, F.lit(None)).when(outside & (name != ""), after).when(outside, piece).when(left, after)
        return F.struct(
            F.when(opens, name).otherwise(acc["tag"]).alias("tag"),
            depth.alias("depth"),
            F.when(keep.isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(keep))).alias("kept"),
        )

    pieces = F.split(html, rf"(?i)(?=</?(?:{names})\b)")
    return F.array_join(F.aggregate(pieces, start, step)["kept"], "")


def element_at_start(html: Column, tag: Column) -> Column:
    """``html`` starts with an opening ``tag``: the element's inside, up to its own closing tag."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, piece: Column) -> Column:
        closing = F.startswith(piece, F.lit("</"))
        opening = F.startswith(F.lower(piece), F.concat(F.lit("<"), tag))
        depth = acc["depth"] + F.when(closing, F.lit(-1)).when(opening, F.lit(1)).otherwise(F.lit(0))
        done = acc["done"] | (depth <= 0)
        return F.struct(
            depth.alias("depth"),
            done.alias("done"),
            F.when(done, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(piece))).alias("kept"),
        )

    pieces = F.filter(F.split(html, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)"))), lambda p: p != "")
    return F.regexp_replace(F.array_join(F.aggregate(pieces, start, step)["kept"], ""), "^<[^>]*>", "")


def first_element(html: Column, opening: str, tag: str | None = None) -> Column:
    """Inside of the first element whose opening tag matches; null when there is none."""

    def cut(place: Column) -> Column:
        rest = F.substr(html, place)
        name = F.lit(tag) if tag else F.lower(F.regexp_extract(rest, "^<([a-zA-Z][a-zA-Z0-9]*)", 1))
        return F.when(place > 0, element_at_start(rest, name))

    return let(F.regexp_instr(html, F.lit(opening)), cut)


def content_area(html: Column) -> Column:
    """``main``, else ``article``, else ``role=main``, else a content-like ``div``, else the body."""
    word = L.CONTENT_CLASS_PATTERN
    div = rf"""(?is)<div\b[^>]*\bclass\s*=\s*(?:"[^"]*(?:{word})|'[^']*(?:{word})|[^\s"'>]*(?:{word}))"""
    body = F.nullif(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1), F.lit(""))
    return F.coalesce(
        first_element(html, r"(?i)<main\b[^>]*>", "main"),
        first_element(html, r"(?i)<article\b[^>]*>", "article"),
        first_element(html, r"""(?is)<[a-z][a-z0-9]*\b[^>]*\brole\s*=\s*["']?main["'\s>]"""),
        first_element(html, div, "div"),
        body,
        html,
    )


def text_nodes(html: Column) -> Column:
    """The texts between tags, decoded and trimmed, blank ones left out."""
    return non_empty(F.split(unescape(F.regexp_replace(html, _TAG, "\x01")), "\x01"))


def inner_text(html: Column) -> Column:
    return F.array_join(text_nodes(html), "")


def table_text(table: Column) -> Column:
    """``a | b`` lines with a dashed line under the first; empty for a table without cells."""
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr\b|</table\b|\z)"), 1)
    cell = r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]\b|\z)"
    cells = F.filter(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(cell), 1)), lambda c: F.size(c) > 0)
    lines = F.transform(cells, lambda row: F.array_join(F.transform(row, inner_text), " | "))

    def render(line: Column) -> Column:
        head = F.get(line, F.lit(0))
        rule = F.array_join(F.array_repeat(F.lit("---"), F.size(F.split(head, r" \| ", -1))), " | ")
        body = F.array_join(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), "\n")
        return F.when(F.size(line) == 0, F.lit("")).otherwise(F.concat_ws("\n", head, rule, body))

    return let(lines, render)


def page_text(html: Column) -> Column:
    """The readable text of a page: block texts joined by blank lines, tables as lines."""
    markup = without_elements(html, _RAW + _FLAT)
    area = let(without_nested(markup, [t for t in L.DROPPED_TAGS if t not in _RAW + _FLAT]), content_area)
    parts = F.transform(
        F.split(area, r"(?i)(?=<table\b)|(?<=</table>)"),
        lambda p: F.when(F.startswith(F.lower(p), F.lit("<table")), non_empty(F.array(table_text(p)))).otherwise(text_nodes(p)),
    )
    return clean_text(F.array_join(F.flatten(parts), "\n\n"))


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag as written; null when it is not there."""
    pattern = rf"""(?is)^<[^>]*?(?<![\w-]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

    def unquoted(value: Column) -> Column:
        quoted = value.startswith('"') | value.startswith("'")
        return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).when(value != "", value)

    return let(F.regexp_extract(tag, pattern, 1), unquoted)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, decoded; null when it is not there."""
    return unescape(raw_attribute(tag, name))

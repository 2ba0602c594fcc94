"""String expressions shared by the operators. All of them stay inside the JVM.

Whitespace here means what Unicode calls whitespace plus the four ASCII separators
(0x1C-0x1F), which is wider than the default ``\\s`` of Java regular expressions.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _char_class(chars: str) -> str:
    """The characters as ranges, for use inside ``[...]`` of a regular expression."""
    parts, first = [], None
    for char, following in zip(chars, chars[1:] + "\0"):
        first = first or char
        if ord(following) != ord(char) + 1:
            parts.append(rf"\x{{{ord(first):x}}}-\x{{{ord(char):x}}}")
            first = None
    return "".join(parts)


SPACE = _char_class(SPACE_CHARS)
_ODD_SPACING = f"[{_char_class(SPACE_CHARS.replace(' ', ''))}]|  "


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Whitespace-separated words; no empty element for leading or trailing space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words. Singly spaced text, the usual case, counts its spaces."""

    def count(bare: Column) -> Column:
        spaces = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
        return (
            F.when(bare == "", F.lit(0))
            .when(~bare.rlike(_ODD_SPACING), spaces + 1)
            .otherwise(F.regexp_count(bare, F.lit(f"[^{SPACE}]+")))
        )

    return let(strip(text), count)


def non_empty(parts: Column) -> Column:
    """Strip every element and drop the blank ones."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def clean_text(text: Column) -> Column:
    """At most one blank line in a row, single spaces, trimmed lines."""
    squeezed = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return strip(F.array_join(F.transform(F.split(squeezed, "\n"), strip), "\n"))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Characters whose accent-free form is one ASCII character, and the combining marks."""
    source, target, marks = [], [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1 and base.isascii():
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    source, target = _fold_table()
    return F.translate(F.lower(text), source, target)


def fold_literal(text: str) -> str:
    source, target = _fold_table()
    table = {ord(s): (target[i] if i < len(target) else None) for i, s in enumerate(source)}
    return text.lower().translate(table)


def contains_any(text: Column, patterns: list[str]) -> Column:
    """True when any of the literal patterns occurs in ``text``."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.contains(text, F.lit(pattern))
    return hit


@lru_cache(maxsize=1)
def _entity_literals() -> tuple[str, str]:
    """Named character references (``name`` -> text) as two delimiter-joined strings."""
    named = [(name[:-1], value) for name, value in sorted(html5.items()) if name.endswith(";")]
    return "\u0001".join(n for n, _ in named), "\u0001".join(v for _, v in named)


_COMMON_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}


def _decode_reference(part: Column) -> Column:
    """``part`` starts with ``&``: replace its leading character reference, if it has one."""
    names, values = (F.split(F.lit(joined), "\u0001") for joined in _entity_literals())

    def decoded(ref: Column) -> Column:
        code = F.when(
            ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10).cast("int")
        ).when(ref.startswith("#"), F.substring(ref, 2, 8).try_cast("int"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        text = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for key, char in _COMMON_ENTITIES.items():
            text = text.when(ref == key, F.lit(char))
        text = text.when(
            (ref != "") & ~ref.startswith("#"), F.try_element_at(F.map_from_arrays(names, values), ref)
        )
        return F.coalesce(F.concat(text, F.substring(part, F.length(ref) + 3, F.length(part))), part)

    return let(F.regexp_extract(part, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1), decoded)


def unescape(text: Column) -> Column:
    """Decode HTML character references, each exactly once."""

    def decode(t: Column) -> Column:
        pieces = F.transform(
            F.split(t, "(?=&)"), lambda p: F.when(p.startswith("&"), _decode_reference(p)).otherwise(p)
        )
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return let(text, decode)

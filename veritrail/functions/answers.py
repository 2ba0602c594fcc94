"""Expressions on answers and question texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.text import contains_any, fold, fold_literal, strip, word_count


def normalize_answer(answer: Column) -> Column:
    """One of the three answer values; unknown or missing wording counts as not applicable."""
    return (
        F.when(answer.isin(L.NO_SPELLINGS), F.lit(L.NO))
        .when(answer.isin(L.YES_SPELLINGS), F.lit(L.YES))
        .when(answer.isin(L.ANSWER_VALUES), answer)
        .otherwise(F.lit(L.NOT_APPLICABLE))
    )


def is_match(answer: Column, expected: Column) -> Column:
    """A scored answer that equals the expected one (``Sim`` unless the question says otherwise)."""
    return (answer != L.NOT_APPLICABLE) & (answer == F.coalesce(expected, F.lit(L.YES)))


def answer_score(answer: Column, expected: Column) -> Column:
    return F.when(is_match(answer, expected), F.lit(10.0)).otherwise(F.lit(0.0))


def strip_question_id(text: Column, question_id: Column) -> Column:
    """Question text without its own id in front and the blanks and dots after it."""
    rest = F.substr(text, F.length(question_id) + 1)
    return F.when(F.startswith(text, question_id), F.ltrim(rest, F.lit(" ."))).otherwise(text)


def question_complexity(
    text: Column,
    complex_patterns: list[str] = L.COMPLEX_PATTERNS,
    simple_patterns: list[str] = L.SIMPLE_PATTERNS,
    simple_max_words: int = L.SIMPLE_MAX_WORDS,
) -> Column:
    """``complex`` or ``simple``: complex wording first, then simple wording, then length."""
    folded = fold(text)
    return (
        F.when(contains_any(folded, [fold_literal(p) for p in complex_patterns]), F.lit("complex"))
        .when(contains_any(folded, [fold_literal(p) for p in simple_patterns]), F.lit("simple"))
        .when(word_count(text) <= simple_max_words, F.lit("simple"))
        .otherwise(F.lit("complex"))
    )


def is_generic_source(source: Column, patterns: list[str] = L.GENERIC_SOURCE_PATTERNS) -> Column:
    """True for a source that names no document: missing, blank or boilerplate."""
    bare = F.lower(strip(source))
    return source.isNull() | (bare == "") | contains_any(bare, patterns)


def agent_name(dimension: Column, names: dict[str, str] = L.AGENT_NAMES) -> Column:
    label = F.lit(None).cast("string")
    for key, name in names.items():
        label = F.when(dimension == key, F.lit(name)).otherwise(label)
    return F.coalesce(label, F.lit(L.DEFAULT_AGENT))


def dimension_label(dimension: Column, labels: dict[str, str] = L.DIMENSION_LABELS) -> Column:
    label = dimension
    for key, name in labels.items():
        label = F.when(dimension == key, F.lit(name)).otherwise(label)
    return label

"""Answer replies as JSON text -> one row per answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import SPACE_CHARS, let, strip
from veritrail.operators.keys import unfold_array

ANSWER = (
    "struct<question_id:string,answer:string,justification:string,source_reference:string,"
    "improvement_points:string,confidence_score:string>"
)
WRAPPERS = ["answers", "results", "respostas"]


def _elements(payload: str) -> Column:
    """The reply's answers as JSON texts: null where the text is not JSON."""
    names = ", ".join(f"{name} string" for name in WRAPPERS)

    def inner(body: Column) -> Column:
        wrapped = F.from_json(F.when(body.startswith("{"), body), names)
        return _from_start(let(wrapped, lambda w: F.coalesce(*[w[name] for name in WRAPPERS], body)))

    # what follows a closed array is not read; before the bracket put behind bare objects, blanks have to go
    as_array = let(let(_from_start(F.col(payload)), inner), lambda j: F.when(j.startswith("["), j).otherwise(
        F.concat(F.lit("["), _to_end(j), F.lit("]"))))
    return F.from_json(as_array, "array<string>")


def _from_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def _to_end(text: Column) -> Column:
    """Without blanks at the end. Trimming there measures every character; a text that ends with its object needs none."""
    return F.when(text.endswith("}"), text).otherwise(F.rtrim(text, F.lit(SPACE_CHARS)))


def _is_object(element: Column) -> Column:
    return _from_start(element).startswith("{")


def _has_text(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))


def ingest_answers(replies: DataFrame, keep: Sequence[str], payload: str = "payload") -> DataFrame:
    """Accepts a bare array, an object that wraps the array (or one answer) under a known name, or one answer.

    Text that is not JSON gives no rows. The first wrapper name present counts. Ids and confidences may come as numbers
    or as strings. An object without a question id gives a row that no question takes; it is among the rejected ones.
    """
    # elements are read one by one: one that is no object does not spoil the others
    rows = unfold_array(replies, keep, _elements(payload), "_element", "ordinal").where(_is_object(F.col("_element")))
    answers = rows.select(*keep, "ordinal", F.from_json("_element", ANSWER).alias("_answer")).select(
        *keep, "ordinal", "_answer.*")
    return answers.withColumn("confidence_score", F.col("confidence_score").try_cast("double"))


def rejected_replies(replies: DataFrame, keep: Sequence[str], payload: str = "payload") -> DataFrame:
    """What leads to no answer: whole replies without an object, elements that are none, and objects without a question id."""
    def parts(elements: Column) -> Column:
        """The elements, or the whole reply where none is an object."""
        found = F.exists(elements, lambda e: F.coalesce(_is_object(e), F.lit(False)))
        part = lambda text, whole: F.struct(text.alias("payload"), F.lit(whole).alias("whole"))
        return F.when(F.coalesce(found, F.lit(False)), F.transform(elements, lambda e: part(e, False))).otherwise(
            F.array(part(F.col(payload), True)))

    rows = unfold_array(replies, keep, let(_elements(payload), parts), "_part", "_at").select(*keep, "_part.*")
    is_object = ~F.col("whole") & F.coalesce(_is_object(F.col("payload")), F.lit(False))
    # the id is read as the answers' fields are, and only of objects
    named = _has_text(F.from_json(F.when(is_object, F.col("payload")), ANSWER)["question_id"])
    reason = F.when(F.col("whole"), F.lit("no answer")).when(is_object, F.lit("no question id")).otherwise(F.lit("not an object"))
    return rows.where(~named).select(*keep, reason.alias("reason"), "payload")

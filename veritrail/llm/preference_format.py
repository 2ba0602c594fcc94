"""Preference data from pairs of conversations, in DataFrame functions only.

The chosen and the rejected conversation of a pair are compared turn by turn; the longest run of equal first turns (same
role and text) is rendered once as the prompt, and what follows in each is its completion. A completion's mask lists the
character ranges of assistant content, counted from the start of prompt and completion together: only these are trained on.

Turns are ordered by turn number, then role, then text, nulls first; each row of a repeated turn counts. A null role is
rendered as an empty role, a null text as an empty text, and nulls equal each other in the comparison. Rows with a null
pair key form no pair. A conversation that is missing on one side has no turns there: no shared prefix, an empty
completion. Two equal conversations have everything in the prompt and two empty completions. Other columns of the inputs
are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def turn_lists(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair, turns): every conversation's turns in order."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair")).agg(
        F.sort_array(F.collect_list(one)).alias("turns"))


def shared_turns(one: Column, other: Column) -> Column:
    """How many first turns are equal in role and text."""
    both = F.arrays_zip(F.transform(one, _said).alias("a"), F.transform(other, _said).alias("b"))
    differs = F.transform(both, lambda z: ~z["a"].eqNullSafe(z["b"]))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(F.size(both)).cast("int")


def _said(turn: Column) -> Column:
    return F.struct(turn["role"].alias("role"), turn["text"].alias("text"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def trained_ranges(turns: Column, offset: Column) -> Column:
    """(start, end) of the assistant contents, the end exclusive, each with its closing mark."""
    size = lambda t: F.length(_head(t)) + F.length(t["text"]) + F.lit(len(CLOSE))
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def add(state, t):
        begin = state["at"] + F.length(_head(t))
        one = F.array(F.struct(begin.cast("int").alias("start"), (state["at"] + size(t)).cast("int").alias("end")))
        return F.struct((state["at"] + size(t)).cast("int").alias("at"),
                        F.when(t["role"] == TRAINED, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.aggregate(turns, F.struct(offset.cast("int").alias("at"), nothing.alias("out")), add, lambda s: s["out"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """One row per pair: pair, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    left = turn_lists(chosen, key, turn, role, text).withColumnRenamed("turns", "c")
    right = turn_lists(rejected, key, turn, role, text).withColumnRenamed("turns", "r")
    none = F.array().cast(left.schema["c"].dataType)
    both = left.join(right, "pair", "full").select("pair", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    both = both.withColumn("n", shared_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side) + 1)
    cut = both.select("pair", F.col("n").alias("prompt_turns"), render(F.slice("c", 1, F.col("n"))).alias("prompt"),
                      rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair", "prompt_turns", "prompt", render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        trained_ranges(F.col("c"), F.length("prompt")).alias("chosen_mask"),
        trained_ranges(F.col("r"), F.length("prompt")).alias("rejected_mask"),
    )

"""From incoming answers to one clean answer row per analysis and question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.answers import agent_name, answer_score, is_generic_source, normalize_answer
from veritrail.functions.text import strip
from veritrail.session import written
from veritrail.operators.keys import first_per_key, unfold_array

ANSWER_KEY = ["analysis_id", "question_pk"]
CROWDED = 64  # replies of a batch that are looked through in a row


def keep_first(answers: DataFrame, order: Sequence[str], keys: Sequence[str] = ANSWER_KEY) -> DataFrame:
    """Insert-ignore: the earliest answer of a question stays."""
    return first_per_key(answers, keys, [F.col(c).asc() for c in order])


def keep_last(answers: DataFrame, order: Sequence[str], keys: Sequence[str] = ANSWER_KEY) -> DataFrame:
    """Upsert: the latest answer of a question stays."""
    return first_per_key(answers, keys, [F.col(c).desc() for c in order])


def normalize(answers: DataFrame) -> DataFrame:
    return answers.withColumn("answer", normalize_answer(F.col("answer")))


def _id_key(column: Column) -> Column:
    return F.lower(strip(column))


def _mark(key: Column) -> Column:
    """Which of 64 bits stands for an id."""
    return F.pmod(F.xxhash64(key), F.lit(64)).cast("int")


def marks(key: Column) -> Column:
    """The bits of all ids of a group, as one number: a part whose bit is not set is none of them."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _mark(key)))


def _cuts(text: Column, lengths: Column, marked: Column) -> Column:
    """The distinct parts of ``text`` that have one of the ``lengths`` and a bit of ``marked``."""
    parts = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(lengths, lambda n: n <= F.length(text)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)
                ),
            )
        )
    )
    return F.filter(parts, lambda part: F.call_function("shiftright", marked, _mark(part)).bitwiseAND(F.lit(1)) == 1)


def match_answers(questions: DataFrame, answers: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Give every question of a batch its answer: equal id first, else containment.

    ``questions`` carries ``batch`` columns and ``question_id``; ``answers`` carries
    them too, plus ``ordinal`` (its place among all replies of the batch: a number or a struct
    that orders them; ties go to the smaller id) and an ``answer_row`` payload. Ids are compared trimmed and in lower case. Of answers with
    one id the last counts, at the place of the first. A question without an equal id
    takes the earliest answer whose id contains its id or lies inside it; a blank answer
    id matches nothing.

    The replies are written once. Those of a batch come to its questions in one row, so they and the questions
    are shuffled once each. Batches with more than ``CROWDED`` replies are counted first and take the joins of
    ``_match_crowded`` instead, so no row and no task holds a whole crowd.
    """
    batch = list(batch)
    keyed = answers.withColumn("_key", _id_key(F.col("question_id"))).where(F.col("_key") != "")
    replies = written(keyed.select(*batch, "_key", "ordinal", "answer_row"), "replies")
    wanted = questions.withColumn("_key", _id_key(F.col("question_id")))
    crowded = _crowded(replies, batch)
    if crowded is None:
        return _match_gathered(wanted, replies, batch)
    rest = [_match_gathered(*[side.join(crowded, batch, "left_anti") for side in (wanted, replies)], batch),
            _match_crowded(*[side.join(crowded, batch, "left_semi") for side in (wanted, replies)], batch)]
    return rest[0].unionByName(rest[1])


def _crowded(replies: DataFrame, batch: list[str]) -> DataFrame | None:
    """The batches with more than ``CROWDED`` replies; none where there is none.

    They are counted by a short hash, the narrowest rows there are; batches that share one may be counted as crowded, which costs
    joins and changes no result.
    """
    counted = replies.select(*batch, F.hash(*batch).alias("_hash"))
    hashes = written(counted.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select("_hash"), "crowded")
    if hashes.isEmpty():
        return None
    return written(counted.join(hashes, "_hash", "left_semi").select(*batch).distinct(), "crowded-batches")


def _match_gathered(wanted: DataFrame, replies: DataFrame, batch: list[str]) -> DataFrame:
    """The match where a batch's replies fit in a row: every question looks through them."""
    reply = F.struct("_key", "ordinal", "answer_row")
    # dealt before they are gathered: gathering in the tasks that read them would only make them larger
    gathered = replies.repartition(*batch).groupBy(*batch).agg(F.collect_list(reply).alias("_replies"))
    key, all_replies = F.col("_key"), F.col("_replies")
    near = F.filter(all_replies, lambda r: F.contains(r["_key"], key) | F.contains(key, r["_key"]))
    first = F.array_min(F.transform(near, lambda r: F.struct(r["ordinal"].alias("ordinal"), r["_key"].alias("_key"))))["_key"]
    found = F.when(F.exists(all_replies, lambda r: r["_key"] == key), key).otherwise(F.when(key != "", first))
    same = F.filter(all_replies, lambda r: r["_key"] == F.col("_found"))
    latest = F.array_max(F.transform(same, lambda r: F.struct(r["ordinal"].alias("ordinal"), r["answer_row"].alias("answer_row"))))
    kind = F.when(F.col("_found") == key, F.lit("exact")).otherwise(F.lit("contained"))
    return (
        wanted.join(gathered, batch, "left")
        .withColumn("_found", found)
        .withColumn("answer_row", latest["answer_row"])
        .withColumn("match", F.when(F.col("answer_row").isNotNull(), kind).otherwise(F.lit("none")))
        .select(*[c for c in wanted.columns if c != "_key"], "match", "answer_row")
    )


def _match_crowded(wanted: DataFrame, answers: DataFrame, batch: list[str]) -> DataFrame:
    """The match by joins, for batches of any size.

    Containment is an equi-join on parts of the ids, and only of the lengths that occur
    on the other side of the batch: no pair of rows is formed that is not a match. Parts
    whose bit no id of the other side has are left out first; in the largest batches the
    join alone decides. Parts of answer ids are reduced to the earliest place before they are shuffled. The
    payloads stay out of it; the places found fetch them at the end. The replies, read
    five times here, are written once.
    """
    replies = written(
        answers.groupBy(*batch, "_key").agg(
            F.min("ordinal").alias("_place"), F.max(F.struct("ordinal", "answer_row"))["answer_row"].alias("answer_row")
        ),
        "crowded-replies",
    )
    # an answer is known by its key; the place only says which comes first
    places = replies.select(*batch, "_key", F.struct("_place", "_key").alias("_place"))
    exact = wanted.join(replies.withColumnRenamed("answer_row", "_exact").drop("_place"), [*batch, "_key"], "left")

    unanswered = wanted.where(F.col("_key") != "").select(*batch, "_key").distinct()
    unanswered = unanswered.join(places, [*batch, "_key"], "left_anti")
    sizes = [F.collect_set(F.length("_key")).alias("_lengths"), marks(F.col("_key")).alias("_marks")]
    around = (
        unfold_array(
            places.join(unanswered.groupBy(*batch).agg(*sizes), batch),
            [*batch, "_place"], _cuts(F.col("_key"), F.col("_lengths"), F.col("_marks")), "_cut",
        )
        .groupBy(*batch, F.col("_cut").alias("_key"))
        .agg(F.min("_place").alias("_place"))
        .join(unanswered, [*batch, "_key"], "left_semi")
    )
    inside = (
        unfold_array(
            unanswered.join(places.groupBy(*batch).agg(*sizes), batch),
            [*batch, "_key"], _cuts(F.col("_key"), F.col("_lengths"), F.col("_marks")), "_cut",
        )
        .join(places.withColumnRenamed("_key", "_cut"), [*batch, "_cut"])
        .select(*batch, "_key", "_place")
    )
    loose = (
        around.unionByName(inside)
        .groupBy(*batch, "_key")
        .agg(F.min("_place").alias("_place"))
        .select(*batch, "_key", F.col("_place._key").alias("_found"))
        .join(replies.select(*batch, F.col("_key").alias("_found"), F.col("answer_row").alias("_loose")), [*batch, "_found"])
        .drop("_found")
    )
    match = F.when(F.col("_exact").isNotNull(), F.lit("exact")).when(F.col("_loose").isNotNull(), F.lit("contained"))
    return (
        exact.join(loose, [*batch, "_key"], "left")
        .withColumn("match", match.otherwise(F.lit("none")))
        .withColumn("answer_row", F.coalesce("_exact", "_loose"))
        .select(*[c for c in wanted.columns if c != "_key"], "match", "answer_row")
    )


def fill_answers(questions: DataFrame, answers: DataFrame, keys: Sequence[str] = ANSWER_KEY) -> DataFrame:
    """Every asked question gets an answer; the missing ones get the not-applicable default.

    Both sides are fact tables; the texts of the answers make size estimates too low, hence the merge join.
    """
    joined = questions.join(answers.withColumn("_given", F.lit(True)).hint("merge"), list(keys), "left")
    texts = ["answer", "justification", "source_reference", "improvement_points", "confidence_score"]
    return with_defaults(joined.select(*questions.columns, "_given", *texts))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows with the answer columns and ``_given``: where that is not true, the not-applicable default.

    An answer that came without a value keeps its texts and confidence; only the value is the default.
    """
    found = F.coalesce("_given", F.lit(False))
    texts = ["answer", "justification", "source_reference", "improvement_points", "confidence_score"]
    return rows.select(
        *[c for c in rows.columns if c not in (*texts, "_given")],
        F.coalesce("answer", F.lit(L.NOT_APPLICABLE)).alias("answer"),
        F.when(found, F.col("justification")).otherwise(F.lit(L.DEFAULT_JUSTIFICATION)).alias("justification"),
        F.when(found, F.col("source_reference")).alias("source_reference"),
        F.when(found, F.col("improvement_points")).alias("improvement_points"),
        F.when(found, F.col("confidence_score")).otherwise(F.lit(0.0)).alias("confidence_score"),
    )


def backfill_source(answers: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace generic sources by the one derived from the retrieved chunks (``derived_source``)."""
    derived = F.coalesce(F.col("derived_source"), F.lit(L.DEFAULT_SOURCE))
    return (
        answers.join(sources, list(keys), "left")
        .withColumn(
            "source_reference",
            F.when(is_generic_source(F.col("source_reference")), derived).otherwise(F.col("source_reference")),
        )
        .drop("derived_source")
    )


def answer_records(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """The stored form: normalised value, cut texts, confidence in [0, 1], agent label, score.

    Texts are cut before they are shuffled. The questions, one short row each, are looked up in a hash table per partition:
    a merge join would sort the texts, which unpack to many times the size by which Spark joins small partitions.
    """
    cut = normalize(answers).select(
        "analysis_id",
        "question_pk",
        "answer",
        F.substring(F.coalesce("justification", F.lit("")), 1, L.JUSTIFICATION_CHARS).alias("justification"),
        F.nullif(F.substring("source_reference", 1, L.SOURCE_CHARS), F.lit("")).alias("source_reference"),
        F.nullif(F.substring("improvement_points", 1, L.IMPROVEMENT_CHARS), F.lit("")).alias("improvement_points"),
        F.least(F.greatest(F.coalesce("confidence_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence_score"),
    )
    known = questions.select("question_pk", "expected_answer", "dimension").hint("shuffle_hash")
    score = answer_score(F.col("answer"), F.col("expected_answer"))
    return cut.join(known, "question_pk").select(
        "analysis_id",
        *[c for c in cut.columns if c != "analysis_id"],
        agent_name(F.col("dimension")).alias("agent_name"),
        score.alias("score"),
        score.alias("weighted_score"),
    )


def remaining_questions(asked: DataFrame, answers: DataFrame, keys: Sequence[str] = ANSWER_KEY) -> DataFrame:
    """Questions a resumed analysis still has to ask."""
    return asked.join(answers.select(*keys), list(keys), "left_anti")


def apply_conditional(answers: DataFrame, scope: Sequence[str] = ("analysis_id",)) -> DataFrame:
    """A sub-question X.Y.Z.W of a question X.Y.Z answered ``Não`` becomes not applicable."""
    scope = list(scope)
    refused = (
        answers.where(F.col("answer") == L.NO)
        .select(*scope, F.col("question_id").alias("_parent"))
        .distinct()
        .withColumn("_refused", F.lit(True))
    )
    parent = F.when(
        F.regexp_count("question_id", F.lit(r"\.")) >= 3, F.regexp_replace("question_id", r"\.\d+$", "")
    )
    return (
        answers.withColumn("_parent", parent)
        .join(refused, [*scope, "_parent"], "left")
        .withColumn("answer", F.when(F.col("_refused"), F.lit(L.NOT_APPLICABLE)).otherwise(F.col("answer")))
        .drop("_parent", "_refused")
    )

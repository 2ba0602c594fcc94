"""The registered queries of the training-data operators, and their SQL where there is one.

Each takes ``(spark, sf_dir)``, applies its operator with production parameters to the whole table, and derives the
digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import byte_bpe, differencing, document_tree, language_id, line_labels, lm_scoring, minmax_dedup, one_bit_codes, periodic_runs, preference_format, secret_grammar, spaced_seeds, window_dedup
from veritrail.functions.text import let
from veritrail.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = byte_bpe.decode(byte_bpe.encode(docs).select("doc_id", "ids"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def _joined(spans: str):
    """kind:start:end of all spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


@query("op4_secret_grammar")
def op4_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_grammar.find_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secret_grammar.KINDS],
        F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~language_id.held_out())
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


# The table has no rejected answers: a conversation's rejected twin has the last assistant turn of its neighbour
# (2k and 2k + 1) in place of its own, so all turns before that one are shared.
OP2_SQL = """
WITH last_turn AS (
  SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
answer AS (
  SELECT c.conv_id, c.turn, c.text FROM conversations c JOIN last_turn l ON l.conv_id = c.conv_id AND l.turn = c.turn),
twin AS (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN l.turn = c.turn THEN coalesce(n.text, '') ELSE c.text END AS text
  FROM conversations c LEFT JOIN last_turn l ON l.conv_id = c.conv_id AND l.turn = c.turn
  LEFT JOIN answer n ON n.conv_id = CASE WHEN c.conv_id % 2 = 0 THEN c.conv_id + 1 ELSE c.conv_id - 1 END AND l.turn IS NOT NULL),
both_sides AS (
  SELECT 'c' AS side, conv_id AS pair, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT 'r', conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM twin),
first_other AS (
  SELECT pair, min(turn) AS turn FROM (
    SELECT pair, turn FROM both_sides GROUP BY pair, turn
    HAVING count(*) <> 2 OR min(role) <> max(role) OR min(text) <> max(text)) GROUP BY pair),
rendered AS (
  SELECT b.side, b.pair, b.turn, b.role, f.turn IS NULL OR b.turn < f.turn AS shared,
         '<|' || b.role || '|>' || chr(10) || b.text || '<|end|>' || chr(10) AS piece, length(b.role) + 5 AS head
  FROM both_sides b LEFT JOIN first_other f ON f.pair = b.pair),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY side, pair ORDER BY turn
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM rendered)
SELECT pair,
       CAST(count(*) FILTER (WHERE shared AND side = 'c') AS INT) AS prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE shared AND side = 'c'), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE NOT shared AND side = 'c'), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE NOT shared AND side = 'r'), '') AS rejected,
       coalesce(string_agg(CAST(place + head AS BIGINT) || ':' || CAST(place + length(piece) AS BIGINT), ',' ORDER BY turn)
                FILTER (WHERE NOT shared AND side = 'c' AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(place + head AS BIGINT) || ':' || CAST(place + length(piece) AS BIGINT), ',' ORDER BY turn)
                FILTER (WHERE NOT shared AND side = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM placed WHERE pair IS NOT NULL GROUP BY pair"""


@query("op2_preference_format", OP2_SQL)
def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("answer"))
    neighbour = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1)
    swap = answers.select("conv_id", F.col("answer.turn").alias("turn"), neighbour.alias("from")).join(
        answers.select(F.col("conv_id").alias("from"), F.col("answer.text").alias("other")), "from", "left").select(
        "conv_id", "turn", F.coalesce("other", F.lit("")).alias("other"))
    twin = turns.join(swap, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.coalesce("other", "text").alias("text"))
    pairs = preference_format.format_preferences(turns, twin, key="conv_id")
    ranges = lambda c: F.concat_ws(",", F.transform(c, lambda r: F.concat_ws(":", r["start"], r["end"])))
    return pairs.withColumns({c: ranges(c) for c in ("chosen_mask", "rejected_mask")})


@query("op8_one_bit_codes")
def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return one_bit_codes.search(vectors, F.col("vec_id") % 50 == 0)


@query("op10_differencing")
def op10_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = differencing.shard_rows(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op7_spaced_seeds")
def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    return spaced_seeds.find_overlaps(documents(spark, sf_dir).select("doc_id", "text"), benchmark)


OP5_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r),
lowest AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(r, t.doc_id) AS component_id, t.doc_id = coalesce(r, t.doc_id) AS kept
FROM texts t LEFT JOIN sizes z ON z.doc_id = t.doc_id LEFT JOIN lowest l ON l.d = t.doc_id"""


@query("op5_minmax_dedup", OP5_SQL)
def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.classes(documents(spark, sf_dir).select("doc_id", "text"))


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, sf_dir).select("doc_id", "text"), ~lm_scoring.held_out(), lm_scoring.deleted())


# Repeated starts at most 100 apart form one removed run.
OP3_SQL = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, octet_length(h) - 99)) AS i, h FROM raw),
strings AS (SELECT doc_id, i, md5(hex(array_slice(h, i + 1, i + 100))) AS s FROM starts),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM strings) WHERE n > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM late)),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY 1, 2),
placed AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last,
               string_agg(CASE WHEN a > before THEN hex(array_slice(h, before + 1, a)) ELSE '' END, '' ORDER BY a) AS kept
        FROM placed JOIN raw USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || CASE WHEN coalesce(last, 0) < octet_length(h)
                                               THEN hex(array_slice(h, coalesce(last, 0) + 1, octet_length(h))) ELSE '' END)) AS kept_sha256
FROM raw LEFT JOIN cut USING (doc_id)"""


@query("op3_window_dedup", OP3_SQL)
def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = window_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


# crc32 by its definition; pairs of equal words q apart form a stretch as long as their places are consecutive.
OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
      lambda c, d: list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)) AS h FROM documents),
placed AS (SELECT *, len(w) AS n, (h // 10) AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts),
changed AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1]
         ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM placed),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM changed),
equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= 24 AND length >= 3 * q GROUP BY 1, 2, 3),
counted AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY 1),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM texts t LEFT JOIN counted USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """A tenth of the documents (by hash of the id) with a suffix that repeats its first words, as op13's rows ask for."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        a = F.pmod(g, F.size(w))
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(w, lambda x, i: F.when(
            i < v["a"], x).otherwise(F.get(w, (v["a"] + (i - v["a"]) % v["p"]).cast("int")))), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(words, repeated)).otherwise(F.col("text")))


@query("op13_periodic_runs", OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_repeats(documents(spark, sf_dir).select("doc_id", "text")))
    # greatest length / period by exact products, then the smallest start, then period
    better = lambda a, b: F.when(a["length"] * b["period"] >= b["length"] * a["period"], a).otherwise(b)
    first = F.get("runs", F.lit(0))
    best = F.when(F.size("runs") > 0, F.aggregate("runs", first, better))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP11_SQL = r"""
WITH texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
listed AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM texts),
terms AS (SELECT side, id, unnest(t) AS term FROM listed),
docs AS (SELECT id, len(t) AS n FROM listed WHERE side = 0 AND len(t) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
asked AS (SELECT id AS item_id, term, count(*) AS times FROM terms WHERE side = 1 GROUP BY 1, 2),
tf AS (SELECT id AS doc_id, term, count(*) AS tf FROM terms WHERE side = 0 AND term IN (SELECT term FROM asked) GROUP BY 1, 2),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY 1),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN docs ON docs.id = doc_id, whole GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""


@query("op11_document_tree", OP11_SQL)
def op11_document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    return document_tree.rank_documents(documents(spark, sf_dir).select("doc_id", "text"), benchmark)


@query("op12_line_labels")
def op12_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = line_labels.fit(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality"))
    return line_labels.label_lines(docs, field).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")

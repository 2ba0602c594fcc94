"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows the one before kept, and gives the columns of its input;
the last adds the ids. Stages are deterministic, and repeated rows, nulls and empty texts are treated as their operators
state. Extra columns pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm import byte_bpe, language_id, minmax_dedup, secret_grammar, spaced_seeds
from veritrail.session import Job

LEAST_LANGUAGE_SCORE = 0.5
READ = ["doc_id", "text"]
OUTPUTS = ["ids", "n_tokens", "same_bytes"]


def _packed(docs: DataFrame) -> DataFrame:
    """Key and text, and the rest of the row as one column, so that no name of the operators meets one of the table's;
    the text is carried once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in READ]).alias("own"), *READ)


def _columns(like: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``like`` out of a packed row, some of them changed."""
    packed = {c: F.col(c) if c in READ else F.col(f"own.`{c}`") for c in like.columns}
    return [column.alias(c) for c, column in (packed | changed).items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is not certain enough go: no letters, or no language with half of the weight."""
    model = language_id.fit(docs, ~language_id.held_out())
    told = language_id.predict(_packed(docs), model)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return told.where(sure).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the smallest id stays; texts without a word all stay."""
    keyed = _packed(docs).withColumn("row", F.struct("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")))
    found = minmax_dedup.classes(keyed.select("row", "text"), key="row")
    stay = found.where("kept").select(F.col("row").alias("stay"), (F.col("n_shingles") == 0).alias("empty")).distinct()
    first = F.row_number().over(Window.partitionBy("row").orderBy(F.lit(1)))
    kept = keyed.join(stay, F.col("row").eqNullSafe(F.col("stay"))).select("own", *READ, "row", "empty")
    return kept.withColumn("copy", first).where("empty OR copy = 1").select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    return spaced_seeds.keep_clean(docs, benchmark)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and the number of characters follows; all documents stay."""
    masked = secret_grammar.redact(secret_grammar.find_secrets(_packed(docs)))
    size = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("own.n_chars"))
    return masked.select(*_columns(docs, n_chars=size))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, their number, and whether they decode to the same bytes."""
    coded = byte_bpe.decode(byte_bpe.encode(_packed(docs)))
    same = F.col("raw") == F.coalesce("text", F.lit("")).cast("binary")
    kept = _columns(docs.drop(*OUTPUTS))
    return coded.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("same_bytes"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("tokens", tokens),
]

ORACLE_SQL = None  # merged automata, hashed bands and byte-pair merges have no SQL form; tested against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of ``documents``; each stage's result is written and read again."""
    job = Job(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = job.keep(stage(spark, docs, sf_dir), name)
        if before:
            job.drop(before)
        before = name
    return docs

"""Text -> paragraph-aligned chunks, chunk statistics and the embedding backlog.

One document is one row, so chunking needs no shuffle. The packing is a fold over the
paragraph word counts; it notes only where chunks begin and end, and the texts are
joined from those ranges afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.numbers import exact_round
from veritrail.functions.text import SPACE, let, non_empty, word_count
from veritrail.operators.keys import ordered_number, unfold_array

_BLANK_LINE = rf"\n[{SPACE}]*\n"
_SENTENCE_END = rf"(?<=[.!?])[{SPACE}]+"


def _blocks(text: Column) -> Column:
    """Parts between blank lines; a single part with line breaks falls apart into its lines."""

    def finer(parts: Column) -> Column:
        single = (F.size(parts) <= 1) & F.contains(text, F.lit("\n"))
        return F.when(single, non_empty(F.split(text, "\n"))).otherwise(parts)

    return let(non_empty(F.split(text, _BLANK_LINE)), finer)


def text_paragraphs(text: Column, max_words: int) -> Column:
    """Paragraphs of a text without pages; a long single paragraph falls apart into sentences."""

    def finer(parts: Column) -> Column:
        long = (F.size(parts) <= 1) & (F.length(text) > max_words * L.SENTENCE_SPLIT_FACTOR)
        return F.when(long, non_empty(F.split(text, _SENTENCE_END))).otherwise(parts)

    paragraph = lambda p: F.struct(p.alias("text"), F.lit(0).alias("page"))
    return F.transform(let(_blocks(text), finer), paragraph)


def page_paragraphs(pages: Column) -> Column:
    """Paragraphs of ``array<struct<page, text>>``, each with its page."""
    return F.flatten(
        F.transform(
            pages,
            lambda page: F.transform(
                _blocks(page["text"]), lambda p: F.struct(p.alias("text"), page["page"].cast("int").alias("page"))
            ),
        )
    )


_RANGES = "array<struct<first:int,fresh:int,last:int,words:int>>"


def _ranges(counts: Column, max_words: int, overlap: bool) -> Column:
    """Greedy packing. A chunk that would pass ``max_words`` is closed; with ``overlap`` the
    next one begins with its last paragraph. ``fresh`` is the first paragraph not carried over."""
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("fresh"), F.lit(0).alias("words"),
        F.lit(0).alias("previous"), F.array().cast(_RANGES).alias("done"),
    )

    def closed(acc: Column) -> Column:
        return F.struct(acc["first"].alias("first"), acc["fresh"].alias("fresh"),
                        (acc["i"] - 1).alias("last"), acc["words"].alias("words"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["words"] + n > max_words) & (acc["first"] < acc["i"])
        carried_first = acc["i"] - 1 if overlap else acc["i"]
        carried_words = acc["previous"] if overlap else F.lit(0)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, carried_first).otherwise(acc["first"]).alias("first"),
            F.when(full, acc["i"]).otherwise(acc["fresh"]).alias("fresh"),
            (F.when(full, carried_words).otherwise(acc["words"]) + n).alias("words"),
            n.alias("previous"),
            F.when(full, F.concat(acc["done"], F.array(closed(acc)))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["i"] > 0, F.concat(acc["done"], F.array(closed(acc)))).otherwise(acc["done"])

    return F.aggregate(counts, start, step, finish)


def _chunks(paragraphs: Column, max_words: int, overlap: bool) -> Column:
    def build(parts: Column) -> Column:
        texts = F.transform(parts, lambda p: p["text"])

        def one(r: Column) -> Column:
            fresh = F.slice(parts, r["fresh"] + 1, r["last"] - r["fresh"] + 1)
            pages = F.array_sort(F.array_distinct(F.filter(F.transform(fresh, lambda p: p["page"]), lambda n: n > 0)))
            own = F.slice(parts, r["first"] + 1, r["last"] - r["first"] + 1)
            content = F.array_join(F.transform(own, lambda p: p["text"]), "\n\n")
            return F.struct(
                content.alias("content"),
                r["words"].alias("token_count"),
                F.array_min(pages).alias("page_number"),
                F.when(F.size(pages) > 0, pages).alias("page_range"),
            )

        return F.transform(_ranges(F.transform(texts, word_count), max_words, overlap), one)

    return let(paragraphs, build)


def _explode(documents: DataFrame, chunks: Column, keep: Sequence[str]) -> DataFrame:
    exploded = unfold_array(documents, keep, chunks, "_chunk", "chunk_index")
    return exploded.select(*keep, "chunk_index", "_chunk.*")


def chunk_texts(documents: DataFrame, keep: Sequence[str], text: str = "text",
                max_words: int = L.CHUNK_WORDS, overlap: bool = True) -> DataFrame:
    """Chunks of documents that have one text and no pages."""
    return _explode(documents, _chunks(text_paragraphs(F.col(text), max_words), max_words, overlap), keep)


def chunk_pages(documents: DataFrame, keep: Sequence[str], pages: str = "pages",
                max_words: int = L.CHUNK_WORDS, overlap: bool = True) -> DataFrame:
    """Chunks of documents with page texts. A chunk's pages are those of its new paragraphs;
    a paragraph carried over from the chunk before does not bring its page along."""
    return _explode(documents, _chunks(page_paragraphs(F.col(pages)), max_words, overlap), keep)


def chunk_stats(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of chunks and total, mean and largest word count per document."""
    totals = chunks.groupBy(*keys).agg(
        F.count("*").alias("chunk_count"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("max_tokens")
    )
    return totals.withColumn("avg_tokens", F.col("tokens") / F.col("chunk_count")).withColumn(
        "avg_tokens", exact_round(F.col("avg_tokens"), 0).cast("long")
    )


def embedding_backlog(chunks: DataFrame) -> DataFrame:
    """Chunks without a vector in chunk order, cut to the model's input length, in numbered batches.

    Numbering runs over the whole backlog by (chunk_index, doc_id), in ranges of that order; ids may be of any type.
    """
    open_chunks = chunks.where(F.col("embedding").isNull()).select(
        "doc_id", "chunk_index", F.substring("content", 1, L.EMBEDDING_CHARS).alias("input"))
    numbered = ordered_number(open_chunks, [F.col("chunk_index"), F.col("doc_id")], "position", purpose="backlog")
    total = numbered.select(F.ceil(F.count("*") / L.EMBEDDING_BATCH)).scalar()
    batch = F.floor((F.col("position") - 1) / L.EMBEDDING_BATCH) + 1
    return numbered.select("doc_id", "chunk_index", "input", batch.alias("batch"), total.alias("batches"))


def document_batches(chunks: DataFrame) -> DataFrame:
    """The open chunks of every document in batches of its own, as they are embedded right after it was stored."""
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    count = F.count("*").over(Window.partitionBy("doc_id"))
    return chunks.where(F.col("embedding").isNull()).select(
        "doc_id", "chunk_index", F.substring("content", 1, L.EMBEDDING_CHARS).alias("input"),
        (F.floor((position - 1) / L.EMBEDDING_BATCH) + 1).alias("batch"), F.ceil(count / L.EMBEDDING_BATCH).alias("batches"))


def embedding_coverage(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("embedding").alias("embedded"), F.count("*").alias("chunks"))

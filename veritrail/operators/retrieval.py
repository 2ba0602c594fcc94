"""Finding the chunks that speak to a query: cosine, keyword and hybrid top-k.

Queries are the questionnaire's themes, chunks are the corpus. The chunks never move: queries
are taken in blocks of bounded bytes, each sent to all tasks, where every task scores its own
chunks and passes on at most k rows per query and batch; the final rank merges the blocks.
One block is the ordinary case of the same code, and the result does not depend on the blocks.

``scope`` names chunk columns (company, year) inside which the search runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail import lookups as L
from veritrail.functions.answers import strip_question_id
from veritrail.functions.text import words
from veritrail.operators.keys import top_per_key, unfold_array
from veritrail.operators.vectors import by_dimension, comparable
from veritrail.session import ship_package

BLOCK_BYTES = 8 << 20  # of query vectors or words that go to the tasks at once
CELLS_PER_STEP = 4_000_000
COUNTED_CHARS = 1 << 20  # of texts in which words are looked up at once


def _blocks(queries: DataFrame, size: Column, block_bytes: int) -> Iterator[pd.DataFrame]:
    """The rows of ``queries`` in blocks of about ``block_bytes``; all rows of a query are in one."""
    total = queries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for i in range(blocks):
        yield queries.where(number == i).toPandas()


def best_rows(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of every group: higher score first, then lower tie."""
    order = np.lexsort((tie, -score, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    sizes = np.diff(np.r_[starts, len(order)])
    return order[np.arange(len(order)) - np.repeat(starts, sizes) < k]


def _pick(pdf: pd.DataFrame, scope: list[str], keys: list[str], row: np.ndarray, query: np.ndarray,
          score: np.ndarray, query_ids: list, k: int) -> pd.DataFrame:
    """The k best (row, query) pairs per scope and query of one batch, as rows to pass on."""
    place = pdf.groupby(scope, dropna=False, sort=False).ngroup().to_numpy() if scope else np.zeros(len(pdf), int)
    tie = np.empty(len(pdf), int)
    tie[pdf[keys].reset_index(drop=True).sort_values(keys).index.to_numpy()] = np.arange(len(pdf))
    kept = best_rows(place[row] * len(query_ids) + query, score, tie[row], k)
    out = pdf[scope + keys].iloc[row[kept]].reset_index(drop=True)
    out["query_id"] = [query_ids[i] for i in query[kept]]
    out["score"] = score[kept]
    return out


def _result_schema(chunks: DataFrame, columns: Sequence[str], queries: DataFrame, score: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    query_type = queries.schema["query_id"].dataType.simpleString()
    return ", ".join([f"`{c}` {types[c]}" for c in columns] + [f"query_id {query_type}", f"score {score}"])


def _cosine_hits(pdf: pd.DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], query_ids: list, scope: list[str],
                 keys: list[str], k: int, threshold: float) -> Iterator[pd.DataFrame]:
    step = max(1, CELLS_PER_STEP // max(1, len(query_ids)))
    for start in range(0, len(pdf), step):
        part = pdf.iloc[start : start + step]
        for dimension, (place, rows) in by_dimension(part["embedding"]).items():
            if dimension in queries:
                asked, matrix = queries[dimension]
                similarity = np.round(rows @ matrix.T, 9)
                row, query = np.nonzero(similarity >= threshold)
                if len(row):
                    yield _pick(part, scope, keys, place[row], asked[query], similarity[row, query], query_ids, k)


def vector_topk(chunks: DataFrame, queries: DataFrame, keys: Sequence[str], scope: Sequence[str] = (),
                k: int = L.SEARCH_DEPTH, threshold: float = L.SIMILARITY_THRESHOLD,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cosine top-k: ``queries(query_id, embedding)`` against ``chunks(*scope, *keys, embedding)``.

    Similarity is rounded to nine digits; equal ones rank by ``keys``. A query is compared with the vectors of its own
    dimension; null and empty vectors and those with null or non-finite components take no part.
    """
    scope, keys = list(scope), list(keys)
    ship_package(chunks.sparkSession)
    known = chunks.where(comparable("embedding")).select(*scope, *keys, "embedding")
    asked = queries.where(comparable("embedding")).select("query_id", "embedding")
    schema = _result_schema(chunks, scope + keys, queries, "double")
    hits = None
    for block in _blocks(asked, F.size("embedding") * 8, block_bytes):
        query_ids = block["query_id"].tolist()
        matrices = chunks.sparkSession.sparkContext.broadcast(by_dimension(block["embedding"]))

        def score(batches: Iterator[pd.DataFrame], matrices=matrices, query_ids=query_ids) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf) and query_ids:
                    yield from _cosine_hits(pdf, matrices.value, query_ids, scope, keys, k, threshold)

        found = known.mapInPandas(score, schema)
        hits = found if hits is None else hits.unionByName(found)
    return top_per_key(hits, [*scope, "query_id"], [F.desc("score"), *[F.col(c) for c in keys]], k)


def query_terms(queries: DataFrame, stop_words: list[str] = L.STOP_WORDS) -> DataFrame:
    """Distinct search words of every query: lower case, longer than three letters, no stop words."""
    terms = F.array_distinct(
        F.filter(words(F.lower("text")), lambda w: (F.length(w) > 3) & ~w.isin(stop_words))
    )
    return unfold_array(queries, ["query_id"], terms, "word").drop("_position")


class _TermIndex:
    """Which query words occur inside texts.

    A word has no whitespace, so it occurs in a text exactly when it occurs in one of the
    text's tokens. What a token contains is looked up once and remembered.
    """

    def __init__(self, terms: pd.DataFrame):
        self.query_ids = list(dict.fromkeys(terms["query_id"]))
        position = {q: i for i, q in enumerate(self.query_ids)}
        self.words: dict[str, int] = {}
        queries_of: list[list[int]] = []
        for query, word in zip(terms["query_id"], terms["word"]):
            if word not in self.words:
                self.words[word] = len(queries_of)
                queries_of.append([])
            queries_of[self.words[word]].append(position[query])
        self.sizes = np.array([len(q) for q in queries_of], int)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.queries = np.array([q for of in queries_of for q in of], int)
        self.lengths = sorted({len(w) for w in self.words})
        self.seen: dict[str, tuple[int, ...]] = {}

    def inside(self, token: str) -> tuple[int, ...]:
        found = self.seen.get(token)
        if found is None:
            size = len(token)
            found = tuple({
                self.words[token[i : i + n]] for n in self.lengths if n <= size for i in range(size - n + 1)
                if token[i : i + n] in self.words
            })
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[token] = found
        return found

    def counts(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, query, how many of the query's words the text has) where there are any.

        Texts are taken some at a time: what is found, with repeats, is far more than what is counted."""
        part = np.cumsum(texts.str.len().to_numpy(np.int64)) // COUNTED_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        found = [self._counts(texts.iloc[start:end], start) for start, end in zip(cuts, cuts[1:])]
        return tuple(np.concatenate(column) for column in zip(*found))

    def _counts(self, texts: pd.Series, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``counts`` of texts numbered from ``start``."""
        having: list[tuple[int, ...]] = []
        tokens: list[int] = []
        for text in texts:
            own = set(text.split())
            having += map(self.inside, own)
            tokens.append(len(own))
        sizes = np.fromiter(map(len, having), np.int64, len(having))
        word = np.fromiter(chain.from_iterable(having), np.int64, sizes.sum())
        row = np.repeat(np.repeat(np.arange(start, start + len(texts)), tokens), sizes)
        pair = np.unique(row * max(1, len(self.words)) + word)
        text, word = pair // max(1, len(self.words)), pair % max(1, len(self.words))
        times = self.sizes[word]
        entry = np.repeat(self.first[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        cell, score = np.unique(np.repeat(text, times) * len(self.query_ids) + self.queries[entry], return_counts=True)
        return (cell // len(self.query_ids)).astype("int32"), (cell % len(self.query_ids)).astype("int32"), score.astype("int32")


def keyword_topk(chunks: DataFrame, queries: DataFrame, keys: Sequence[str], scope: Sequence[str] = (),
                 k: int = L.SEARCH_DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Keyword top-k: the score is the number of a query's words that occur in the chunk.

    ``queries(query_id, text)`` against ``chunks(*scope, *keys, content)``; chunks without
    any word do not count, equal scores rank by ``keys``.
    """
    scope, keys = list(scope), list(keys)
    ship_package(chunks.sparkSession)
    lowered = chunks.select(*scope, *keys, F.lower("content").alias("content")).where(F.col("content").isNotNull())
    schema = _result_schema(chunks, scope + keys, queries, "int")
    hits = None
    for block in _blocks(query_terms(queries), F.octet_length("word") + 16, block_bytes):
        index = chunks.sparkSession.sparkContext.broadcast(_TermIndex(block))

        def score(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            found = index.value
            for pdf in batches:
                if len(pdf) and found.query_ids:
                    row, query, counts = found.counts(pdf["content"])
                    if len(row):
                        yield _pick(pdf, scope, keys, row, query, counts, found.query_ids, k)

        part = lowered.mapInPandas(score, schema)
        hits = part if hits is None else hits.unionByName(part)
    return top_per_key(hits, [*scope, "query_id"], [F.desc("score"), *[F.col(c) for c in keys]], k)


def hybrid_topk(vector_hits: DataFrame, keyword_hits: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Vector hits, and keyword hits only for the queries that have none."""
    answered = [*scope, "query_id"]
    fallback = keyword_hits.join(vector_hits.select(*answered).distinct(), answered, "left_anti")
    return vector_hits.withColumn("method", F.lit("vector")).unionByName(
        fallback.withColumn("score", F.col("score").cast("double")).withColumn("method", F.lit("keyword"))
    )


def theme_terms(themes: DataFrame, questions: DataFrame) -> DataFrame:
    """Search text of a theme: its name and three longer words of each of its first five questions."""
    first = top_per_key(questions, ["theme_id"], [F.col("display_order"), F.col("question_pk")], 5)
    longer = F.slice(F.filter(words(F.col("question_text")), lambda w: F.length(w) > 5), 1, 3)
    picked = first.groupBy("theme_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.array_join(longer, " ").alias("terms")))).alias("_picked")
    )
    return themes.join(picked, "theme_id").select(
        F.col("theme_id").alias("query_id"),
        F.concat("name", F.lit(" "), F.array_join(F.transform("_picked", lambda p: p["terms"]), " ")).alias("text"),
    )


def theme_coverage(scopes: DataFrame, queries: DataFrame, hits: DataFrame, scope: Sequence[str],
                   k: int = L.COVERAGE_DEPTH) -> DataFrame:
    """Chunks found per scope and theme (up to k) and what that means, zeros included.

    The themes are a catalogue of a few dozen; they are unfolded per scope as one array.
    """
    scope = list(scope)
    found = hits.where(F.col("rank") <= k).groupBy(*scope, "query_id").agg(F.count("*").alias("found"))
    themes = queries.select(F.collect_set("query_id")).scalar()
    slots = scopes.select(*scope).distinct().withColumn("query_id", F.explode(themes))
    counted = slots.join(found, [*scope, "query_id"], "left").na.fill(0, ["found"])
    status = F.when(F.col("found") >= 5, F.lit(L.COVERAGE_GOOD)).when(F.col("found") >= 1, F.lit(L.COVERAGE_PARTIAL))
    return counted.withColumn("status", status.otherwise(F.lit(L.COVERAGE_NONE)))


def coverage_verdict(scopes: DataFrame, queries: DataFrame, hits: DataFrame, scope: Sequence[str],
                     k: int = L.COVERAGE_DEPTH) -> DataFrame:
    """Theme totals per scope and whether an analysis is worth running.

    Only themes with hits are counted per scope; the missing ones follow from the number of themes.
    """
    scope = list(scope)
    total = queries.select(F.count_distinct("query_id")).scalar()
    found = hits.where(F.col("rank") <= k).groupBy(*scope, "query_id").agg(F.count("*").alias("found"))
    counts = found.groupBy(*scope).agg(F.count_if(F.col("found") >= 5).alias("good"),
                                       F.count_if(F.col("found") < 5).alias("partial"))
    totals = scopes.select(*scope).distinct().join(counts, scope, "left").na.fill(0, ["good", "partial"])
    totals = totals.withColumn("missing", total - F.col("good") - F.col("partial"))
    verdict = F.when(F.col("missing") == 0, F.lit("complete")).when(F.col("missing") <= 3, F.lit("usable"))
    return totals.withColumn("verdict", verdict.otherwise(F.lit("insufficient")))


def _page_label(prefix_range: str) -> Column:
    pages = F.col("page_range")
    return F.when(
        F.size(pages) > 1,
        F.concat(F.lit(prefix_range), F.element_at(pages, 1).cast("string"), F.lit("-"), F.element_at(pages, -1).cast("string")),
    ).when(F.col("page_number").isNotNull(), F.concat(F.lit("p."), F.col("page_number").cast("string")))


def theme_context(hits: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The retrieved texts of a query in rank order, each under a line naming file and pages.

    ``hits`` carries filename, page_number, page_range and content; at most 20 rows per query count.
    """
    label = _page_label("páginas ")
    name = F.coalesce("filename", F.lit(L.DEFAULT_DOCUMENT_NAME))
    header = F.concat(F.lit("[FONTE: "), name, F.coalesce(F.concat(F.lit(", "), label), F.lit("")), F.lit("]"))
    part = F.concat(header, F.lit("\n"), F.substring("content", 1, L.CONTEXT_CHARS))
    parts = (
        hits.where(F.col("rank") <= L.CONTEXT_CHUNKS)
        .select(*scope, "query_id", F.struct("rank", part.alias("part")).alias("_part"))
        .groupBy(*scope, "query_id")
        .agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    )
    joined = F.array_join(F.transform("_parts", lambda p: p["part"]), "\n\n---\n\n")
    return parts.select(*scope, "query_id", F.size("_parts").alias("chunks"), joined.alias("context"))


def derived_source(hits: DataFrame, scope: Sequence[str]) -> DataFrame:
    """File and page labels of a query's first five chunks, each once, in rank order."""
    name = F.coalesce("filename", F.lit(L.DEFAULT_DOCUMENT_NAME))
    label = F.concat(name, F.coalesce(F.concat(F.lit(", "), _page_label("p.")), F.lit("")))
    return (
        hits.where(F.col("rank") <= L.SOURCE_CHUNKS)
        .select(*scope, "query_id", F.struct("rank", label.alias("label")).alias("_label"))
        .groupBy(*scope, "query_id")
        .agg(F.array_sort(F.collect_list("_label")).alias("_labels"))
        .select(
            *scope, "query_id",
            F.array_join(F.array_distinct(F.transform("_labels", lambda p: p["label"])), "; ").alias("derived_source"),
        )
    )


def question_batches(questions: DataFrame, size: int = L.QUESTION_BATCH, scope: Sequence[str] = ()) -> DataFrame:
    """Groups of five questions per theme (and scope) in display order."""
    order = Window.partitionBy(*scope, "theme_id").orderBy("display_order", "question_pk")
    position = F.row_number().over(order)
    return questions.withColumn("position", position).withColumn(
        "batch", F.floor((F.col("position") - 1) / size) + 1
    )


def prompt_rows(batches: DataFrame, contexts: DataFrame, scope: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per asked batch: the numbered questions and the theme's context.

    ``batches`` has the asked questions with ``scope`` (and further ``keys``, an analysis say), theme_id, batch and
    position; ``contexts(*scope, query_id, context)`` is keyed by theme. A batch whose theme has no hits is asked
    too, with the text that says so.
    """
    by = [*keys, *scope, "theme_id", "batch"]
    number = (F.pmod(F.col("position") - 1, F.lit(L.QUESTION_BATCH)) + 1).cast("string")
    line = F.concat(
        number, F.lit(". [ID: "), F.col("question_id"), F.lit("] "),
        strip_question_id(F.col("question_text"), F.col("question_id")),
    )
    asked = (
        batches.select(*by, F.struct("position", line.alias("line")).alias("_line"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("_line")).alias("_lines"))
        .select(*by, F.size("_lines").alias("questions"),
                F.array_join(F.transform("_lines", lambda q: q["line"]), "\n").alias("question_text"))
    )
    found = contexts.withColumnRenamed("query_id", "theme_id")
    return asked.join(found, [*scope, "theme_id"], "left").select(
        *by, "questions", "question_text", F.coalesce("context", F.lit(L.NO_CONTEXT_TEXT)).alias("context")
    )

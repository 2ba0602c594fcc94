"""A stored index for the keyword search: which chunks have a word inside one of their tokens, without reading a text.

A search word has no white space, so a chunk contains it exactly when one of the chunk's tokens does. The index has

* ``rows``: per *segment* (a few thousand chunks that one task met) the chunks' keys and scope, and for every token the
  chunks that have it as sorted numbers inside the segment, stored as differences of two bytes each;
* ``grams``: for every three letters in a row the tokens they occur in, over all segments.

A word is looked up by the rarest of its grams; the tokens found are compared with the word itself, so substrings count
as in the plain search, and the result is the same. Only the folders of the grams and tokens in question are read. Then
the tokens' chunk numbers are brought together by segment, each a bounded group, which counts the words per query and
passes on k rows per query and scope.

Building moves no text: a task cuts its own rows into segments, and only numbers and tokens are dealt to the folders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritrail import lookups as L
from veritrail.operators.keys import top_per_key, unfold_array
from veritrail.operators.retrieval import BLOCK_BYTES, _blocks, _pick, query_terms
from veritrail.session import ship_package

SEGMENT_CHUNKS = 8_192
SEGMENT_CHARS = 32 << 20  # a segment of long chunks ends earlier
SLOTS = 64  # folders of grams, and of tokens
GRAM = 3
LEAST_TOKEN = 4  # search words are longer than three letters, so shorter tokens contain none

_INDEX = "kind string, slot int, segment long, token string, chunks binary"


def pack(numbers: np.ndarray) -> bytes:
    """Sorted numbers below 65,536 as differences of two bytes."""
    return np.diff(numbers, prepend=0).astype("<u2").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<u2"), dtype=np.int64)


def pack_lists(lists: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """``pack`` of many lists that lie end to end, none of them empty."""
    steps = np.diff(lists, prepend=0)
    steps[starts] = lists[starts]
    joined, ends = steps.astype("<u2").tobytes(), [*(2 * starts[1:]).tolist(), 2 * len(lists)]
    return [joined[start:end] for start, end in zip((2 * starts).tolist(), ends)]


def unpack_lists(packed: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(list, number) of all numbers of many packed lists."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
    steps = np.frombuffer(b"".join(packed), "<u2").astype(np.int64)
    owner, starts, sums = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, np.cumsum(steps)
    return owner, sums - (sums - steps)[starts][owner]


def _slot(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def _segment(pdf: pd.DataFrame, number: int, keep: list[str]) -> pd.DataFrame:
    """The rows of one segment: its chunks in order, and every token with the numbers of its chunks."""
    own = [{t for t in text.split() if len(t) >= LEAST_TOKEN} for text in pdf["content"]]
    chunk = np.repeat(np.arange(len(own)), [len(t) for t in own])
    code, tokens = pd.factorize(np.array([t for of in own for t in of], object))
    order = np.lexsort((chunk, code))
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    places = np.arange(len(pdf))
    chunks = pdf[keep].assign(kind="chunk", segment=number, token=None, chunks=pack_lists(places, places))
    rows = pd.DataFrame({"kind": "token", "segment": number, "token": tokens, "chunks": pack_lists(chunk[order], starts)})
    return pd.concat([chunks, rows.reindex(columns=chunks.columns)], ignore_index=True)


def _cut(batches: Iterator[pd.DataFrame], chunks: int) -> Iterator[pd.DataFrame]:
    """The rows of a task in segments of at most ``chunks`` rows."""
    waiting, chars = [], 0
    for pdf in batches:
        for start in range(0, len(pdf), chunks):
            part = pdf.iloc[start:start + chunks]
            size = part["content"].str.len().sum()
            if waiting and (sum(map(len, waiting)) + len(part) > chunks or chars + size > SEGMENT_CHARS):
                yield pd.concat(waiting, ignore_index=True)
                waiting, chars = [], 0
            waiting.append(part)
            chars += size
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def build_text_index(chunks: DataFrame, path: str, keys: Sequence[str], scope: Sequence[str] = (),
                     segment_chunks: int = SEGMENT_CHUNKS, slots: int = SLOTS) -> None:
    """Index ``chunks(*scope, *keys, content)`` under ``path``, replacing an index that is there."""
    _store(chunks, path, [*scope, *keys], 0, segment_chunks, slots, "overwrite")


def add_to_text_index(chunks: DataFrame, path: str, segment_chunks: int = SEGMENT_CHUNKS) -> None:
    """Append more chunks to the index under ``path`` as new segments."""
    spark = chunks.sparkSession
    keep = [c for c in _layout(spark, path).names if c not in ("kind", "slot", "segment", "token", "chunks", "slots")]
    slots = spark.read.parquet(f"{path}/layout").first()["slots"]
    first = _rows(spark, path).where("kind = 'chunk'").agg(F.coalesce(F.max("segment") + 1, F.lit(0))).first()[0]
    _store(chunks, path, keep, first, segment_chunks, slots, "append")


def _layout(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(f"{path}/layout").schema


def _rows(spark: SparkSession, path: str) -> DataFrame:
    fields = [f for f in _layout(spark, path).fields if f.name != "slots"]
    return spark.read.schema(StructType(fields)).parquet(f"{path}/rows")


def _store(chunks: DataFrame, path: str, keep: list[str], first: int, segment_chunks: int, slots: int, mode: str) -> None:
    spark = chunks.sparkSession
    ship_package(spark)
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", kind string, segment long, token string, chunks binary"
    texts = chunks.where(F.col("content").isNotNull()).select(*keep, F.lower("content").alias("content"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task that runs again meets the same rows, so its segments keep their numbers
        at = first + (TaskContext.get().partitionId() << 20)
        for number, pdf in enumerate(_cut(batches, segment_chunks), at):
            yield _segment(pdf, number, keep)

    rows = texts.mapInPandas(build, schema).withColumn("slot", F.when(F.col("kind") == "token", _slot(F.col("token"), slots)).otherwise(
        F.pmod(F.col("segment"), F.lit(slots)).cast("int")))
    rows.hint("rebalance", "kind", "slot").write.mode(mode).partitionBy("kind", "slot").parquet(f"{path}/rows")
    if mode == "overwrite":
        spark.createDataFrame([(slots,)], "slots int").withColumns(
            {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields}).write.mode(mode).parquet(f"{path}/layout")
    tokens = _rows(spark, path).where((F.col("kind") == "token") & (F.col("segment") >= first)).select("token").distinct()
    places = F.sequence(F.lit(1), F.length("token") - GRAM + 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.substr("token", i, F.lit(GRAM))))
    listed = unfold_array(tokens, ["token"], grams, "gram").drop("_position").withColumn("slot", _slot(F.col("gram"), slots))
    listed.hint("rebalance", "slot").sortWithinPartitions("slot", "gram").write.mode(mode).partitionBy("slot").parquet(f"{path}/grams")


def _grams_of(words: list[str]) -> dict[str, list[str]]:
    return {w: sorted({w[i:i + GRAM] for i in range(len(w) - GRAM + 1)}) for w in words}


def tokens_with(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(word, token): the tokens that contain each word, each pair once."""
    slots = spark.read.parquet(f"{path}/layout").first()["slots"]
    listed = spark.read.schema("gram string, token string, slot int").parquet(f"{path}/grams")
    grams = _grams_of(words)
    asked = spark.createDataFrame([(w, g) for w, of in grams.items() for g in of], "word string, gram string").withColumn("slot", _slot(F.col("gram"), slots))
    needed = [r[0] for r in asked.select("slot").distinct().collect()]
    every = listed.where(F.col("slot").isin(needed) & F.col("gram").isin(sorted({g for of in grams.values() for g in of})))
    sizes = {r["gram"]: r["count"] for r in every.groupBy("gram").count().collect()}
    rarest = [(w, min(of, key=lambda g: (sizes.get(g, 0), g))) for w, of in grams.items()]
    chosen = spark.createDataFrame([r for r in rarest if r[1] in sizes], "word string, gram string")
    return every.join(F.broadcast(chosen), "gram").where(F.contains("token", F.col("word"))).select("word", "token").distinct()


class _Queries:
    """The words of some queries, numbered, and which queries have each."""

    def __init__(self, terms: pd.DataFrame):
        self.ids = list(dict.fromkeys(terms["query_id"]))
        self.words = {w: i for i, w in enumerate(dict.fromkeys(terms["word"]))}
        place = {q: i for i, q in enumerate(self.ids)}
        of: list[list[int]] = [[] for _ in self.words]
        for query, word in zip(terms["query_id"], terms["word"]):
            of[self.words[word]].append(place[query])
        self.sizes = np.array([len(q) for q in of], int)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.queries = np.array([q for some in of for q in some], int)

    def counts(self, found: pd.DataFrame, chunks: int) -> np.ndarray:
        """chunks x queries: how many of the query's words each chunk of a segment has."""
        token, chunk = unpack_lists(found["chunks"])
        word = np.fromiter(map(self.words.__getitem__, found["word"]), np.int64, len(found))[token]
        pair = np.unique(chunk * len(self.words) + word)
        chunk, word = pair // len(self.words), pair % len(self.words)
        times = self.sizes[word]
        entry = np.repeat(self.first[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        cells = np.repeat(chunk, times) * len(self.ids) + self.queries[entry]
        return np.bincount(cells, minlength=chunks * len(self.ids)).reshape(chunks, len(self.ids)).astype(np.int32)


def _scorer(asked, scope: list[str], keys: list[str], k: int):
    """What a segment's tokens and chunks give for the queries ``asked``: k rows per query and scope at most."""

    def score(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(own):
            return pd.DataFrame(columns=[*scope, *keys, "query_id", "score"])
        own = own.iloc[np.argsort(unpack_lists(own["chunks"])[1])].reset_index(drop=True)
        counts = asked.value.counts(found, len(own))
        row, query = np.nonzero(counts)
        return _pick(own, scope, keys, row, query, counts[row, query], asked.value.ids, k)

    return score


def search_text_index(spark: SparkSession, path: str, queries: DataFrame, keys: Sequence[str], scope: Sequence[str] = (),
                      k: int = L.SEARCH_DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Keyword top-k of ``queries(query_id, text)`` over the index under ``path``; rows and columns as ``keyword_topk``."""
    scope, keys = list(scope), list(keys)
    ship_package(spark)
    rows = _rows(spark, path)
    slots = spark.read.parquet(f"{path}/layout").first()["slots"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = ", ".join([f"`{c}` {types[c]}" for c in scope + keys] + [f"query_id {kind}", "score int"])
    stored = rows.where("kind = 'token'").select("slot", "token", "segment", "chunks")
    known = _rows(spark, path).where("kind = 'chunk'").select("segment", *scope, *keys, "chunks")
    hits = spark.createDataFrame([], schema)
    for block in _blocks(query_terms(queries), F.octet_length("word") + 16, block_bytes):
        if not len(block):
            continue
        asked = spark.sparkContext.broadcast(_Queries(block))
        pairs = tokens_with(spark, path, sorted(set(block["word"]))).withColumn("slot", _slot(F.col("token"), slots))
        found = stored.join(pairs, ["slot", "token"]).select("segment", "word", "chunks")
        part = found.groupBy("segment").cogroup(known.groupBy("segment")).applyInPandas(_scorer(asked, scope, keys, k), schema)
        hits = hits.unionByName(part)
    return top_per_key(hits, [*scope, "query_id"], [F.desc("score"), *[F.col(c) for c in keys]], k)

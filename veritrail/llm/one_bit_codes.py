"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Every vector is scaled to length one, turned by a random rotation that only its dimension decides, and kept as the signs
of its coordinates, packed, with one correction scalar: the inner product of the turned vector with its code. From bits
and scalar the inner product with a query is estimated without bias, with an error below
``confidence * sqrt((1 - c^2) / (c^2 * (dim - 1)))`` but for a vanishing share of pairs. A candidate is reranked on the
original vectors, in double precision, exactly where its upper bound reaches the k-th best score seen; all others are
passed over. The scan covers every row of the index: no probing, no cap.

Queries are taken in blocks of a bounded size, each broadcast to all tasks; the index stays where it is. One block is the
ordinary case of the same loop. Of rows with equal vectors only the first k + 1 by id are scanned, as no others can be
among a query's k nearest, and equal query vectors are searched once; a vector that a third of all rows hold costs no
more than any other.

Null, empty and zero vectors and those with null or non-finite components take no part. Vectors of different dimension
are never compared. Ties go to the smaller id; of rows with the same id and vector one counts. Fewer than k candidates
give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import prepare
from veritrail.operators.keys import top_per_key
from veritrail.session import Job

CONFIDENCE = 4.0
BLOCK_BYTES = 4 << 20  # of query vectors in one broadcast
SCAN_ROWS = 2_048


@lru_cache(maxsize=8)
def rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    rng = np.random.default_rng(dimension)
    q, r = np.linalg.qr(rng.standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed bits, correction scalars) of vectors, rows of one dimension."""
    dimension = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(dimension)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dimension)


def estimate(bits: np.ndarray, scalars: np.ndarray, turned_queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes x queries estimated inner products, error bound of every code)."""
    dimension = turned_queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dimension).astype(np.float32)
    with_bits = signs @ turned_queries.T.astype(np.float32)
    found = (2 * with_bits - turned_queries.sum(axis=1, dtype=np.float64)) / (np.sqrt(dimension) * scalars[:, None])
    error = np.sqrt(np.maximum(0.0, 1 - scalars ** 2) / (scalars ** 2 * max(dimension - 1, 1)))
    return found, error


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector can be compared."""
    v = F.col(vector)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & finite & F.exists(vector, lambda x: x != 0))


def build_index(vectors: DataFrame, id: str, vector: str, copies: int) -> DataFrame:
    """(id, dim, bits, scalar, vector): the codes of all usable rows, at most ``copies`` for one vector."""
    rows = usable(vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")),
                  "vector").where(F.col("id").isNotNull()).dropDuplicates(["id", "vector"])
    rows = top_per_key(rows, ["vector"], [F.col("id")], copies, "_copy").drop("_copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector").to_pylist()
            bits: list[bytes] = [b""] * len(lists)
            scalars = np.zeros(len(lists))
            sizes = np.array([len(x) for x in lists])
            for dimension in np.unique(sizes):
                at = np.flatnonzero(sizes == dimension)
                packed, c = encode(np.array([lists[i] for i in at]))
                scalars[at] = c
                for i, row in zip(at, packed):
                    bits[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes.astype("int32")), pa.array(bits, pa.binary()), pa.array(scalars),
                 batch.column("vector")], names=["id", "dim", "bits", "scalar", "vector"])

    return rows.mapInArrow(run, "id long, dim int, bits binary, scalar double, vector array<double>")


def _scan(index: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, confidence: float) -> DataFrame:
    """(query, id, score): what one block of queries found in every task, at most k rows for each query and batch."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = {}
        for dimension, (ids, vectors) in shared.value.items():
            norms = np.linalg.norm(vectors, axis=1)
            prepared[dimension] = (ids, vectors, norms, (vectors / norms[:, None]) @ rotation(dimension))
        kth = {dimension: np.full(len(ids), -np.inf) for dimension, (ids, *_) in prepared.items()}
        best = {dimension: np.full((len(ids), k), -np.inf) for dimension, (ids, *_) in prepared.items()}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dimension in np.unique(sizes):
                if dimension not in prepared:
                    continue
                at = np.flatnonzero(sizes == dimension)
                rows = batch.take(pa.array(at))
                bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(at), -1)
                scalars = rows.column("scalar").to_numpy()
                originals = rows.column("vector").flatten().to_numpy().reshape(len(at), dimension)
                ids = rows.column("id").to_numpy()
                own, vectors, norms, turned = prepared[dimension]
                for start in range(0, len(own), 1_024):
                    some = slice(start, start + 1_024)
                    found, error = estimate(bits, scalars, turned[some])
                    # the k-th best lower bound of this batch holds as well as the scores found before it
                    low = found - confidence * error[:, None]
                    least = np.partition(low, -k, axis=0)[-k] if len(at) >= k else np.full(low.shape[1], -np.inf)
                    least = np.maximum(least, kth[dimension][some])
                    row, query = np.nonzero(found + confidence * error[:, None] >= least)
                    for part in range(0, len(row), 65_536):
                        r, q = row[part:part + 65_536], query[part:part + 65_536] + start
                        scores = (originals[r] * vectors[q]).sum(axis=1) / (
                            np.sqrt((originals[r] ** 2).sum(axis=1)) * norms[q])
                        keep = scores >= kth[dimension][q]
                        r, q, scores = r[keep], q[keep], scores[keep]
                        order = np.lexsort((ids[r], -scores, q))
                        r, q, scores = r[order], q[order], scores[order]
                        place = np.arange(len(q)) - np.searchsorted(q, q)
                        first = place < k
                        r, q, scores, place = r[first], q[first], scores[first], place[first]
                        if len(q):
                            top = np.full((len(own), k), -np.inf)
                            top[q, place] = scores
                            touched = np.unique(q)
                            merged = np.sort(np.concatenate([best[dimension][touched], top[touched]], axis=1), axis=1)[:, -k:]
                            best[dimension][touched] = merged
                            kth[dimension][touched] = merged[:, 0]
                            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[r]), pa.array(scores)],
                                                             names=["query", "id", "score"])

    return index.mapInArrow(run, "query long, id long, score double")


def search(vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5,
           confidence: float = CONFIDENCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every query row."""
    spark = prepare(vectors.sparkSession)
    job = Job(spark, "one-bit-codes")
    # k + 1 copies of a vector: a query may itself be one of them
    index = job.keep(build_index(vectors, id, vector, k + 1), "index")
    asked = usable(vectors.where(is_query).select(F.col(id).cast("long").alias("query_id"),
                                                  F.col(vector).cast("array<double>").alias("v")), "v").distinct()
    asked = job.keep(asked, "asked")
    heads = asked.groupBy("v").agg(F.min("query_id").alias("head"))  # equal query vectors are searched once
    # ids may repeat with different vectors: number the searched vectors by id and content
    heads = job.keep(heads.select("v", "head", F.xxhash64("head", "v").alias("query")), "heads")
    size = heads.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    for number in range(blocks):
        rows = heads.where(block == number).select("query", "v").collect()  # one block: bounded by block_bytes
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r.v), []).append(r)
        held = {d: (np.array([r.query for r in rs], np.int64), np.array([r.v for r in rs])) for d, rs in by_size.items()}
        found = _scan(index, held, k + 1, confidence)
        top_per_key(found, ["query"], [F.col("score").desc(), F.col("id")], k + 1, "_n").drop("_n").write.parquet(
            f"{job.folder}/found/block={number}")
    found = spark.read.schema("query long, id long, score double, block int").parquet(f"{job.folder}/found")
    members = asked.join(heads.select("v", "query"), "v").select("query_id", "query")
    pairs = members.join(found.select("query", "id", "score"), "query").where("id <> query_id")
    # a query id that stands for several vectors keeps its best k
    best = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    result = best.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    return job.finish(result)

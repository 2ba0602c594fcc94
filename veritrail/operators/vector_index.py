"""A stored index of chunk vectors: hash buckets by random projections, read only where a query may have its neighbours.

``build_index`` scales every vector to length 1 and projects it on ``bits`` random directions per table; the signs are
its bucket (``cell``). The vectors are stored once per table, in one folder per bucket; where there are many and small
ones, up to ``FOLDER_ROWS`` rows of neighbouring buckets share a folder, so that the folders to write and list are a few hundred or
grow with the rows, not with the buckets. A small table of cells keeps how many rows each has. The number of bits follows from
the number of rows, so that a bucket has about ``bucket_rows``.

``search_index`` reads only the folders and compares only the cells a query needs. A neighbour at cosine ``c`` lies on the other side of a direction on
which the query has the coordinate ``m`` with probability Phi(-c |m| / sqrt(1 - c^2)); so the chance of each bucket is known
before anything is read; weighted with the bucket's rows, it also allows for crowds. Cells are probed in the order of both chances per
stored row, over all tables, until a neighbour at ``threshold`` is missed with a chance of ``1 - recall`` at most by either; nearer ones are
missed more rarely. Buckets that have no
rows cost nothing. With ``recall=1`` every cell of one table is read and the result is that of the exact search.

Scores are the exact cosines. A vector met in several tables is scored in the first whose probes have it, so no rows are
compared twice and nothing is deduplicated by a shuffle. As in the exact search, vectors and queries of different
dimension never meet, and null, empty, zero, null-component and non-finite vectors take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from veritrail import lookups as L
from veritrail.operators.keys import top_per_key
from veritrail.operators.retrieval import BLOCK_BYTES, CELLS_PER_STEP, _blocks, _pick, _result_schema
from veritrail.operators.vectors import by_dimension, comparable
from veritrail.session import ship_package

TABLES = 2
MOST_BITS = 14
BUCKET_ROWS = 50_000  # rows of a bucket, about; a bucket is the least that is read
FOLDER_ROWS = 50_000  # rows of a folder, about, where several buckets share one
FOLDER_BITS = 8  # with so many bits or fewer every bucket has its own folder
RECALL = 0.97


@lru_cache(maxsize=16)
def directions(dimension: int, table: int, bits: int) -> np.ndarray:
    """``bits`` orthogonal random directions (as far as the dimension allows), the same everywhere."""
    rng = np.random.default_rng([dimension, table])
    parts = [np.zeros((dimension, 0))]
    while sum(p.shape[1] for p in parts) < bits:
        parts.append(np.linalg.qr(rng.standard_normal((dimension, dimension)))[0])
    return np.concatenate(parts, axis=1)[:, :bits] * math.sqrt(dimension)


def buckets(unit: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The bucket of every unit vector (row) in one table."""
    return (unit @ directions(unit.shape[1], table, bits) > 0) @ (1 << np.arange(bits))


def _cell(dimension: int, table: int, bucket: int) -> str:
    return f"d{dimension}t{table}b{bucket}"


def _shared_bits(rows: int, bits: int) -> int:
    """How many of the last bits the buckets of a folder differ in."""
    fitting = math.floor(math.log2(max(1.0, FOLDER_ROWS * 2**bits / max(1, rows))))
    return max(0, min(bits - FOLDER_BITS, fitting))


def _placed(vectors: DataFrame, keep: list[str], tables: int, bits: int, shared: int) -> DataFrame:
    """One row per vector and table, with its bucket and folder (``cell``: of the buckets in it the name without the shared bits)."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = np.full(len(pdf), None, object)
            for dimension, (at, rows) in by_dimension(pdf["embedding"]).items():
                found = [buckets(rows, t, bits) for t in range(tables)]
                for i, position in enumerate(at):
                    cells[position] = [(int(b[i]), _cell(dimension, t, b[i] >> shared)) for t, b in enumerate(found)] if rows[i].any() else []
            yield pdf.assign(cells=cells)

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", cells array<struct<bucket: int, cell: string>>"
    return vectors.mapInPandas(place, schema).select(*keep, F.explode("cells").alias("_at")).select(*keep, "_at.bucket", "_at.cell")


def build_index(vectors: DataFrame, path: str, keys: Sequence[str], scope: Sequence[str] = (), tables: int = TABLES,
                bits: int | None = None, bucket_rows: int = BUCKET_ROWS) -> None:
    """Store ``vectors(*scope, *keys, embedding)`` under ``path``, replacing an index that is there."""
    spark, keep = vectors.sparkSession, [*scope, *keys, "embedding"]
    ship_package(spark)
    rows = vectors.where(comparable("embedding")).select(*keep)
    count = rows.count()
    if bits is None:
        bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, count / bucket_rows)))))
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/layout")
    _store(rows, path, tables, bits, _shared_bits(count, bits), "overwrite")


def add_to_index(vectors: DataFrame, path: str) -> None:
    """Append more vectors to the index under ``path``; its tables, bits and folders stay."""
    spark = vectors.sparkSession
    ship_package(spark)
    _, tables, bits, shared = _cells(spark, path)
    _store(vectors.where(comparable("embedding")).select(*_stored(spark, path).names[:-2]), path, tables, bits, shared, "append")


def _stored(spark: SparkSession, path: str) -> StructType:
    """The columns of the stored vectors, the bucket and the folder last."""
    own = spark.read.parquet(f"{path}/layout").schema.fields
    return StructType([*own, StructField("bucket", IntegerType()), StructField("cell", StringType())])


def _store(rows: DataFrame, path: str, tables: int, bits: int, shared: int, mode: str) -> None:
    # a folder is written by one task, a crowded one by several
    placed = _placed(rows, rows.columns, tables, bits, shared).hint("rebalance", "cell").sortWithinPartitions("cell", "bucket")
    placed.write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    spark = rows.sparkSession
    counts = spark.read.schema(_stored(spark, path)).parquet(f"{path}/vectors").groupBy("cell", "bucket").agg(F.count("*").alias("rows"))
    number = lambda letter: F.regexp_extract("cell", rf"{letter}(\d+)", 1).cast("int")
    counts.select("cell", number("d").alias("dim"), number("t").alias("table"), "bucket", "rows").unionByName(
        spark.createDataFrame([(None, shared, tables, bits, None)], "cell string, dim int, table int, bucket int, rows long")
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> tuple[pd.DataFrame, int, int, int]:
    """The cells of an index, its number of tables and of bits, and the bits that the buckets of a folder do not share
    a name by (the row without a name)."""
    rows = spark.read.parquet(f"{path}/cells").toPandas()
    layout = rows[rows["cell"].isna()].iloc[0]
    cells = rows[rows["cell"].notna()].astype({"dim": int, "table": int, "bucket": int, "rows": int})
    return cells, int(layout["table"]), int(layout["bucket"]), int(layout["dim"])


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def chances(query: np.ndarray, table: int, bits: int, cosine: float) -> np.ndarray:
    """For every bucket of a table the chance that a neighbour at ``cosine`` of the unit vector ``query`` lies in it."""
    side = query @ directions(len(query), table, bits)
    over = _phi(cosine * side / math.sqrt(max(1e-12, 1 - cosine * cosine)))  # of a positive coordinate
    out = np.ones(1)
    for p in over:
        out = np.concatenate([out * (1 - p), out * p])
    return out


def choose_cells(query: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray]], bits: int, cosine: float,
                 recall: float) -> list[tuple[int, int]]:
    """(table, bucket) of the cells to read. ``known`` has for every table the buckets that have rows, and how many."""
    if recall >= 1:
        table = min(known)
        return [(table, int(b)) for b in known[table][0]]
    waiting: dict[int, list[tuple[float, float, int, int]]] = {}
    for table, (bucket, rows) in known.items():
        chance = chances(query, table, bits, cosine)[bucket] + 1e-300
        chance = chance / chance.sum()  # a neighbour is a row, so it is in a bucket that has rows
        held = chance * rows / (chance * rows).sum()  # and likelier one of many rows than of few
        order = np.argsort((chance + held) / rows, kind="stable")
        waiting[table] = list(zip(chance[order], held[order], rows[order], bucket[order]))
    missed, unheld, chosen = dict.fromkeys(known, 1.0), dict.fromkeys(known, 1.0), []
    while max(math.prod(missed.values()), math.prod(unheld.values())) > 1 - recall and any(waiting.values()):
        # the cell that makes a miss least likely for the rows it costs
        gain = lambda cell, t: (cell[0] / missed[t] + cell[1] / unheld[t]) / cell[2]
        table = max((t for t in waiting if waiting[t]), key=lambda t: gain(waiting[t][-1], t))
        chance, held, _, bucket = waiting[table].pop()
        missed[table] = max(1e-12, missed[table] - chance)
        unheld[table] = max(1e-12, unheld[table] - held)
        chosen.append((table, int(bucket)))
    return chosen


def _probes(block: pd.DataFrame, cells: pd.DataFrame, bits: int, cosine: float, recall: float) -> dict[tuple[int, int, int], np.ndarray]:
    """{(dimension, table, bucket): the queries (places in the block) that read it}."""
    known: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for (dimension, table), part in cells.sort_values("bucket").groupby(["dim", "table"]):
        known.setdefault(int(dimension), {})[int(table)] = (part["bucket"].to_numpy(), part["rows"].to_numpy())
    found: dict[tuple[int, int, int], list[int]] = {}
    for dimension, (place, rows) in by_dimension(block["embedding"]).items():
        for i, query in zip(place, rows):
            if dimension in known and query.any():
                for table, bucket in choose_cells(query, known[dimension], bits, cosine, recall):
                    found.setdefault((dimension, table, bucket), []).append(int(i))
    return {cell: np.array(queries) for cell, queries in found.items()}


def _read_together(pdf: pd.DataFrame, probes: dict) -> Iterator[tuple[int, int, np.ndarray, pd.DataFrame]]:
    """(dimension, table, queries, rows) of one batch: the rows of all cells that the same queries read, some at a time.
    Rows of other cells, which only share a folder with one that is read, are left out."""
    groups: dict[tuple[int, int, bytes], tuple[np.ndarray, list[np.ndarray]]] = {}
    for (cell, bucket), at in pdf.groupby(["cell", "bucket"], sort=False).indices.items():
        dimension, table, _ = map(int, re.findall(r"\d+", cell))
        asked = probes.get((dimension, table, int(bucket)))
        if asked is not None:
            groups.setdefault((dimension, table, asked.tobytes()), (asked, []))[1].append(at)
    for (dimension, table, _), (asked, places) in groups.items():
        rows, step = np.concatenate(places), max(1, CELLS_PER_STEP // len(asked))
        for start in range(0, len(rows), step):
            yield dimension, table, asked, pdf.iloc[rows[start:start + step]].reset_index(drop=True)


def _hits(pdf: pd.DataFrame, dimension: int, table: int, asked: np.ndarray, probes: dict, matrices: dict, query_ids: list, bits: int,
          scope: list[str], keys: list[str], k: int, threshold: float) -> pd.DataFrame | None:
    """What rows of one table give for the queries ``asked``, all of which read their cells."""
    order, matrix = matrices[dimension]
    rows = by_dimension(pdf["embedding"])[dimension][1]
    similarity = np.round(rows @ matrix[np.searchsorted(order, asked)].T, 9)
    wanted = similarity >= threshold
    for earlier in range(table):  # a vector counts in the first table in which the query reads its bucket
        own = buckets(rows, earlier, bits)
        for other in np.unique(own):
            seen = probes.get((dimension, earlier, int(other)))
            if seen is not None:
                wanted[np.ix_(own == other, np.isin(asked, seen))] = False
    row, query = np.nonzero(wanted)
    return _pick(pdf, scope, keys, row, asked[query], similarity[row, query], query_ids, k) if len(row) else None


def read_cells(spark: SparkSession, path: str, cells: list[str]) -> DataFrame:
    """The rows in the folders of some cells (named without the bits that the buckets of a folder differ in); no other is
    listed or read."""
    shape, folders = _stored(spark, path), [f"{path}/vectors/cell={c}" for c in cells]
    reader = spark.read.schema(shape).option("basePath", f"{path}/vectors")
    return reader.parquet(*folders) if folders else spark.createDataFrame([], shape)


def search_index(spark: SparkSession, path: str, queries: DataFrame, keys: Sequence[str], scope: Sequence[str] = (),
                 k: int = L.SEARCH_DEPTH, threshold: float = L.SIMILARITY_THRESHOLD, recall: float = RECALL,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cosine top-k of ``queries(query_id, embedding)`` over the index under ``path``; columns as ``vector_topk``."""
    scope, keys = list(scope), list(keys)
    ship_package(spark)
    cells, _, bits, shared_bits = _cells(spark, path)
    asked = queries.where(comparable("embedding")).select("query_id", "embedding")
    hits = None
    for block in _blocks(asked, F.size("embedding") * 8, block_bytes):
        probes = _probes(block, cells, bits, threshold, recall)
        folders = sorted({(dimension, table, bucket >> shared_bits) for dimension, table, bucket in probes})
        rows = read_cells(spark, path, [_cell(*folder) for folder in folders])
        matrices = by_dimension(block["embedding"]) if len(block) else {}
        shared, query_ids = spark.sparkContext.broadcast((probes, matrices)), block["query_id"].tolist()

        def score(batches: Iterator[pd.DataFrame], shared=shared, query_ids=query_ids, bits=bits) -> Iterator[pd.DataFrame]:
            own, matrices = shared.value
            for pdf in batches:
                for dimension, table, asked, part in _read_together(pdf, own):
                    found = _hits(part, dimension, table, asked, own, matrices, query_ids, bits, scope, keys, k, threshold)
                    if found is not None:
                        yield found

        part = rows.select(*scope, *keys, "embedding", "bucket", "cell").mapInPandas(
            score, _result_schema(rows, scope + keys, queries, "double"))
        hits = part if hits is None else hits.unionByName(part)
    return top_per_key(hits, [*scope, "query_id"], [F.desc("score"), *[F.col(c) for c in keys]], k)


def index_reading(spark: SparkSession, path: str, queries: DataFrame, threshold: float = L.SIMILARITY_THRESHOLD,
                  recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, cells_read, rows_read, cells, rows): the cells each query is compared with and their rows, to one table's.
    Rows that only share a folder with them are read too, but not counted."""
    cells, _, bits, _ = _cells(spark, path)
    sizes = {(r.dim, r.table, r.bucket): r.rows for r in cells.itertuples()}
    asked, out = queries.where(comparable("embedding")).select("query_id", "embedding"), []
    for block in _blocks(asked, F.size("embedding") * 8, block_bytes):
        read: dict[int, list[int]] = {}
        for cell, own in _probes(block, cells, bits, threshold, recall).items():
            for i in own:
                read.setdefault(int(i), []).append(int(sizes[cell]))
        for i, (query, vector) in enumerate(zip(block["query_id"], block["embedding"])):
            mine = cells[(cells["dim"] == len(vector)) & (cells["table"] == 0)]
            out.append((query, len(read.get(i, [])), sum(read.get(i, [])), len(mine), int(mine["rows"].sum())))
    kind = queries.schema["query_id"].dataType.simpleString()
    return spark.createDataFrame(out, f"query_id {kind}, cells_read int, rows_read long, cells int, rows long")

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import retrieval as R
from veritrail.operators import vector_index as V

KEYS, SCOPE = ["doc_id", "chunk_index"], ["company_id"]
SHAPE = "company_id int, doc_id long, chunk_index int, embedding array<double>"


def clustered(n, dims, seed, centres=30, spread=0.25):
    """Vectors around centres, a third of them around the first."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    place = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, centres, n))
    return middle, middle[place] + rng.normal(size=(n, dims)) * spread / np.sqrt(dims)


def rows_of(vectors, first=0):
    return [(int(i % 3), first + i, 0, v.round(6).tolist()) for i, v in enumerate(vectors)]


def ranked(hits):
    return {(r.company_id, r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits.collect()}


def test_reading_all_cells_is_the_exact_search(spark, tmp_path):
    _, vectors = clustered(700, 12, 1)
    odd = [(0, 900, 0, None), (0, 901, 0, []), (1, 902, 0, [0.0] * 12), (1, 903, 0, [1.0, None] + [0.5] * 10), (2, 904, 0, [float("nan")] * 12)]
    other = [(i % 2, 950 + i, 0, [1.0, 0.1 * i, 0.2]) for i in range(8)]
    chunks = spark.createDataFrame(rows_of(vectors) + odd + other, SHAPE)
    queries = spark.createDataFrame([(q, vectors[q * 7].tolist()) for q in range(6)] + [(50, [1.0, 0.3, 0.0]), (51, [0.0] * 12), (52, None), (53, [1.0] * 5)],
                                    "query_id int, embedding array<double>")
    path = str(tmp_path / "index")
    V.build_index(chunks.where("doc_id % 2 = 0"), path, KEYS, SCOPE, bits=3)
    V.add_to_index(chunks.where("doc_id % 2 = 1"), path)
    exact = ranked(R.vector_topk(chunks, queries, KEYS, SCOPE, k=9))
    assert len(exact) > 60 and any(q == 50 for _, q, _ in exact)
    for block_bytes in (1 << 20, 200):
        assert ranked(V.search_index(spark, path, queries, KEYS, SCOPE, k=9, recall=1.0, block_bytes=block_bytes)) == exact


@pytest.mark.parametrize("tables", [1, 3])
def test_recall_and_pruned_reading(spark, tmp_path, tables):
    middle, vectors = clustered(6_000, 48, 2)
    chunks = spark.createDataFrame(rows_of(vectors), SHAPE)
    queries = spark.createDataFrame([(q, m.tolist()) for q, m in enumerate(middle)], "query_id int, embedding array<double>")
    path = str(tmp_path / "index")
    V.build_index(chunks, path, KEYS, SCOPE, tables=tables, bucket_rows=50)
    exact = ranked(R.vector_topk(chunks, queries, KEYS, SCOPE, threshold=0.9))
    found = ranked(V.search_index(spark, path, queries, KEYS, SCOPE, threshold=0.9))
    wanted, got = ({(c, q, d) for (c, q, _), (d, _) in x.items()} for x in (exact, found))
    assert len(wanted) > 1_000 and len(wanted & got) >= 0.95 * len(wanted)
    assert len(got) == len(found)  # no row twice from several tables
    reading = V.index_reading(spark, path, queries, threshold=0.9).collect()
    assert len(reading) == len(middle) and sum(r.cells_read for r in reading) < 0.5 * sum(r.cells for r in reading)
    assert sum(r.rows_read for r in reading) < 0.3 * sum(r.rows for r in reading)
    # the files of the other cells are not opened
    one = V.read_cells(spark, path, ["d48t0b3", "d48t0b5"]).inputFiles()
    assert one and all("cell=d48t0b3/" in f or "cell=d48t0b5/" in f for f in one)


def test_chances_are_those_of_neighbours():
    rng = np.random.default_rng(3)
    query = rng.normal(size=40)
    query /= np.linalg.norm(query)
    chance = V.chances(query, 1, 6, 0.6)
    assert chance.sum() == pytest.approx(1)
    noise = rng.normal(size=(40_000, 40))
    noise -= np.outer(noise @ query, query)
    near = 0.6 * query + 0.8 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    seen = np.bincount(V.buckets(near, 1, 6), minlength=64) / len(near)
    assert np.abs(seen - chance).max() < 0.02


def test_empty_index_and_no_queries(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = spark.createDataFrame([(1, 1, 0, [1.0, 0.0])], SHAPE)
    queries = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, embedding array<double>")
    V.build_index(chunks.limit(0), path, KEYS, SCOPE)
    assert V.search_index(spark, path, queries, KEYS, SCOPE).count() == 0
    V.add_to_index(chunks, path)
    assert V.search_index(spark, path, queries, KEYS, SCOPE).count() == 1
    assert V.search_index(spark, path, queries.limit(0), KEYS, SCOPE).count() == 0


def test_exact_search_takes_any_dimension(spark):
    chunks = spark.createDataFrame([(1, 1, 0, [1.0, 0.0]), (1, 2, 0, [1.0, 0.0, 0.0]), (1, 3, 0, [1.0, None]), (1, 4, 0, []), (1, 5, 0, None)], SHAPE)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0]), (4, [None, 1.0])], "query_id int, embedding array<double>")
    hits = R.vector_topk(chunks, queries, KEYS).select("query_id", "doc_id", F.round("score", 6)).collect()
    assert sorted(map(tuple, hits)) == [(1, 1, 1.0), (2, 2, 1.0)]


def test_many_small_buckets_share_folders(spark, tmp_path):
    middle, vectors = clustered(3_000, 16, 5)
    chunks = spark.createDataFrame(rows_of(vectors), SHAPE)
    queries = spark.createDataFrame([(q, m.tolist()) for q, m in enumerate(middle[:8])], "query_id int, embedding array<double>")
    path = tmp_path / "index"
    V.build_index(chunks.where("doc_id % 2 = 0"), str(path), KEYS, SCOPE, bits=11)
    V.add_to_index(chunks.where("doc_id % 2 = 1"), str(path))
    cells = V._cells(spark, str(path))[0]
    folders = list((path / "vectors").glob("cell=*"))
    assert len(folders) <= 2 * 256 < len(cells) and cells["rows"].sum() == 2 * 3_000
    exact = ranked(R.vector_topk(chunks, queries, KEYS, SCOPE, threshold=0.8))
    assert ranked(V.search_index(spark, str(path), queries, KEYS, SCOPE, threshold=0.8, recall=1.0)) == exact
    found = ranked(V.search_index(spark, str(path), queries, KEYS, SCOPE, threshold=0.8))
    wanted, got = ({(c, q, d) for (c, q, _), (d, _) in x.items()} for x in (exact, found))
    assert len(wanted) > 300 and len(wanted & got) >= 0.95 * len(wanted) and len(got) == len(found)
    # what only shares a folder is not compared
    reading = V.index_reading(spark, str(path), queries, threshold=0.8).collect()
    assert sum(r.rows_read for r in reading) < 0.7 * sum(r.rows for r in reading)


def test_buckets_share_a_folder_up_to_its_rows():
    assert V._shared_bits(10_000, 8) == 0 and V._shared_bits(600_000, 14) == 6
    assert V._shared_bits(100_000_000, 11) == 0 and V._shared_bits(0, 14) == 6


def test_crowded_buckets_are_not_left_out():
    """A bucket with many rows costs more to read, but a neighbour is likelier to be one of them."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    crowd = unit(rng.normal(size=64))
    rows = unit(np.concatenate([rng.normal(size=(8_000, 64)), crowd + rng.normal(size=(400, 64)) * 0.001]))
    own = [V.buckets(rows, t, 10) for t in (0, 1)]
    known = {t: np.unique(own[t], return_counts=True) for t in (0, 1)}
    found = wanted = 0
    for other in rng.normal(size=(20, 64)):
        query = unit(0.45 * crowd + 0.9 * unit(other))
        near = np.flatnonzero(rows @ query >= 0.3)
        chosen = V.choose_cells(query, known, 10, 0.3, 0.97)
        read = {t: {b for at, b in chosen if at == t} for t in (0, 1)}
        found += sum(any(int(own[t][i]) in read[t] for t in (0, 1)) for i in near)
        wanted += len(near)
    assert wanted > 5_000 and found >= 0.95 * wanted, (found, wanted)

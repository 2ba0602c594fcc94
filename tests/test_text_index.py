import random

import numpy as np
import pandas as pd
import pytest

from tests.test_retrieval import TEXTS, brute_words
from veritrail.operators import retrieval as R
from veritrail.operators import text_index as X

KEYS, SCOPE = ["doc_id", "chunk_index"], ["company_id"]
QUERIES = [(1, "energia água para empresa"), (2, "Resíduos SÓLIDOS energ"), (3, "qual tema"), (4, "administração conselho"), (5, "energia energia"), (6, "gét ARDE"), (7, "zzzzz")]


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(1 if i % 3 == 0 else i % 4, i, i % 2, " ".join(rng.sample(TEXTS, 2)) + " fim\n") for i in range(n)]


@pytest.mark.parametrize("segment", [7, 8_192])
def test_equal_to_the_plain_search(spark, tmp_path, segment):
    rows = rows_of(150, 2)
    shape = "company_id int, doc_id long, chunk_index int, content string"
    chunks = spark.createDataFrame(rows + [(1, 900, 0, None), (2, 901, 0, "")], shape).repartition(3)
    asked = spark.createDataFrame(QUERIES, "query_id int, text string")
    path = str(tmp_path / "index")
    X.build_text_index(chunks.where("doc_id < 100"), path, KEYS, SCOPE, segment, slots=5)
    X.add_to_text_index(chunks.where("doc_id >= 100"), path, segment)
    plain = brute_words(rows, QUERIES, 5)
    for block_bytes in (1 << 20, 90):
        hits = X.search_text_index(spark, path, asked, KEYS, SCOPE, k=5, block_bytes=block_bytes)
        assert {(r.company_id, r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits.collect()} == plain
    assert hits.schema.simpleString() == R.keyword_topk(chunks, asked, KEYS, SCOPE, k=5).schema.simpleString()
    assert X.search_text_index(spark, path, asked.limit(0), KEYS, SCOPE).count() == 0


def test_tokens_are_found_by_their_parts(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, 0, "Reenergizar energia, (energias) enerxgia abc"), (1, 2, 0, "ener gia")], "company_id int, doc_id long, chunk_index int, content string")
    path = str(tmp_path / "index")
    X.build_text_index(chunks, path, KEYS, SCOPE)
    found = X.tokens_with(spark, path, ["energi", "ener", "gias", "none"]).collect()
    assert {(r.word, r.token) for r in found} == {("energi", "reenergizar"), ("energi", "energia,"), ("energi", "(energias)"),
                                                  ("ener", "reenergizar"), ("ener", "energia,"), ("ener", "(energias)"), ("ener", "enerxgia"), ("ener", "ener"), ("gias", "(energias)")}
    X.build_text_index(chunks.limit(0), path, KEYS, SCOPE)
    asked = spark.createDataFrame(QUERIES, "query_id int, text string")
    assert X.search_text_index(spark, path, asked, KEYS, SCOPE).count() == 0


def test_numbers_survive_packing():
    for numbers in ([], [0], [0, 1, 65_535], list(range(0, 60_000, 7))):
        assert X.unpack(X.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_many_lists_are_packed_like_each():
    lists = [np.sort(np.random.default_rng(i).choice(65_536, size, replace=False)) for i, size in enumerate([1, 5, 900, 2, 65_536, 1])]
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    packed = X.pack_lists(np.concatenate(lists), starts)
    assert packed == [X.pack(numbers) for numbers in lists]
    owner, numbers = X.unpack_lists(packed)
    assert numbers.tolist() == np.concatenate(lists).tolist() and owner.tolist() == np.repeat(range(6), [*map(len, lists)]).tolist()
    assert X.pack_lists(np.zeros(0, int), np.zeros(0, int)) == []


def test_counts_of_a_segment_are_those_of_its_chunks():
    terms = pd.DataFrame([(q, w) for q, of in {7: ["ener", "agua"], 8: ["agua"], 9: ["ener", "sol"], 5: ["fim"]}.items() for w in of],
                         columns=["query_id", "word"])
    found = pd.DataFrame([("ener", [0, 4]), ("agua", [1, 4]), ("ener", [4, 5]), ("sol", [4])], columns=["word", "chunks"])
    found["chunks"] = [X.pack(np.array(x)) for x in found["chunks"]]
    of = {"ener": {0, 4, 5}, "agua": {1, 4}, "sol": {4}, "fim": set()}
    queries = X._Queries(terms)
    want = [[sum(chunk in of[w] for w in terms[terms["query_id"] == q]["word"]) for q in queries.ids] for chunk in range(7)]
    assert queries.counts(found, 7).tolist() == want

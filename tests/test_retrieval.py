import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritrail.lookups import STOP_WORDS
from veritrail.operators import retrieval as R

KEYS, SCOPE = ["doc_id", "chunk_index"], ["company_id"]


def vectors(spark, n, dims, seed, hot=True):
    generator = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        company = 1 if hot and i % 3 == 0 else i % 5
        values = None if i % 50 == 7 else [0.0] * dims if i % 50 == 9 else generator.normal(size=dims).round(2).tolist()
        rows.append((company, i, 0, values))
    return rows, spark.createDataFrame(rows, "company_id int, doc_id long, chunk_index int, embedding array<double>")


def brute_vector(rows, queries, k, threshold):
    best: dict = {}
    for company, doc, chunk, v in rows:
        if v is None or not any(v):
            continue
        for q, w in queries:
            score = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9)
            if score >= threshold:
                best.setdefault((company, q), []).append((-score, doc, chunk))
    return {(c, q, n + 1): h[1] for (c, q), hits in best.items() for n, h in enumerate(sorted(hits)[:k])}


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_vector_topk(spark, block_bytes):
    rows, chunks = vectors(spark, 400, 6, 1)
    queries = [(q, np.random.default_rng(q + 50).normal(size=6).round(2).tolist()) for q in range(9)]
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    hits = R.vector_topk(chunks, asked, KEYS, SCOPE, k=7, threshold=0.3, block_bytes=block_bytes)
    got = {(r.company_id, r.query_id, r["rank"]): r.doc_id for r in hits.collect()}
    assert got == brute_vector(rows, queries, 7, 0.3)


TEXTS = ["Gestão de água e energia", "Resíduos sólidos; energia eólica", "ENERGIA", "nada aqui", "conselho de administração", "", "aguardente energética"]


def brute_words(rows, queries, k):
    best: dict = {}
    for company, doc, chunk, text in rows:
        for q, query in queries:
            words = {w for w in query.lower().split() if len(w) > 3 and w not in STOP_WORDS}
            score = sum(w in text.lower() for w in words)
            if score:
                best.setdefault((company, q), []).append((-score, doc, chunk))
    return {(c, q, n + 1): (h[1], -h[0]) for (c, q), hits in best.items() for n, h in enumerate(sorted(hits)[:k])}


@pytest.mark.parametrize("block_bytes", [1 << 20, 90])
def test_keyword_topk(spark, block_bytes):
    generator = random.Random(2)
    rows = [(1 if i % 3 == 0 else i % 4, i, i % 2, " ".join(generator.sample(TEXTS, 2))) for i in range(120)]
    queries = [(1, "energia água para empresa"), (2, "Resíduos SÓLIDOS energ"), (3, "qual tema"), (4, "administração conselho"), (5, "energia energia")]
    chunks = spark.createDataFrame(rows, "company_id int, doc_id long, chunk_index int, content string")
    asked = spark.createDataFrame(queries, "query_id int, text string")
    hits = R.keyword_topk(chunks, asked, KEYS, SCOPE, k=5, block_bytes=block_bytes)
    got = {(r.company_id, r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits.collect()}
    assert got == brute_words(rows, queries, 5)


def test_best_rows():
    group = np.array([0, 1, 0, 0, 1])
    score = np.array([1.0, 5.0, 3.0, 3.0, 5.0])
    tie = np.array([0, 2, 2, 1, 1])
    assert R.best_rows(group, score, tie, 2).tolist() == [3, 2, 4, 1]


def test_no_queries_no_hits(spark):
    _, chunks = vectors(spark, 10, 3, 1)
    empty = spark.createDataFrame([], "query_id int, embedding array<double>")
    assert R.vector_topk(chunks, empty, KEYS).count() == 0
    words = chunks.withColumn("content", F.lit("energia"))
    assert R.keyword_topk(words, spark.createDataFrame([(1, "de a")], "query_id int, text string"), KEYS).count() == 0


def test_hybrid_falls_back_per_scope_and_query(spark):
    vector = spark.createDataFrame([(1, 7, 1, 0.5)], "company_id int, query_id int, doc_id int, score double")
    words = spark.createDataFrame([(1, 7, 2, 3), (1, 8, 3, 1), (2, 7, 4, 2)], "company_id int, query_id int, doc_id int, score int")
    got = {(r.company_id, r.query_id, r.doc_id, r.method) for r in R.hybrid_topk(vector, words, SCOPE).collect()}
    assert got == {(1, 7, 1, "vector"), (1, 8, 3, "keyword"), (2, 7, 4, "keyword")}


HITS = "company_id int, query_id int, rank int, filename string, page_number int, page_range array<int>, content string"


def test_context_and_source(spark):
    rows = [(1, 1, 1, "a.pdf", 3, [3], "x" * 1300), (1, 1, 2, "b.pdf", 4, [4, 5, 6], "y"), (1, 1, 3, "a.pdf", 3, None, "z"),
            (1, 1, 4, None, None, None, "w")] + [(1, 1, r, "late.pdf", None, None, "v") for r in range(5, 25)]
    hits = spark.createDataFrame(rows, HITS)
    context = R.theme_context(hits, SCOPE).first()
    parts = context.context.split("\n\n---\n\n")
    assert context.chunks == len(parts) == 20
    assert parts[0] == "[FONTE: a.pdf, p.3]\n" + "x" * 1200
    assert parts[1] == "[FONTE: b.pdf, páginas 4-6]\ny" and parts[3] == "[FONTE: Documento]\nw"
    assert R.derived_source(hits, SCOPE).first().derived_source == "a.pdf, p.3; b.pdf, p.4-6; Documento; late.pdf"


def test_theme_terms_keep_order(spark):
    themes = spark.createDataFrame([(1, "Tema"), (2, "Sem perguntas")], "theme_id int, name string")
    questions = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(
        ["primeira pergunta longa demais", "de a", "segunda pergunta", "terceira", "quarta  pergunta", "sobrando fora"])],
        "theme_id int, display_order int, question_pk int, question_text string")
    rows = R.theme_terms(themes, questions).collect()
    assert [(r.query_id, r.text) for r in rows] == [(1, "Tema primeira pergunta demais  segunda pergunta terceira quarta pergunta")]


def test_coverage(spark):
    scopes = spark.createDataFrame([(1,), (2,)], "company_id int")
    queries = spark.createDataFrame([(q,) for q in range(5)], "query_id int")
    hits = spark.createDataFrame([(1, 0, r) for r in range(1, 13)] + [(1, 1, 1)], "company_id int, query_id int, rank int")
    coverage = R.theme_coverage(scopes, queries, hits, SCOPE)
    got = {(r.company_id, r.query_id): (r.found, r.status) for r in coverage.collect()}
    assert got[1, 0] == (10, "OK") and got[1, 1] == (1, "PARCIAL") and got[1, 2] == got[2, 0] == (0, "SEM DADOS")
    verdicts = {r.company_id: (r.good, r.partial, r.missing, r.verdict) for r in R.coverage_verdict(scopes, queries, hits, SCOPE).collect()}
    assert verdicts == {1: (1, 1, 3, "usable"), 2: (0, 0, 5, "insufficient")}


def test_prompts(spark):
    questions = spark.createDataFrame([(3, i, i, f"1.1.{i}", f"1.1.{i}. Pergunta {i}") for i in range(1, 8)],
                                      "theme_id int, question_pk int, display_order int, question_id string, question_text string")
    scopes = spark.createDataFrame([(1,), (2,), (3,)], "company_id int")
    contexts = spark.createDataFrame([(1, 3, "c1"), (2, 3, "c2")], "company_id int, query_id int, context string")
    asked = R.question_batches(questions.crossJoin(scopes), scope=SCOPE)
    rows = R.prompt_rows(asked, contexts, SCOPE).orderBy("company_id", "batch").collect()
    none = "Nenhum trecho relevante encontrado."
    assert [(r.company_id, r.batch, r.questions, r.context) for r in rows] == [
        (1, 1, 5, "c1"), (1, 2, 2, "c1"), (2, 1, 5, "c2"), (2, 2, 2, "c2"), (3, 1, 5, none), (3, 2, 2, none)]
    assert rows[1].question_text == "1. [ID: 1.1.6] Pergunta 6\n2. [ID: 1.1.7] Pergunta 7"


def test_words_of_a_large_batch_are_counted_in_parts(monkeypatch):
    """What is found with repeats is never held for all texts of a batch at once, and the counts do not depend on the parts."""
    terms = pd.DataFrame({"query_id": [1, 1, 1, 2, 2], "word": ["pala", "palav", "palavra", "avra", "vra1"]})
    texts = pd.Series([" ".join(f"palavra{i % 7}{j}" for j in range(200)) for i in range(3_000)] + ["", "x", "avra"])
    index = R._TermIndex(terms)
    for text in texts[:7]:
        index.counts(pd.Series([text]))  # what is remembered of the tokens stays
    tracemalloc.start()
    row, query, score = index.counts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert len(row) == 6_001 and (row[-1], query[-1], score[-1]) == (3_002, 1, 1)
    assert [sorted(zip(query[row == i].tolist(), score[row == i].tolist())) for i in (0, 1, 3_000)] == [[(0, 3), (1, 1)], [(0, 3), (1, 2)], []]
    monkeypatch.setattr(R, "COUNTED_CHARS", 50)
    assert [c.tolist() for c in index.counts(texts)] == [row.tolist(), query.tolist(), score.tolist()]

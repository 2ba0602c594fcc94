import random

import numpy as np
import pytest

from veritrail.llm import periodic_runs as pr


def brute(words, least):
    """All runs by looking at every period: (start, length, smallest period)."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 3 * q):
                found.setdefault((start, i + q), q)
            i += 1 if i == start else 0
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_words(rng):
    letters, words = rng.choice([1, 2, 3, 5, 60]), []
    while len(words) < rng.choice([1, 20, 150, 600, 900]):
        piece = [f"w{rng.randrange(letters)}" for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 23, 24, 25, 47, 48, 80, 95, 96]))]
        words += (piece * rng.randint(1, 9))[:rng.randint(1, 500)]
        if rng.random() < 0.2:
            words = words[-150:] * 3
    return words


@pytest.mark.parametrize("least", [3, 24])
def test_all_runs_at_every_scale(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = [periodic_words(rng) if rng.random() < 0.8 else [] for _ in range(rng.randint(1, 5))]
        codes = {w: i for i, w in enumerate({w for t in texts for w in t})}
        found = pr.find_in(np.array([codes[w] for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), least)
        for words, runs in zip(texts, found):
            assert [tuple(r) for r in runs.tolist()] == brute(words, least)


def test_selection_depends_on_the_context_alone():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    twice = np.concatenate([hashes[100:140], hashes, hashes[100:140]])
    place = set(pr.selected(twice, np.zeros(len(twice), bool), 8).tolist())
    assert place and {p for p in place if p < 32} == {p - 140 for p in place if 140 <= p < 172}
    assert not len(pr.selected(twice, np.ones(len(twice), bool), 8))


def test_texts_edges_and_columns(spark):
    nested = ("a b c " * 9 + "x ") * 4  # runs inside a run
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "é é " * 30), (4, "é é " * 30), (5, "a " * 23), (6, "A a " * 12), (7, nested), (None, "b " * 40)]
    docs = spark.createDataFrame([(k, t, 7, "r") for k, t in rows], "doc_id long, text string, key int, runs string")
    found = pr.find_runs(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for key, text in rows:
        words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        row = by_id[key]
        runs = [(r.start, r.length, r.period) for r in row.runs]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (row.n_words, runs) == (len(words), brute(words, 24))
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert by_id[4].n_words == 30 and by_id[5].runs == [] and len(by_id[7].runs) == 5
    assert pr.find_runs(docs.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(2)
    block = [f"w{rng.randrange(40)}" for _ in range(9_001)]
    words = ["v"] * 100 + block * 3 + [f"u{i}" for i in range(20_000)]
    row = pr.find_runs(spark.createDataFrame([("k", " ".join(words))], "id string, body string"), "id", "body").first()
    assert [(r.start, r.length, r.period) for r in row.runs] == [(0, 100, 1), (100, 27_003, 9_001)]
    assert row.collapsed.split(" ") == ["v"] + block + words[27_103:]

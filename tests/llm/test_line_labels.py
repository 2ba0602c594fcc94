import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import line_labels as ll

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by their definitions."""
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(bool(WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rng = random.Random(6)
    parts = ["a", "Be", "é", "日本語", "$$", "x|y", "\n", "\n", " ", "\t", "\r\n", "\x0b", "\x1c", "\xa0", "end.", "12", "a b c", "\x00"]
    out = [None, "", "\n\n", " \x0c", "one", "a b c a b c", "x\nx\n x\nx", "w " * 60]
    return out + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(80)] + ["a\n" * 3_000]


def test_counts_edges_and_columns(spark):
    rows = list(enumerate(texts())) + [(5, "a b c a b c"), (None, "w " * 60)]
    docs = spark.createDataFrame([(k, t, 3, False, "c") for k, t in rows], "doc_id long, text string, key int, kept boolean, content string")
    field = ll.Field(np.zeros(len(ll.FEATURES)), np.zeros((2, 2)))
    done = ll.label_lines(docs, field).collect()
    assert len(done) == len(rows)
    found = {r.doc_id: r for r in done}
    for key, text in rows:
        row, counts = found[key], brute(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts, text
        assert list(row.content) == [True if WORD.search(line) else None for line in (text or "").split("\n")]
        assert row.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and row.kept == (not row.base_failed)
    assert ll.label_lines(docs.limit(0), field).count() == 0


def paths(field, scores):
    """Every labelling with its score."""
    for labels in itertools.product((0, 1), repeat=len(scores)):
        yield labels, sum(s for s, y in zip(scores, labels) if y) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for size in [0, 1, 2, 7, 9]:
        for _ in range(20):
            field, scores = ll.Field(np.zeros(1), rng.normal(size=(2, 2)) * 2), rng.normal(size=size).tolist()
            best = max(paths(field, scores), key=lambda p: p[1])[0]
            assert field.decode(scores) == [y == 0 for y in best]


def test_likelihood_and_gradient():
    rng = np.random.default_rng(2)
    features = rng.integers(0, 2, (3, 5, 4)).astype(float)
    labels, used = rng.integers(0, 2, (3, 5)), np.arange(5) < np.array([[5], [3], [1]])
    field = ll.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    value, slope = ll.likelihood(field, features, labels, used)
    expected = 0.0
    for x, y, u in zip(features, labels, used):
        scored = dict(paths(field, field.scores(x[u]).tolist()))
        expected += scored[tuple(y[u])] - np.logaddexp.reduce(list(scored.values()))
    assert value == pytest.approx(expected)
    at = lambda w, s: ll.likelihood(ll.Field(field.weights + w, field.steps + s), features, labels, used)[0]
    for i in range(4):
        step = np.eye(4)[i] * 1e-6
        assert slope.weights[i] == pytest.approx((at(step, 0) - at(-step, 0)) / 2e-6, abs=1e-4)
        step = step.reshape(2, 2)
        assert slope.steps.ravel()[i] == pytest.approx((at(0, step) - at(0, -step)) / 2e-6, abs=1e-4)


def test_without_both_labels_everything_is_content(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "$$ $$")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, quality int")
    field = ll.fit(docs, labels)
    assert not field.weights.any() and ll.fit(docs.limit(0), labels.limit(0)).decode([0.0]) == [True]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    field = ll.fit(docs, labels.where(apart))
    done = ll.label_lines(docs, field).join(labels.where(~apart), "doc_id").where("n_words >= 50").collect()
    right = [(2 * r.content_words >= r.n_words) == (r.quality == 1) for r in done]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)
    assert not any(r.kept for r in done if r.quality == 0)

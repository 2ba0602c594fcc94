import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from veritrail.llm import document_tree as dt

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, k=10):
    """{item: [(key, score), ...]} by scoring every document."""
    counts = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    total, df = sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    out = {}
    for item, words in asked.items():
        scored = []
        for key, c in counts:
            m = 25 + 75 * sum(c.values()) * len(counts) // total
            score = sum(times * math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, times in words.items() if t in c)
            if score > 0:
                scored.append((key, score))
        scored.sort(key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
        if scored:
            out[item] = scored[:k]
    return out


def corpus(rng, n, vocabulary=60):
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "ab-c", "X1", "日本"]
    pick = lambda: words[min(int(rng.expovariate(0.08)), len(words) - 1)]
    texts = [" ".join(pick() for _ in range(rng.choice([1, 3, 20, 80]))) for _ in range(n)]
    return texts + texts[: n // 3]


def listed(frame, item="item_id", key="doc_id"):
    out = {}
    for row in sorted(frame.collect(), key=lambda r: r["rank"]):
        assert row["rank"] == len(out.setdefault(row[item], [])) + 1
        out[row[item]].append((row[key], row["score"]))
    return out


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_best_documents_of_every_item(spark, block_bytes):
    rng = random.Random(4)
    docs = [(i, t) for i, t in enumerate(corpus(rng, 400))] + [(9_000, None), (9_001, ""), (9_002, " -!\n"), (None, "w0 w1"), (3, "w1 W2")]
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 4, 30])))) for i in range(9)]
    items += [(20, None), (21, "?"), (22, "nowhere"), (23, "É ab c x1 日本 w0 w0"), (2, "w5 w6"), (None, "w7 w9")]
    frame = spark.createDataFrame([(k, t, 1, "n", [0]) for k, t in docs], "doc_id long, text string, key int, score string, numbers array<int>")
    asked = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id int, text string, item string")
    assert listed(dt.rank_documents(frame.repartition(5), asked, block_bytes=block_bytes)) == brute(docs, items)


def test_text_keys_ties_and_empty_tables(spark):
    docs = [(f"d{i:03}", "alpha beta") for i in range(300)] + [("a", "alpha")]
    frame = spark.createDataFrame(docs, "id string, body string")
    asked = spark.createDataFrame([("q", "beta Alpha")], "q string, words string")
    found = listed(dt.rank_documents(frame, asked, "id", "body", "q", "words", k=4), "q", "id")
    assert found == brute(docs, [("q", "beta Alpha")], 4) and [k for k, _ in found["q"]] == ["d000", "d001", "d002", "d003"]
    assert dt.rank_documents(frame.limit(0), asked, "id", "body", "q", "words").count() == 0
    assert dt.rank_documents(frame, asked.limit(0), "id", "body", "q", "words").count() == 0


def test_every_subtree_bounds_its_documents(monkeypatch):
    monkeypatch.setattr(dt, "LEAF_DOCUMENTS", 4)
    rng = random.Random(8)
    texts = [t.encode() for t in corpus(rng, 300) + ["w0 w1 w2 w3"] * 50]
    block = dt.Block([1, 2], [b"w0 w3 w3 w9 w20", b"w1 w2 w40 w41"])
    n, row, number, times = block.vectors(texts)
    ranking = dt.Ranking(block, len(texts), int(n.sum()), dict(enumerate(np.bincount(number).tolist())))
    place, sizes = ranking.place[number], np.bincount(row, minlength=len(texts))
    by_path = np.lexsort((place, row))
    tree = dt.Tree(sizes, place[by_path], times[by_path], ranking.measure(n), ranking.size)
    seen = []

    def walk(node, item):
        if node.children is None:
            seen.append(node.documents)
            return int(node.bounds(*item).max())
        best = [walk(child, item) for child in node.children]
        assert all(bound >= found for bound, found in zip(node.bounds(*item), best))
        return max(best)

    for item in ranking.items:
        seen.clear()
        walk(tree.root, item)
        assert sorted(np.concatenate(seen).tolist()) == list(range(len(texts))) and len(seen) > 20
        looked = []
        tree.search(*item, lambda docs, scores: looked.extend(docs) or 1)
        assert len(looked) < len(texts)


def test_a_long_chain_of_splits_ends_in_leaves(monkeypatch):
    monkeypatch.setattr(dt, "LEAF_DOCUMENTS", 1)
    sizes = np.arange(1, 301)  # every document is the one before and one more term
    place = np.concatenate([np.arange(s) for s in sizes])
    tree = dt.Tree(sizes, place, np.ones(len(place), np.int64), np.full(300, 25), 300)
    found = []
    tree.search(np.array([299]), np.array([1]), lambda docs, scores: found.extend(docs.tolist()) or 1)
    assert found == [299]

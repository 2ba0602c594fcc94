import hashlib
import random

import numpy as np
import pytest

from veritrail.llm import window_dedup as wd
from veritrail.llm.queries import QUERIES


def plain(rows):
    """The rule by a table of all 100-byte strings."""
    raw = [(k, (t or "").encode()) for k, t in rows]
    order = sorted(range(len(raw)), key=lambda i: (raw[i][0] is None, raw[i][0] or 0, hashlib.sha256(raw[i][1]).digest(), i))
    seen, out = set(), {}
    for i in order:
        body = raw[i][1]
        gone = bytearray(len(body))
        for s in range(len(body) - 99):
            w = body[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\x01" * 100
            seen.add(w)
        spans = sum(1 for j in range(len(body)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[i] = (raw[i][0], len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [out[i] for i in range(len(raw))]


def corpus(copies=40):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["the", "of", "wörd", "thandorin", "ing", "Ête", "ha"]) + str(rng.randrange(99)) for _ in range(n))
    passages = [say(40) for _ in range(4)] + ["x" * 150, "ab" * 120, "the " * 60]
    texts = []
    for _ in range(60):
        texts.append(" ".join(rng.choice([say(rng.randint(1, 40)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))))
    texts += [texts[3]] * 5 + [texts[4][:-7] + "changed", texts[5][50:], texts[6][:99], texts[6][:100], texts[6][:101]]
    texts += [f"{say(3)} {passages[0]} {say(4)}" for _ in range(copies)]
    rng.shuffle(texts)
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    rows += [(1, None), (3, ""), (5, "a"), (rows[2][0], rows[2][1]), (rows[9][0], rows[12][1] + rows[9][1]), (None, rows[1][1]), (None, say(30)),
             (7, "\x00" * 300), (9, "\x00" * 150 + say(20)), (2, "the " * 400_000)]
    return rows


@pytest.mark.parametrize("hot,block", [(wd.HOT, wd.BLOCK_BYTES), (20, 5_000)])
def test_query_equals_brute_force(spark, tmp_path, hot, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    saved, wd.BLOCK_BYTES = (wd.BLOCK_BYTES, wd.remove_repeats.__defaults__, wd.BUCKET_DOCUMENTS), block
    try:
        wd.remove_repeats.__defaults__ = (*saved[1][:-1], hot)
        wd.BUCKET_DOCUMENTS = 300 if hot == 20 else saved[2]
        got = [tuple(r) for r in QUERIES["op3_window_dedup"](spark, str(tmp_path)).collect()]
    finally:
        wd.BLOCK_BYTES, wd.remove_repeats.__defaults__, wd.BUCKET_DOCUMENTS = saved
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got, want = sorted(got, key=order), sorted(plain(rows), key=order)
    assert [g for g, w in zip(got, want) if g != w][:3] == [w for g, w in zip(got, want) if g != w][:3]
    assert len(got) == len(want) and sum(w[2] for w in want) > 10_000


def test_anchor_covers_every_window_once():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (99, 100, 101, 3_000)] + [b"z" * 700]
    text, place, low, high, _ = wd.anchors(texts)
    starts = sorted((int(t), int(p) - wd.LEFT + c) for t, p, lo, hi in zip(text, place, low, high) for c in range(lo, hi + 1))
    assert starts == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)]
    long = [texts[3] * 500]
    text, place, low, high, _ = wd.anchors(long)
    assert int((high - low + 1).sum()) == len(long[0]) - 99


def test_column_order_marks_all_but_the_earliest():
    rng = np.random.default_rng(2)
    docs = np.repeat(rng.integers(97, 100, (30, wd.WIDTH), dtype=np.uint8), 3, axis=0)
    docs[:, wd.LEFT:wd.LEFT + wd.GRAM] = 120
    for i in range(len(docs)):
        docs[i, rng.integers(wd.WIDTH)] = 121
        docs[i, wd.LEFT:wd.LEFT + wd.GRAM] = 120
    low, high = np.zeros(len(docs), int), np.full(len(docs), wd.LEFT)
    rank = rng.permutation(len(docs))
    marks = wd.repeated(np.zeros(len(docs), np.uint64), docs, low, high, rank)
    for c in range(wd.LEFT + 1):
        first = {}
        for i in np.argsort(rank):
            window = docs[i, c:c + 100].tobytes()
            assert marks[i, c] == (window in first)
            first.setdefault(window, i)


def test_empty_table(spark):
    assert wd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from veritrail.llm import lm_scoring as lm
from veritrail.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "\n"


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [END]


def corpus():
    rng = random.Random(8)
    words = ["w%d" % i for i in range(80)]
    rows = []
    for i in range(260):
        at, out = rng.randrange(80), []
        for _ in range(rng.randint(1, 60)):
            at = (at * 3 + rng.choice([1, 1, 2, 7])) % 80
            out.append(words[at] if rng.random() < 0.97 else f"rare{rng.randrange(10 ** 6)}")
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(out).title()))
    return rows + [(300, None), (301, ""), (302, " \r\n"), (303, "É\x1cé\xa0A"), (304, "w1 " * 50_000), (5, rows[5][1]), (None, "w1 w2")]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lm")
    spark.createDataFrame([(*r, "x") for r in corpus()], "doc_id long, text string, keys string").repartition(3).write.parquet(
        str(path / "documents.parquet"))
    small, lm.BLOCK_TOKENS = lm.BLOCK_TOKENS, 900
    keys, lm.BUCKET_KEYS = lm.BUCKET_KEYS, 9_000
    try:
        return QUERIES["op1_lm_scoring"](spark, str(path)).collect()
    finally:
        lm.BLOCK_TOKENS, lm.BUCKET_KEYS = small, keys


def test_contract_columns_equal_brute_force(done):
    rows = corpus()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    counts = Counter(t for i, x in rows if crc(i) != 1 for t in tokens(x))
    total, vocabulary = sum(counts.values()), len(counts)
    want = []
    for i, x in rows:
        ts = tokens(x)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (vocabulary + 1))) for t in ts)
        want.append((i if i is not None else -1, crc(i) == 1, len(ts), sum(counts[t] > 0 for t in ts), total, round(base, 6)))
    got = [(r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in done]
    assert sorted(got) == sorted(want)


def test_scores_equal_brute_force_with_the_learned_weights(spark, done):
    """The mixture by plain counting, its weights by plain expectation-maximisation without a grid."""
    rows = corpus()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    flags = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").select("doc_id", lm.deleted().alias("d")).distinct().collect()
    gone = {r.doc_id for r in flags if r.d}
    train = [(i, tokens(x)) for i, x in rows if crc(i) != 1]

    def counted(texts):
        one, two, context = Counter(), Counter(), Counter()
        for ts in texts:
            one.update(ts)
            two.update(zip(["^"] + ts, ts))
            context.update((["^"] + ts)[:-1])
        return one, two, context, sum(one.values())

    vocabulary = len(counted([t for _, t in train])[0])

    def estimates(ts, model):
        one, two, context, total = model
        for h, t in zip(["^"] + ts, ts):
            c = context[h]
            yield c, [1 / (vocabulary + 1), one[t] / total if total else math.nan, two[h, t] / c if c else math.nan]

    kept = counted([t for i, t in train if i not in gone])
    cells = [(int(math.log2(c)) + 1 if c else 0, *p) for i, t in train if i in gone for c, p in estimates(t, kept)]
    weights = {}
    for bucket in {c[0] for c in cells}:
        p = np.array([c[1:] for c in cells if c[0] == bucket])
        use, p, w = ~np.isnan(p), np.nan_to_num(p), np.full(3, 1 / 3)
        for _ in range(lm.ROUNDS):
            share = w * use * p
            w = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1e-3
            w /= w.sum()
        weights[bucket] = w
    top = max(weights)
    full, table, last = counted([t for _, t in train]), {}, np.full(3, 1 / 3)
    for bucket in range(top + 1):
        table[bucket] = last = weights.get(bucket, last)
    want = []
    for i, x in rows:
        score = 0.0
        for c, p in estimates(tokens(x), full):
            w = table[min(int(math.log2(c)) + 1 if c else 0, top)] * ~np.isnan(p)
            score += math.log10(float((w / w.sum() * np.nan_to_num(p)).sum()))
        want.append((i if i is not None else -1, score))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in done)
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert np.allclose([g[1] for g in got], [w[1] for w in sorted(want)], rtol=0.01, atol=0.05)  # the grid's step
    held = [r for r in done if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_follow_the_evidence():
    good = pd.DataFrame({"bucket": [3] * 2, "q0": [-160.0] * 2, "q1": [-80.0] * 2, "q2": [-8.0, lm.NEVER], "n": [90, 10]})
    w = lm.learn_weights(good, 2)[3]
    assert w.sum() == pytest.approx(1) and w[2] > 0.8 and w[1] > w[0]


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score_texts(df.where("false"), ~lm.held_out(), lm.deleted()).count() == 0
    from pyspark.sql import functions as F
    rows = lm.score_texts(df, F.lit(False), lm.deleted()).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in rows)

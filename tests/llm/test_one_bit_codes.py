import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import one_bit_codes as ob


def brute(rows, k, asked):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if not asked(q):
            continue
        scores = {}
        for i, w in ok:
            if i != q and len(w) == len(v):
                a, b = np.array(v), np.array(w)
                s = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
                scores[i] = max(s, scores.get(i, -2))
        best = sorted(((round(-s, 9), i) for i, s in scores.items()))[:k]
        out.setdefault(q, []).append([(i, -s) for s, i in best])
    return out


def test_codes_estimate_within_the_bound():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((400, 64)), rng.standard_normal((30, 64))
    bits, scalars = ob.encode(x)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    found, error = ob.estimate(bits, scalars, unit @ ob.rotation(64))
    true = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T
    assert bits.shape == (400, 8)
    assert (np.abs(found - true) <= ob.CONFIDENCE * error[:, None]).mean() > 0.999
    assert abs((found - true).mean()) < 0.01


@pytest.mark.parametrize("block_bytes", [64, 4 << 20])
def test_search_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((6, 16))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 6] + 0.3 * rng.standard_normal(16)]) for i in range(300)]
    hot = rows[0][1]
    rows += [(i, hot) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15),
             (505, [float("inf")] * 16), (None, hot), (506, [1.0, 2.0]), (510, [2.0, 1.0]), (507, [5.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], "vec_id long, embedding array<double>, score string")
    done = {}
    for r in ob.search(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes).collect():
        done.setdefault(r.query_id, []).append(r)
    want = brute(rows, 5, lambda q: q % 10 == 0)
    assert set(done) == {q for q, v in want.items() if v[0]}
    for q, found in done.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, len(found) + 1))
        assert [r.vec_id for r in found] == [i for i, _ in want[q][0]], q
        assert np.allclose([r.score for r in found], [s for _, s in want[q][0]], atol=1e-12 + 1e-8)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ob.search(df, F.col("vec_id") % 50 == 0).count() == 0

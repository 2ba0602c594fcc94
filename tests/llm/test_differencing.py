import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veritrail.llm import differencing as kk
from veritrail.llm.queries import QUERIES


def spread(sizes, bins, shards):
    loads = np.bincount(bins, sizes, shards)
    return int(loads.max() - loads.min())


def plain_differencing(sizes, shards):
    """The rule on lists of sets, without any shortcut."""
    tuples = [sorted([(s, {i})] + [(0, set())] * (shards - 1), key=lambda x: -x[0]) for i, s in enumerate(sizes)]
    while len(tuples) > 1:
        tuples.sort(key=lambda t: t[-1][0] - t[0][0])
        a, b = tuples.pop(0), tuples.pop(0)
        tuples.append(sorted(((x + y, p | q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda x: -x[0]))
    return tuples[0][0][0] - tuples[0][-1][0]


def test_differencing_balances_like_the_plain_rule():
    rng = random.Random(0)
    for n, shards in ((1, 3), (2, 2), (5, 2), (60, 3), (300, 7)):
        sizes = np.array(sorted((rng.randint(16, 5000) for _ in range(n)), reverse=True))
        bins = kk.difference(sizes, shards)
        assert len(bins) == n and set(bins) <= set(range(shards))
        assert abs(spread(sizes, bins, shards) - plain_differencing(list(sizes), shards)) <= 60
    assert spread(np.array([8, 7, 6, 5, 4]), kk.difference(np.array([8, 7, 6, 5, 4]), 2), 2) == 2


@pytest.mark.parametrize("part,last", [(200, 300), (kk.PART, kk.LAST)])
def test_query_contract(spark, tmp_path, part, last):
    rng = random.Random(4)
    texts = ["t%d " % i + "é" * rng.randint(0, 900) for i in range(1500)] + ["copy"] * 700 + [None, "", "big " * 20_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    done = kk.shard_rows(df, shards=5, part=part, last=last).collect()
    assert len(done) == len(rows)
    of = dict((i, t or "") for i, t, _ in rows)
    loads, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in done:
        raw = of[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[raw].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) <= 0.005 * sum(loads.values()), dict(loads)


def test_a_group_larger_than_a_share_stands_alone(spark):
    rows = [(i, "hot text " * 30) for i in range(900)] + [(1000 + i, f"{i} " + "x" * (i % 97)) for i in range(600)]
    done = kk.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, part=100, last=300).collect()
    hot = {r.shard for r in done if r.doc_id < 900}
    assert len(hot) == 1 and not any(r.shard in hot for r in done if r.doc_id >= 1000)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op10_differencing"](spark, str(tmp_path)).count() == 0

import os
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from veritrail.llm import spaced_seeds as ss
from veritrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")
def test_every_whole_item_is_found_and_nothing_far_from_one(spark):
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    rows = QUERIES["op7_spaced_seeds"](spark, FOLDER).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(found) == len(rows)
    assert {(d, i) for d, t in docs.items() for i, b in items.items() if b in t} <= found
    for r in rows:
        own, other = ([w for w in (x.strip(ss._PUNCTUATION) for x in ss.words_of(t)) if w] for t in (docs[r.doc_id], items[r.item_id]))
        a, b = own[r.doc_start:r.doc_end], other[r.item_start:r.item_end]
        assert len(a) == len(b) == r.n_words and sum(x == y for x, y in zip(a, b)) == r.n_equal >= 0.8 * r.n_words
        assert r.n_words >= min(ss.MIN_WORDS, len(other))


@pytest.mark.parametrize("block_bytes", [120, 4 << 20])
def test_substitutions_edges_and_blocks(spark, block_bytes):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (30, 18, 14, 5, 1)]
    swap = lambda ws, places: [("zz" if i in places else w) for i, w in enumerate(ws)]
    noise = lambda n: [word() for _ in range(n)]
    docs = {
        1: noise(5) + items[0] + noise(4), 2: swap(items[0], {7, 15, 22}), 3: noise(50), 4: items[0][:15] + noise(9),
        5: items[0][:8] + noise(9), 6: noise(3) + items[3] + noise(2), 7: swap(items[3], {2}), 8: items[1] + items[2],
        9: [w.upper() + "," for w in items[1]], 10: noise(100_000) + items[2] + noise(20), 11: items[4],
    }
    rows = [(i, " ".join(ws), 1) for i, ws in docs.items()] + [(12, None, 1), (13, "", 1), (14, " !! ", 1), (1, " ".join(docs[1]), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)] + [(7, None), (8, ""), (9, "...")],
                                  "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in ss.find_overlaps(df, bench, block_bytes=block_bytes).collect()]
    assert sorted(found) == [(1, 0), (1, 0), (2, 0), (4, 0), (6, 3), (7, 3), (8, 1), (8, 2), (9, 1), (10, 2), (11, 4)]
    clean = sorted(r.doc_id for r in ss.keep_clean(df, bench, block_bytes=block_bytes).collect())
    assert clean == [3, 5, 12, 13, 14]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert ss.find_overlaps(docs.where("false"), bench).count() == 0
    assert ss.find_overlaps(docs, bench.where("false")).count() == 0
    assert ss.keep_clean(docs, bench.where("false")).count() == 1


def plain_best(equal, least, share):
    """(most equal words, size, start) of all stretches, listed one by one."""
    found = [(-sum(equal[i:j]), j - i, i) for i in range(len(equal)) for j in range(i + least, len(equal) + 1)
             if sum(equal[i:j]) >= share * (j - i)]
    return min(found) if found else None


def test_best_stretch_is_that_of_a_full_search():
    rng = random.Random(5)
    for _ in range(3_000):
        equal = [rng.random() < rng.choice((0.6, 0.8, 0.9)) for _ in range(rng.randint(1, 40))]
        least, share = rng.choice((1, 5, 13)), rng.choice((0.5, 0.8, 0.85, 1.0))
        want, got = plain_best(equal, least, Fraction(str(share))), ss.best_stretch(np.array(equal), least, share)
        assert (None if got is None else (-got[2], got[1] - got[0], got[0])) == want


def test_every_hit_alignment_with_a_qualifying_stretch_is_reported():
    rng = random.Random(6)
    hasher = ss.Hasher()
    for _ in range(1_500):
        size = rng.randint(13, 40)
        item = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        text = [f"n{rng.randrange(10**9)}" for _ in range(rng.randint(0, 6))]
        changed = set(rng.sample(range(size), rng.randint(0, size // 4)))
        text += [f"x{rng.randrange(10**9)}" if i in changed else w for i, w in enumerate(item)]
        text += [f"n{rng.randrange(10**9)}" for _ in range(rng.randint(0, 6))]
        block = ss.Benchmark([(1, " ".join(item))])
        words = hasher.hashes(" ".join(text))
        found = block.overlaps(words, np.array([0, len(words)]), 13, 0.8)
        want = []
        for _, shift in block.alignments(words).tolist():
            places = range(max(0, -shift), min(size, len(text) - shift))
            best = plain_best([item[i] == text[i + shift] for i in places], 13, Fraction(4, 5))
            want += [best] if best else []
        assert [-r[6] for r in found] == ([min(want)[0]] if want else [])


@pytest.mark.parametrize("size, changed", [(14, {6, 7}), (13, {12}), (16, {1, 8, 14}), (30, {5, 6, 12, 13, 20, 21})])
def test_substitutions_near_an_end_or_side_by_side(size, changed):
    stretch = ss.best_stretch(np.array([i not in changed for i in range(size)]), 13, 0.8)
    assert stretch is not None and stretch[2] >= 0.8 * (stretch[1] - stretch[0])


@pytest.mark.parametrize("size, changed", [(13, 2), (15, 3), (20, 4), (25, 5)])
def test_masks_meet_every_pattern_of_substitutions(size, changed):
    """All minimal stretches that qualify: longer ones contain one of these."""
    masks = [sum(1 << i for i, c in enumerate(m) if c == "1") << at for m in ss.MASKS for at in range(size - len(m) + 1)]
    patterns = np.array([sum(1 << i for i in places) for places in itertools.combinations(range(size), changed)])
    met = np.zeros(len(patterns), bool)
    for mask in masks:
        met |= (patterns & mask) == 0
    assert met.all()


@pytest.mark.parametrize("size", range(1, 13))
def test_short_items_are_found_with_every_pattern_of_substitutions(size):
    """All ways to change as many words as the share allows, and one more, between other words and at the text's edges."""
    hasher = ss.Hasher()
    item = [f"w{i}" for i in range(size)]
    block = ss.Benchmark([(1, " ".join(item))])
    most = size // 5
    for around in (0, 3):
        for changed in [*itertools.combinations(range(size), most), *itertools.combinations(range(size), most + 1)]:
            noise = [f"n{i}" for i in range(around)]
            text = noise + [f"x{i}" if i in changed else w for i, w in enumerate(item)] + noise
            words = hasher.hashes(" ".join(text))
            found = block.overlaps(words, np.array([0, len(words)]), 13, 0.8)
            assert [r[2:] for r in found] == ([(around, around + size, 0, size, size - most)] if len(changed) == most else [])


def test_short_and_long_items_of_one_block_against_all_alignments():
    rng = random.Random(8)
    hasher = ss.Hasher()
    for _ in range(300):
        items = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 12))] for _ in range(6)]
        text = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 20))]
        for item in rng.sample(items, 2):
            text += [rng.choice("abcxyz") if rng.random() < 0.15 else w for w in item]
        block = ss.Benchmark([(i, " ".join(ws)) for i, ws in enumerate(items)])
        words = hasher.hashes(" ".join(text))
        found = {(r[1], r[2], r[6]) for r in block.overlaps(words, np.array([0, len(words)]), 13, 0.8)}
        want = set()
        for i, item in enumerate(items):
            places = [(-sum(a == b for a, b in zip(item, text[at:])), at) for at in range(len(text) - len(item) + 1)]
            if places and -5 * min(places)[0] >= 4 * len(item):
                want.add((i, min(places)[1], -min(places)[0]))
        assert found == want

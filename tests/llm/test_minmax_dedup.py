import random
import re

import numpy as np

from veritrail.llm import minmax_dedup as mm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_classes(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            best[find(i)] = min(key, best.get(find(i), key))
    return [(k, len(s), best.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def corpus():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)] + ["É%d" % i for i in range(9)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 140))]
        texts.append(base)
        for _ in range(rng.randint(0, 12)):
            copy = list(base if rng.random() < 0.6 else texts[-1])
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rows = [" ".join(t) for t in texts]
    rng.shuffle(rows)
    rows += [None, "", " \n", "a b", "a b", "A\tB", "one", rows[0], rows[0].upper(), "a b c d e", "x " * 400, "long word " * 30_000]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(0, rows[0]), (3, "a b"), (None, rows[2]), (None, "nobody else has this"), (None, None)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, kept int")
    done = [(r.doc_id, r.n_shingles, r.component_id) for r in mm.classes(df).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(done, key=order) == sorted(plain_classes(rows), key=order)


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    shared = rng.integers(1 << 62, size=600, dtype=np.uint64)
    a = np.unique(np.concatenate([shared, rng.integers(1 << 62, size=100, dtype=np.uint64)]))
    b = np.unique(np.concatenate([shared, rng.integers(1 << 62, size=100, dtype=np.uint64)]))
    s = mm.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.12
    assert mm.similar(a, b) and not mm.similar(a, b[:500]) and mm.band_keys(s).shape == (2, 32)


def test_star_of_copies_and_empty_table(spark):
    # copies that resemble the original but not one another, all ids of copies smaller than the original's
    rng = random.Random(6)
    base = ["b%d" % i for i in range(400)]
    rows = [(900, " ".join(base))]
    for i in range(25):
        copy = list(base)
        for at in range(i, 400, 29):
            copy[at] = f"c{i}_{at}_{rng.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = [(r.doc_id, r.n_shingles, r.component_id) for r in mm.classes(df).collect()]
    assert sorted(done) == sorted(plain_classes(rows))
    assert mm.classes(df.where("false")).count() == 0


def test_cut_sets_lose_no_link():
    rng = np.random.default_rng(3)
    # 6 of 8 values shared, two of the shared ones equal in their first 24 bits
    same = np.array([1, 2, 3, 4, 5, 5], np.uint64) * np.uint64(1 << 40) + np.arange(6, dtype=np.uint64)
    pairs = [[np.sort(np.append(same, np.uint64(last << 40))) for last in (8, 9)]]
    for _ in range(2_000):
        pool = (rng.integers(40, size=30, dtype=np.uint64) << np.uint64(40)) + np.arange(30, dtype=np.uint64)
        pairs.append([np.sort(rng.choice(pool, rng.integers(15, 30), replace=False)) for _ in range(2)])
    links = 0
    for a, b in pairs:
        x, y = (mm.unshortened(mm.shortened(s)) for s in (a, b))
        if mm.similar(a, b, 75):
            links += 1
            assert mm.may_be_similar(len(np.intersect1d(x, y)), len(a), len(x), len(b), len(y), 75)
    assert mm.similar(*pairs[0], 75) and links > 100


def test_small_blocks_and_many_classes(spark, monkeypatch):
    """Families near the threshold: buckets with several classes, split into many blocks, against all pairs."""
    monkeypatch.setattr(mm, "BLOCK", 7)
    draw, docs = random.Random(3), []
    for family in range(4):
        for _ in range(40):
            words = [f"w{family}_{i}" for i in range(120)]
            for _ in range(draw.randrange(6)):
                words[draw.randrange(120)] = f"x{draw.random()}"
            docs.append((len(docs), " ".join(words)))
    sets = [set(mm.Shingler().shingles(text).tolist()) for _, text in docs]
    smallest = list(range(len(docs)))
    moved = True
    while moved:
        moved = False
        for a in range(len(docs)):
            for b in range(a):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared) and smallest[a] != smallest[b]:
                    smallest[a] = smallest[b] = min(smallest[a], smallest[b])
                    moved = True
    found = mm.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(smallest))

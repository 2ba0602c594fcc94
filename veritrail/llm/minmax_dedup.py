"""Near-duplicates by min-max hashing.

A document's set holds its distinct 5-word shingles. Under every permutation both the smallest and the largest value are
kept, so 64 permutations give 128 signature values. Bands of four values, all smallest or all largest and of different
permutations, go to buckets; at a similarity of 0.75 a pair misses all 32 bands once in about 200,000 times. Links are
confirmed on the full sets, and the classes are the connected components of the confirmed links.

Documents with equal sets are one node. No bucket lists its pairs. First every node is confirmed against the
first members of its buckets, the two smallest of them, and the links give classes. Buckets that still span several classes are
looked through, one of those with the same members: the members outside the bucket's largest class meet all members of other
classes inside tasks, as sorted arrays of hashes cut to 24 bits, and each pair in the smallest bucket it shares only; what may
reach the threshold, whatever the cut merged, is confirmed on the full sets. So no link between different texts is lost to a cap, and the rows made grow with the members, not with
their pairs. A large bucket is split into blocks of ``BLOCK`` members. Counts and minima combine before the shuffle, and
components come from label passing with shortcuts over tables; nothing is collected but counts.

Null and empty texts have empty sets and are linked with nothing. Fewer than five words are one shingle. Repeated rows
and repeated ids are rows of their own; null ids never become a component id unless a class has no other. Other columns
are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare
from veritrail.session import Job

WORDS = 5
PERMUTATIONS = 64
ROWS = 4  # signature values in a band
MIN_PERCENT = 75
MEMO = 200_000
AT_ONCE = 400_000  # shingles hashed together
BLOCK = 1_500  # members of a bucket compared in one task


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    odd = rng.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


class Shingler:
    """The set of a text as sorted 64-bit hashes; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMO:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        total = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            total = mixed(total ^ hashes[i:i + len(total)])
        return np.unique(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest values of all permutations, then the largest ones, for every (non-empty) set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for i, (factor, shift) in enumerate(zip(*permutations())):
        moved = values * factor + shift
        out[:, i] = np.minimum.reduceat(moved, starts)
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(moved, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band: documents x bands."""
    bands = signature.shape[1] // ROWS
    parts = signature.reshape(len(signature), bands, ROWS)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key ^ parts[:, :, i])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = MIN_PERCENT) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def shortened(found: np.ndarray) -> bytes:
    """A set's hashes cut to 24 bits, as their number and compressed differences."""
    short = np.unique((found >> np.uint64(40)).astype(np.uint32))
    steps = np.diff(short, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(short).to_bytes(4, "little") + pa.compress(steps, codec="zstd", asbytes=True)


def unshortened(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    steps = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(steps.reshape(4, -1).T.copy().view(np.uint32).reshape(-1), dtype=np.uint32)


@lru_cache(maxsize=1)
def marks() -> np.ndarray:
    """A mark for every cut hash; whoever sets some clears them again."""
    return np.zeros(1 << 24, np.bool_)


def may_be_similar(shared, size, short, other_size, other_short, percent: int):
    """False only for pairs of sets that are no link, from what their cut sets share: of the values that both sets have,
    cutting merges at most as many as it merges in either."""
    most = shared + np.minimum(size - short, other_size - other_short)
    return 100 * most >= percent * (size + other_size - most)


def _signed(docs: DataFrame) -> DataFrame:
    """(key, n_shingles, node, bands) of every row (key, text); no node and no bands for an empty set."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes, nodes, bands = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            held: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                for (i, _), keys in zip(held, band_keys(signatures([s for _, s in held]))):
                    bands[i] = keys.tolist()
                held.clear()

            waiting = 0
            for i, text in enumerate(texts):
                found = shingler.shingles(text)
                if len(found):
                    sizes[i], nodes[i] = len(found), xxhash.xxh3_128_digest(found.tobytes())
                    held.append((i, found))
                    waiting += len(found)
                    if waiting > AT_ONCE:
                        flush()
                        waiting = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["key", "n_shingles", "node", "bands"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_shingles long, node binary, bands array<long>")


def _zipped(rows: DataFrame) -> DataFrame:
    """(key, zipped) of every row (key, text): the text is compressed before it is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            zipped = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(zipped, pa.binary())], names=["key", "zipped"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, zipped binary")


def _unzipped(data: bytes) -> str:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return raw.decode("utf-8", "surrogatepass")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, set, short, full) of rows with a text: the set, its hashes cut to 24 bits, its size."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                found = [shingler.shingles(_unzipped(t)) for t in batch.column("zipped").slice(start, 128).to_pylist()]
                found = [s for s in found if len(s)]
                if not found:
                    continue
                short = [shortened(s) for s in found]
                raw = [s.tobytes() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s) for s in raw], pa.binary()), pa.array(raw, pa.binary()),
                     pa.array(short, pa.binary()), pa.array(list(map(len, found)), pa.int32())],
                    names=["node", "set", "short", "full"])

    return docs.select("zipped").mapInArrow(run, "node binary, set binary, short binary, full int")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (pivot, node) that are links."""
    sets = sets.select("node", "set")
    left = pairs.join(sets, "node")
    both = left.join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                    for a, b in zip(batch.column("set").to_pylist(), batch.column("pivot_set").to_pylist())]
            yield batch.select(["pivot", "node"]).filter(pa.array(keep, pa.bool_()))

    return both.select("pivot", "node", "set", "pivot_set").mapInArrow(run, "pivot binary, node binary")


def components(edges: DataFrame, job: Job, name: str) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the smallest node that can be reached."""
    both = job.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                    f"{name}-edges")
    labels = job.keep(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("hop"), F.col("label").alias("old"))
        # a label is itself a node: take over where its own label has got to
        short = moved.join(labels.select(F.col("node").alias("hop"), F.col("label").alias("further")), "hop")
        fresh = job.keep(short.select("node", F.least("hop", "further").alias("label"),
                                      (F.least("hop", "further") != F.col("old")).alias("changed")), f"{name}-{step}")
        done = fresh.where("changed").isEmpty()
        labels = fresh.select("node", "label")
        job.drop(f"{name}-{step - 1}")
        if done:
            return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = MIN_PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    spark = prepare(docs.sparkSession)
    job = Job(spark, "minmax-dedup")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    signed = job.keep(_signed(rows), "signed")
    nodes = job.keep(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("key").alias("first_key"), F.first("bands").alias("bands"), F.first(F.col("n_shingles").cast("int")).alias("size")),
        "nodes")
    buckets = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = job.keep(buckets.join(crowded.select("bucket"), "bucket"), "members")
    labels = None
    if not members.isEmpty():
        labels = _linked(rows, nodes, members, job, percent)
    own = signed.select("key", "n_shingles", "node")
    if labels is None:
        found = nodes.select("node", F.col("first_key").alias("component_id"))
    else:
        named = nodes.select("node", "first_key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lowest = named.groupBy("label").agg(F.min("first_key").alias("component_id"))
        found = named.join(lowest, "label").select("node", "component_id")
    full = own.where("node IS NOT NULL").join(found, "node").select("key", "n_shingles", "component_id")
    empty = own.where("node IS NULL").select("key", "n_shingles", F.col("key").alias("component_id"))
    result = full.unionByName(empty).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
    return job.finish(result.withColumnRenamed("key", key))


def _linked(rows: DataFrame, nodes: DataFrame, members: DataFrame, job: Job, percent: int) -> DataFrame | None:
    """(node, label): the class of every node that has a link."""
    met = members.select("node").distinct()
    wanted = nodes.select("node", F.col("first_key").alias("key")).join(met, "node", "left_semi").select("key")
    some = rows.where("text IS NOT NULL")
    sources = _zipped(some).join(wanted, "key", "left_semi").unionByName(
        _zipped(some.where("key IS NULL")))  # a set whose rows all lack an id
    sets = _sets(sources).dropDuplicates(["node"]).join(met, "node", "left_semi")
    sets = job.keep(sets, "sets")

    heads = members.groupBy("bucket").agg(F.min(F.struct("node", "size")).alias("head"))
    heads = heads.select("bucket", F.col("head.node").alias("pivot"), F.col("head.size").alias("pivot_size"))
    near = 100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size")
    met = members.join(heads, "bucket").where((F.col("node") != F.col("pivot")) & near)
    firsts = met.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("pivot")), 1, 2).alias("p"))  # of 32
    pairs = firsts.select("node", F.explode("p").alias("pivot")).select("pivot", "node")
    links = job.keep(_confirmed(pairs, sets, percent), "links0")
    labels = None if links.isEmpty() else components(_edges(links), job, "classes0")

    more = job.keep(_confirmed(_across(members, labels, sets, job, percent), sets, percent), "links1")
    if more.isEmpty():
        return labels
    return components(_edges(links.unionByName(more)), job, "classes1")


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _across(members: DataFrame, labels: DataFrame | None, sets: DataFrame, job: Job, percent: int) -> DataFrame:
    """(pivot, node): pairs of different classes that share a bucket and may be links."""
    if labels is None:
        placed = members.select("bucket", "node", F.col("node").alias("label"))
    else:
        placed = members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"), *marked)
    split = sizes.groupBy("bucket").agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("largest"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("classes > 1")
    # buckets with the same members hold the same pairs: one of them is enough
    split = split.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("largest").alias("largest"))
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK))).cast("int")
    split = split.select("bucket", F.col("largest.label").alias("main"), blocks(F.col("n")).alias("blocks"),
                         blocks(F.col("n") - F.col("largest.n")).alias("other_blocks"))
    active = job.keep(placed.join(split, "bucket").withColumn("other", F.col("label") != F.col("main")).drop("main"), "active")
    every = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    mine = active.select("bucket", "node", "label", "other", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"),
                         F.explode(every).alias("other_block"), F.lit(False).alias("asks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asking = active.where("other").select(
        "bucket", "node", "label", "other", F.explode(every).alias("block"),
        F.pmod(F.xxhash64("node"), "other_blocks").cast("int").alias("other_block"), F.lit(True).alias("asks"))
    places = active.groupBy("node").agg(F.collect_list("bucket").alias("places"))  # 32 at most
    rows = mine.unionByName(asking).join(sets.select("node", "short", "full").join(places, "node"), "node")
    rows = rows.withColumn("earlier", F.filter("places", lambda place: place < F.col("bucket"))).drop("places")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[~frame["asks"]], frame[frame["asks"]]
        if left.empty or right.empty:
            return pd.DataFrame({"pivot": [], "node": []})
        earlier = [np.asarray(places, np.int64) for places in left["earlier"]]
        owner = np.repeat(np.arange(len(earlier)), [len(places) for places in earlier])
        earlier = np.concatenate(earlier)
        shorts = [unshortened(s) for s in left["short"]]
        sizes = np.array([len(s) for s in shorts])
        full = left["full"].to_numpy(np.int64)
        nodes, labels, other = left["node"].to_numpy(), left["label"].to_numpy(), left["other"].to_numpy()
        marked = marks()
        out = []
        for node, label, short, places, size in zip(*(right[c] for c in ("node", "label", "short", "earlier", "full"))):
            take = (labels != label) & (~other | (nodes > node))
            take &= 100 * np.minimum(full, size) >= percent * np.maximum(full, size)
            take[owner[np.isin(earlier, np.asarray(places, np.int64))]] = False  # met in a smaller bucket
            at = np.flatnonzero(take)
            if not len(at):
                continue
            own = unshortened(short)
            values = np.concatenate([shorts[i] for i in at])
            marked[own] = True
            starts = np.cumsum(sizes[at]) - sizes[at]
            shared = np.add.reduceat(marked[values], starts, dtype=np.int64)
            marked[own] = False
            close = at[may_be_similar(shared, full[at], sizes[at], size, len(own), percent)]
            out += [(node, nodes[i]) for i in close]
        return pd.DataFrame(out, columns=["pivot", "node"])

    found = rows.groupBy("bucket", "block", "other_block").applyInPandas(run, "pivot binary, node binary")
    return job.keep(found, "across").distinct()

"""Ranked lexical search over documents held as frequency-ordered term paths in prefix trees.

For a set of items (queries) every document is restricted to the items' terms, and its terms, each with its number of
occurrences ``tf``, are put in order of falling document frequency. Documents of a task are inserted into a trie by that
order, so those with the same frequent terms share a path. Every subtree keeps, for each term below or on its path, the
largest ``tf``, and the smallest length measure ``m`` of its documents; as the score of a term grows with ``tf`` and falls
with ``m``, these bound the score of all documents below. An item walks the tree depth first, the subtree with the highest
bound first, and leaves out every subtree whose bound is below the k-th best score the task has seen. Where few documents
are left a path ends in a leaf, whose documents are scored one by one. The result is exact.

The score is that of integer BM25: ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` for a term, ``m = 25 + (75 n N) div L`` for a
document of ``n`` terms, and the sum of ``w * ((1000000000 tf) div (1000 tf + 8 m))`` over the item's terms with repeats. N
documents have a term at all, L is the number of all their terms.

Documents are dealt as they are read; the vectors of one block of items are written, ``df`` is summed over them, and every
task builds trees of bounded size and passes on k documents for each item. Nothing is joined, and the only shuffles are
sums and the final ranks. Items are taken in blocks of bounded bytes, one after another; the blocks do not change the result.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Null, empty and
term-free texts count neither in N nor in the results; neither do items without a term. Rows of one item id are one item
with the terms of all of them. Every row of ``docs`` is a document, also one with a repeated or null key; equal scores rank
by key, null first. Only documents with a score above 0 are listed. Only keys and texts are read of either table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import prepare
from veritrail.operators.keys import top_per_key
from veritrail.session import Job

RESULTS = 10
BLOCK_BYTES = 4 << 20  # of item texts that are searched at once
TREE_DOCUMENTS = 8_192  # in one tree
TREE_ENTRIES = 4_000_000
LEAF_DOCUMENTS = 128
SPLITS = 64  # on one path; what is below the last lies in one leaf
CELLS = 2_000_000  # (row, term) pairs scored in one step

_TERM_BYTES = bytes(
    32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if b < 0x5B and b > 0x40 else b
    for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TERM_BYTES).split() if text else []


class _Numbers(dict):
    """Terms to numbers; -1 for all others."""

    def __missing__(self, term: bytes) -> int:
        return -1


class Block:
    """Some items: their ids, and the terms of each as (numbers, repeats)."""

    def __init__(self, ids: list, texts: list[bytes | None]):
        found: dict = {}
        for id, text in zip(ids, texts):
            found.setdefault(id, Counter()).update(terms(text))
        self.ids = list(found)
        self.numbers = _Numbers()
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        for counts in found.values():
            own = [self.numbers.setdefault(t, len(self.numbers)) for t in counts]
            self.items.append((np.array(own, np.int64), np.array(list(counts.values()), np.int64)))

    def vectors(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text; row, term number, occurrences of the restricted vectors by row and number)."""
        listed = [terms(t) for t in texts]
        sizes = np.array([len(t) for t in listed], np.int64)
        number = np.fromiter((self.numbers[t] for text in listed for t in text), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(texts)), sizes)
        cell, times = np.unique((row * max(1, len(self.numbers)) + number)[number >= 0], return_counts=True)
        return sizes, cell // max(1, len(self.numbers)), cell % max(1, len(self.numbers)), times


class Ranking:
    """How a block's items score: term weights, and the terms' places by falling document frequency."""

    def __init__(self, block: Block, documents: int, total: int, frequency: dict[int, int]):
        self.documents, self.total, self.size = documents, total, max(1, len(block.numbers))
        df = np.array([frequency.get(i, 0) for i in range(len(block.numbers))], np.int64)
        self.place = np.empty(len(df), np.int64)
        self.place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.items = []
        for own, times in block.items:
            by_place = np.argsort(self.place[own])
            by_place = by_place[df[own[by_place]] > 0]
            self.items.append((self.place[own[by_place]], weight[own[by_place]] * times[by_place]))

    def measure(self, n: np.ndarray) -> np.ndarray:
        return 25 + (75 * n * self.documents) // self.total


class Node:
    """Rows of a tree that are bounded together: the children of one place, or the documents of a leaf.

    ``entries`` has for every row its terms' places and largest occurrences, ``m`` the smallest length measure."""

    def __init__(self, row: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray, size: int,
                 children: list[Node] | None = None, documents: np.ndarray | None = None):
        self.keys, self.tf, self.m, self.size = row * size + place, tf, m, size
        self.children, self.documents = children, documents

    def bounds(self, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The score that no document of a row exceeds; for documents the score itself."""
        out = np.zeros(len(self.m), np.int64)
        step = max(1, CELLS // max(1, len(place)))
        for start in range(0, len(out) if len(self.keys) else 0, step):
            wanted = (np.arange(start, min(start + step, len(out)))[:, None] * self.size + place).ravel()
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            tf = np.where(self.keys[at] == wanted, self.tf[at], 0).reshape(-1, len(place))
            part = (1_000_000_000 * tf) // (1000 * tf + 8 * self.m[start:start + step, None])
            out[start:start + step] = (part * weight).sum(axis=1)
        return out

    def merged(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The places, largest occurrences and smallest measure of all rows together."""
        place = self.keys % self.size
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        most = np.maximum.reduceat(self.tf[order], first) if len(first) else self.tf
        return place[order][first], most, int(self.m.min())


class Tree:
    """Documents by their paths. ``sizes`` entries of ``place`` (ascending) and ``tf`` belong to each document."""

    def __init__(self, sizes: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray, size: int):
        self.sizes, self.place, self.tf, self.m, self.size = sizes, place, tf, m, size
        self.starts = np.cumsum(sizes) - sizes
        self.root = self._grow(np.arange(len(sizes)))

    def _leaf(self, documents: np.ndarray) -> Node:
        sizes = self.sizes[documents]
        at = np.repeat(self.starts[documents] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Node(np.repeat(np.arange(len(documents)), sizes), self.place[at], self.tf[at], self.m[documents], self.size,
                    documents=documents)

    def _branches(self, documents: np.ndarray, depth: int) -> tuple[list[np.ndarray], int]:
        """The documents by their term at the first depth where they part; small neighbouring branches are joined."""
        while True:
            open_ = self.sizes[documents] > depth
            term = np.full(len(documents), -1, np.int64)
            term[open_] = self.place[self.starts[documents[open_]] + depth]
            if len(term) == 0 or term.min() != term.max() or term[0] == -1:
                break
            depth += 1
        order = np.argsort(term, kind="stable")
        groups = np.split(documents[order], np.flatnonzero(np.diff(term[order])) + 1)
        joined: list[list[np.ndarray]] = [[]]
        for group in groups:
            if joined[-1] and sum(map(len, joined[-1])) + len(group) > LEAF_DOCUMENTS:
                joined.append([])
            joined[-1].append(group)
        return [np.concatenate(g) for g in joined], depth + 1

    def _grow(self, documents: np.ndarray) -> Node:
        """The tree below a place, children before their parents, without recursion."""
        done: list[Node] = []
        todo: list[tuple] = [("open", documents, 0, 0)]
        while todo:
            step, documents, depth, splits = todo.pop()
            if step == "close":
                children = done[-splits:]
                del done[-splits:]
                parts = [c.merged() for c in children]
                done.append(Node(np.repeat(np.arange(splits), [len(p) for p, _, _ in parts]), np.concatenate([p for p, _, _ in parts]),
                                 np.concatenate([t for _, t, _ in parts]), np.array([m for _, _, m in parts]), self.size, children))
                continue
            groups = []
            if len(documents) > LEAF_DOCUMENTS and splits < SPLITS:
                groups, depth = self._branches(documents, depth)
            if len(groups) < 2:
                done.append(self._leaf(documents))
            else:
                todo.append(("close", None, 0, len(groups)))
                todo += [("open", g, depth if len(g) > LEAF_DOCUMENTS else 0, splits + 1) for g in reversed(groups)]
        return done[0]

    def search(self, place: np.ndarray, weight: np.ndarray, offer) -> None:
        """Every document that can be among the best goes to ``offer(documents, scores) -> least score of interest``."""
        least, todo = offer(np.zeros(0, np.int64), np.zeros(0, np.int64)), [(np.iinfo(np.int64).max, self.root)]
        while todo:
            bound, node = todo.pop()
            if bound < least:
                continue
            bounds = node.bounds(place, weight)
            good = np.flatnonzero(bounds >= max(1, least))
            if node.children is None:
                least = offer(node.documents[good], bounds[good])
            else:
                todo += [(int(bounds[i]), node.children[i]) for i in good[np.argsort(bounds[good], kind="stable")]]


class _Best:
    """The k best (score, key) of every item that a task has seen."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [[] for _ in range(items)]

    def offer(self, item: int, keys: list, order: np.ndarray, documents: np.ndarray, scores: np.ndarray) -> int:
        rows = self.rows[item]
        if len(documents):
            chosen = np.lexsort((order[documents], -scores))[:self.k]
            rows += [(int(scores[i]), keys[documents[i]]) for i in chosen]
            rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]) if r[1] is not None else (-r[0], False))
            del rows[self.k:]
        return rows[-1][0] if len(rows) == self.k else 1


def _search_tree(ranking: Ranking, best: _Best, batches: list[pa.RecordBatch]) -> None:
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = table.column("key").to_pylist()
    order = np.empty(len(keys), np.int64)
    order[sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]) if keys[i] is not None else (False,))] = np.arange(len(keys))
    column = lambda name: table.column(name).combine_chunks()
    sizes = np.array(column("numbers").value_lengths(), np.int64)
    place = ranking.place[column("numbers").flatten().to_numpy()]
    by_path = np.lexsort((place, np.repeat(np.arange(len(sizes)), sizes)))
    tree = Tree(sizes, place[by_path], column("times").flatten().to_numpy()[by_path].astype(np.int64),
                ranking.measure(column("n").to_numpy()), ranking.size)
    for item, (places, weights) in enumerate(ranking.items):
        if len(places):
            tree.search(places, weights, lambda docs, scores, item=item: best.offer(item, keys, order, docs, scores))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """The items' rows in blocks of about ``block_bytes``; all rows of an id are in one."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-int(total) // block_bytes)
    for number in range(blocks):
        yield items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).toArrow()


def _vectors(rows: DataFrame, block, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, row, number, times = block.value.vectors(batch.column("text").to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype("int32"))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype("int32"))) for x in (number, times)]
            out = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), *lists], names=["key", "n", "numbers", "times"])
            yield out.filter(pa.array(n > 0))

    return rows.mapInArrow(run, f"key {kind}, n long, numbers array<int>, times array<int>")


def _search(vectors: DataFrame, ranking, ids: pa.Array, k: int, key_kind: str, item_kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best, waiting, kind = ranking.value, None, [], None
        for batch in batches:
            if best is None:
                best, kind = _Best(len(own.items), k), batch.column("key").type
            waiting.append(batch)
            entries = sum(len(b.column("numbers").values) for b in waiting)
            if sum(b.num_rows for b in waiting) >= TREE_DOCUMENTS or entries >= TREE_ENTRIES:
                _search_tree(own, best, waiting)
                waiting = []
        if waiting:
            _search_tree(own, best, waiting)
        if best is not None:
            found = [(item, score, key) for item, rows in enumerate(best.rows) for score, key in rows]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[2] for f in found], kind),
                 pa.array([f[1] for f in found], pa.int64())], names=["item", "key", "score"])

    # a document without any of the terms cannot score
    return vectors.where(F.size("numbers") > 0).mapInArrow(run, f"item {item_kind}, key {key_kind}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                   item_text: str = "text", k: int = RESULTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of every item, ranks from 1."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where(F.octet_length("text") > 0)
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("text")).where(F.octet_length("text") > 0)
    key_kind, item_kind = rows.schema["key"].dataType, asked.schema["item"].dataType
    shape = T.StructType([T.StructField("item", item_kind), T.StructField("key", key_kind), T.StructField("score", T.LongType())])
    job, found = Job(spark, "document-tree"), spark.createDataFrame([], shape)
    for number, table in enumerate(_blocks(asked, block_bytes)):
        block = Block(table.column("item").to_pylist(), table.column("text").to_pylist())
        ids = pa.array(block.ids, table.schema.field("item").type)
        vectors = job.keep(_vectors(rows, spark.sparkContext.broadcast(block), key_kind.simpleString()), f"vectors{number}")
        documents, total = vectors.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        counts = vectors.select(F.explode("numbers").alias("number")).groupBy("number").count()
        ranking = Ranking(block, documents, total, {r["number"]: r["count"] for r in counts.collect()})
        hits = _search(vectors, spark.sparkContext.broadcast(ranking), ids, k, key_kind.simpleString(), item_kind.simpleString())
        found = found.unionByName(job.keep(hits, f"hits{number}"))
        job.drop(f"vectors{number}")
    best = top_per_key(found, ["item"], [F.desc("score"), F.col("key")], k)
    return job.finish(best.select(F.col("item").alias(item), F.col("rank").cast("int"), F.col("key").alias(key), "score"))

"""Benchmark decontamination with spaced seeds.

Words are lower-cased (A-Z) and freed of ASCII punctuation at their ends; what is only punctuation is no word. A mask
marks which of some consecutive words count; the hash of the marked words at every place of a benchmark item and of a
training text is a seed, so a substituted word between the marks does not break it. Seeds that meet give an alignment of
text and item; any stretch along it counts as an overlap if it has at least ``min_words`` words, or the whole of a shorter
item, and at least ``min_similarity`` of them are equal, wherever the others stand.
The masks miss no overlap of at least 13 words with 80% of them equal; with smaller limits some may have no seed.
Items too short for them have masks of their own, four words in five at most, which miss no copy with 80% of its words equal;
below five words that share leaves no word to change, and such items are looked for unchanged.

The training texts stay where they are. Benchmark items are taken in blocks of a bounded size, each broadcast; one block
is the ordinary case of the same loop. Hits are verified where they are found, so a passage in a third of all texts
costs each text its own check and no more.

Null or empty texts and items overlap nothing. Repeated rows are each reported. Long texts are read whole. Of several
stretches of one text and item the one with most equal words is reported, ties to the shortest, then to the first.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare

# Fixed masks: 1 marks a word that counts. Found by enumeration: at least one meets every stretch of 13 words with 2 changed,
# 15 with 3, 20 with 4 and 25 with 5. Every stretch of 13 words or more with 80% equal contains one of these: from 26
# words on, one of its two halves has the share too.
MASKS = ("11101111", "11010010111", "111110011", "1100100010111", "1110101001001", "1111111")
# Fixed masks for shorter items: they meet every five words with one changed, and so 5 to 9 words with one and 10 to 12 with
# two, as one half of the latter has at most one.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
SHORT_WORDS = 5
MIN_WORDS = 13
MIN_SIMILARITY = 0.8
BLOCK_BYTES = 4 << 20  # of benchmark text in one broadcast
MEMO = 200_000
_PUNCTUATION = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    """The words of a text; what stays empty without its punctuation is dropped later."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Hasher:
    """64-bit hashes of words, 0 for none; remembers those met before."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        import xxhash

        words = words_of(text)
        known = self.known
        if len(known) > MEMO:
            known.clear()
        for word in set(words).difference(known):
            bare = word.strip(_PUNCTUATION)
            known[word] = (xxhash.xxh3_64_intdigest(bare) | 1) if bare else 0
        found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return found[found != 0]


def _factors(mask: str) -> list[tuple[int, np.uint64]]:
    """(place, odd factor) of every mark."""
    rng = np.random.default_rng(len(mask))
    return [(i, np.uint64(int(rng.integers(1 << 62)) * 2 + 1)) for i, c in enumerate(mask) if c == "1"]


def masks_of(size: int) -> tuple[str, ...]:
    """The masks for an item of ``size`` words."""
    if size >= max(map(len, MASKS)):
        return MASKS
    return SHORT_MASKS if size >= SHORT_WORDS else ("1" * size,)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every place where the mask fits."""
    size = len(hashes) - len(mask) + 1
    total = np.full(max(size, 0), len(mask), np.uint64)
    if size > 0:
        for place, factor in _factors(mask):
            total += hashes[place:place + size] * factor
    return total ^ (total >> np.uint64(31))


def best_stretch(equal: np.ndarray, least: int, min_similarity: float) -> tuple[int, int, int] | None:
    """(start, stop, equal words) of the stretch of at least ``least`` words that has most equal words among those with
    a share of ``min_similarity``; ties to the shortest, then to the first."""
    share = Fraction(min_similarity).limit_denominator(1_000_000)
    matched = np.concatenate([[0], np.cumsum(equal, dtype=np.int64)])
    # a stretch has the share if this does not fall from its start to its stop: whole numbers, so no rounding
    level = share.denominator * matched - share.numerator * np.arange(len(matched))
    highest = np.maximum.accumulate(level[::-1])[::-1]  # of any later stop; never rises
    start = np.arange(len(matched))
    stop = np.searchsorted(-highest, -level, side="right") - 1  # the last possible one
    start = start[stop - start >= least]
    if not len(start):
        return None
    gain = matched[stop[start]] - matched[start]
    most = gain.max()
    start = start[gain == most]
    stop = np.maximum(np.searchsorted(matched, matched[start] + most), start + least)  # the first with as many
    first = int(np.argmin(stop - start))
    return int(start[first]), int(stop[first]), int(most)


class Benchmark:
    """The seeds of one block of items."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]]):
        hasher = Hasher()
        self.ids, self.words = [], []
        for number, text in items:
            words = hasher.hashes(text or "")
            if len(words):
                self.ids.append(number)
                self.words.append(words)
        self.by_mask: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        gathered: dict[str, list[tuple[np.ndarray, int]]] = {}
        for i, words in enumerate(self.words):
            for mask in masks_of(len(words)):
                gathered.setdefault(mask, []).append((seeds(words, mask), i))
        for mask, parts in gathered.items():
            hashes = np.concatenate([p for p, _ in parts])
            item = np.concatenate([np.full(len(p), i, np.int32) for p, i in parts])
            place = np.concatenate([np.arange(len(p), dtype=np.int32) for p, _ in parts])
            order = np.argsort(hashes, kind="stable")
            present = np.zeros(1 << self.BITS, bool)
            present[self._bit(hashes)] = True
            self.by_mask[mask] = hashes[order], item[order], place[order], present

    def _bit(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def alignments(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, place in the words minus place in the item) of the seeds that meet."""
        found = []
        for mask, (hashes, item, place, present) in self.by_mask.items():
            own = seeds(words, mask)
            at = np.flatnonzero(present[self._bit(own)])
            low = np.searchsorted(hashes, own[at])
            high = np.searchsorted(hashes, own[at], side="right")
            counts = high - low
            if counts.any():
                where = np.repeat(at, counts)
                entry = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                found.append(np.stack([item[entry].astype(np.int64), where - place[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def overlaps(self, words: np.ndarray, starts: np.ndarray, min_words: int, min_similarity: float) -> list[tuple]:
        """(text, item id, start, end, item start, item end, equal words) of the best stretch of every text and item.

        ``words`` are those of several texts one after another, ``starts`` where each begins and the last one ends."""
        best: dict[tuple[int, int], tuple] = {}
        for item, shift in self.alignments(words):
            own = self.words[item]
            begin, end = max(0, -shift), min(len(own), len(words) - shift)
            equal = words[begin + shift:end + shift] == own[begin:end]
            # an alignment may touch several texts: look at each part
            first = np.searchsorted(starts, begin + shift, side="right") - 1
            last = np.searchsorted(starts, end + shift - 1, side="right") - 1
            for text in range(first, last + 1):
                lo = max(begin, starts[text] - shift)
                hi = min(end, starts[text + 1] - shift)
                part = equal[lo - begin:hi - begin]
                if part.sum() < min(min_words, len(own)) * min_similarity:
                    continue
                stretch = best_stretch(part, min(min_words, len(own)), min_similarity)
                if stretch is None:
                    continue
                start, stop, matched = stretch
                size = stop - start
                place = int(lo + start + shift - starts[text])
                row = (text, self.ids[item], place, place + size, int(lo + start), int(lo + stop), matched)
                old = best.get((text, item))
                if old is None or (-matched, size, place) < (-old[6], old[3] - old[2], old[2]):
                    best[text, item] = row
        return list(best.values())


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_bytes`` of text, collected one after another."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for number in range(blocks):
        yield Benchmark([(r.item, r.text) for r in rows.where(
            F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()])


def _found(shared, texts: list[str | None], hasher: Hasher, min_words: int, min_similarity: float) -> list[tuple]:
    words = [hasher.hashes(t) if t else np.zeros(0, np.uint64) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return shared.value.overlaps(np.concatenate(words), starts, min_words, min_similarity)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item_id, doc_start, doc_end, item_start, item_end, n_words, n_equal): places in words, ends exclusive."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = None
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for batch in batches:
                found = sorted(_found(shared, batch.column("text").to_pylist(), hasher, min_words, min_similarity))
                columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(7)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(columns[0]), *columns[1:6],
                     pa.array([r[3] - r[2] for r in found], pa.int64()), columns[6]],
                    names=["key", "item_id", "doc_start", "doc_end", "item_start", "item_end", "n_words", "n_equal"])

        part = rows.mapInArrow(run, f"key {kind}, item_id long, doc_start long, doc_end long, item_start long, "
                                    "item_end long, n_words long, n_equal long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
               min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item, as they are."""
    spark = prepare(docs.sparkSession)
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for batch in batches:
                dirty = {r[0] for r in _found(shared, batch.column(text).to_pylist(), hasher, min_words, min_similarity)}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words whose smallest period ``q`` (words ``q`` apart are identical) fits at least three
times, and which no neighbouring word extends. All runs are found, without looking at every distance:

* Periods up to ``DIRECT`` come from the highly periodic regions, which are detected by comparing the words with
  themselves shifted by 1 to ``DIRECT`` places.
* At every dyadic scale ``t`` (4, 8, 16, ...) a position is selected when, among the ``t + 1`` windows of ``t`` words that
  begin in ``[i, i + t]``, the smallest hash stands at one of the two ends. Windows with a period of ``t / 3`` or less
  take no part. Whether a position is selected depends on the ``2 t`` words from it alone, so equal contexts are selected
  alike. Two selected positions with equal contexts ``p`` apart, ``1.5 t <= p < 3 t``, propose the period ``p``.
* A run of period ``p`` in that range holds more than ``t`` places whose context recurs ``p`` further on. None of them can
  be unselected throughout: then all their windows would have a period of ``t / 3`` or less, and so would the run. So
  every run is proposed; the windows left out at a scale lie in runs that smaller scales have found.
* A proposal is extended both ways to its whole length with hashes of 2, 4, 8, ... words, and its words are compared. Of
  proposals with the same place the smallest period counts.

Word hashes have 64 bits: two different stretches of n share one with a chance of about n^2 / 2^64; a stretch proposed
through that is dropped in the comparison. A document is one row and stays where it is; nothing is shuffled, and work
and memory grow as n log^2 n and n log n with its words. A period never crosses documents.

Words are the maximal runs of bytes other than blank, ``\\t \\n \\v \\f \\r``; null and blank texts have none and no runs.
Repeated rows each get their result; an empty table gives an empty one. Only the key and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare

DIRECT = 5  # largest period that shifts detect: a third of the scale 16
FIRST_SCALE = 4
MIN_LENGTH = 24
PERIODS = 3  # a run holds its period so often at least

_NONE = np.uint64(2 ** 64 - 1)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """Texts one after another, longest first, each followed by a word that occurs nowhere else, and the hashes of
    their stretches of 1, 2, 4, ... words. Level ``k`` covers the texts of ``2^k`` words and more."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        first = np.concatenate([[0], np.cumsum(sizes)])
        known = int(codes.max()) + 1 if len(codes) else 0
        parts = []
        for i, text in enumerate(self.order):
            parts += [codes[first[text]:first[text + 1]], np.array([known + i], np.int64)]
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.levels = [_mix((self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))]
        while len(self.sizes) and 2 << len(self.levels) - 1 <= self.sizes[0]:
            half = 1 << len(self.levels) - 1
            below = self.levels[-1][:max(0, self.reach(2 * half) - half + 1)]
            with np.errstate(over="ignore"):
                self.levels.append(_mix(below[:len(below) - half] * np.uint64(0xD6E8FEB86659FD93) + below[half:] * np.uint64(0xA0761D6478BD642F) + np.uint64(half)))

    def reach(self, least: float) -> int:
        """Where the texts with ``least`` words or more end."""
        return int(self.starts[np.searchsorted(-self.sizes, -least, side="right")])

    def extend(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last-but-one place of the stretch around ``at`` in which words ``period`` apart are equal."""
        right, left = at.copy(), at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, size = self.levels[k], 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                fits = right + period < len(level)
                near, far = np.where(fits, right, 0), np.where(fits, right + period, 0)
                right += size * (fits & (level[near] == level[far]))
                fits = (left >= size) & (left - size + period < len(level))
                near = np.where(fits, left - size, 0)
                far = np.where(fits, near + period, 0)
                left -= size * (fits & (level[near] == level[far]))
        return left, right + period


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), one for every start and end: that of the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _shifted(codes: np.ndarray, period: int) -> np.ndarray:
    """The runs of one small period, by comparing the words with those ``period`` places further on."""
    equal = np.zeros(max(0, len(codes) - period) + 2, np.int8)
    equal[1:-1] = codes[:-period] == codes[period:] if len(codes) > period else 0
    change = np.diff(equal)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + period
    long = end - start >= PERIODS * period
    return np.column_stack([start[long], end[long], np.full(long.sum(), period)])


def _left_out(runs: np.ndarray, scale: int, size: int) -> np.ndarray:
    """Which windows of ``scale`` words have a period of a third of it or less."""
    small = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.minimum(small[:, 0], size), 1)
    np.add.at(change, np.minimum(small[:, 1] - scale + 1, size), -1)
    return np.cumsum(change[:-1]) > 0


def selected(hashes: np.ndarray, left_out: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising positions of a scale: the smallest hash of ``[i, i + scale]`` stands at one of the ends."""
    hashes = np.where(left_out, _NONE, hashes)
    size = len(hashes) - scale
    if size <= 0:
        return np.zeros(0, np.int64)
    least, step = hashes, 1
    while step < scale:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:size], hashes[scale:])
    return np.flatnonzero((least != _NONE) & ((least == hashes[:size]) | (least == hashes[scale:])))


def _proposed(words: _Words, runs: np.ndarray, scale: int) -> np.ndarray:
    """(position, period) of the pairs of selected positions with equal contexts at a fitting distance."""
    level = scale.bit_length() - 1
    until = words.reach(1.5 * PERIODS * scale)
    contexts = words.levels[level + 1]
    hashes = words.levels[level][:max(0, until - scale + 1)]
    place = selected(hashes, _left_out(runs, scale, len(hashes)), scale)
    place = place[place < len(contexts)]
    context, found = contexts[place], []
    for ahead in range(1, len(place)):
        apart = place[ahead:] - place[:-ahead]
        near = apart < 3 * scale
        if not near.any():
            break
        fits = near & (2 * apart >= 3 * scale) & (context[ahead:] == context[:-ahead])
        found.append(np.column_stack([place[:-ahead][fits], apart[fits]]))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _confirmed(codes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The runs whose words are equal one period apart, looked at word by word."""
    sizes = runs[:, 1] - runs[:, 0] - runs[:, 2]
    offset = np.cumsum(sizes) - sizes
    at = np.repeat(runs[:, 0] - offset, sizes) + np.arange(sizes.sum())
    wrong = np.concatenate([[0], np.cumsum(codes[at] != codes[at + np.repeat(runs[:, 2], sizes)])])
    return runs[wrong[offset + sizes] == wrong[offset]]


def find_in(codes: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For every text the rows (start, length, period) of its runs, by start and period.

    ``codes`` are the words of all texts one after another as numbers, ``sizes`` how many each text has."""
    words = _Words(codes, sizes)
    runs = _smallest(np.concatenate([_shifted(words.codes, q) for q in range(1, DIRECT + 1)]))
    scale = FIRST_SCALE
    while len(words.sizes) and 1.5 * PERIODS * scale <= words.sizes[0]:
        pairs = _proposed(words, runs, scale)
        if len(pairs):
            start, end = words.extend(pairs[:, 0], pairs[:, 1])
            new = np.unique(np.column_stack([start, end, pairs[:, 1]])[end - start >= PERIODS * pairs[:, 1]], axis=0)
            runs = _smallest(np.concatenate([runs, _confirmed(words.codes, new)]))
        scale *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= min_length]
    text = np.searchsorted(words.starts, runs[:, 0], side="right") - 1
    found = np.column_stack([runs[:, 0] - words.starts[text], runs[:, 1] - runs[:, 0], runs[:, 2]])
    found, text = (x[np.lexsort((found[:, 2], found[:, 0], text))] for x in (found, text))
    cut = np.searchsorted(text, np.arange(len(sizes) + 1))
    out: list[np.ndarray] = [None] * len(sizes)  # type: ignore[list-item]
    for i, own in enumerate(words.order):
        out[own] = found[cut[i]:cut[i + 1]]
    return out


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, n_words, runs, collapsed): every run of ``min_length`` words and more as ``(start, length, period)`` in words,
    and the text with one blank between words and each run cut to its first period."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.split() for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            every = np.empty(int(sizes.sum()), object)
            every[:] = [w for t in texts for w in t]
            runs = find_in(pd.factorize(every)[0].astype(np.int64), sizes, min_length)
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs]
            collapsed = [b" ".join(kept_words(t, r) if len(r) else t).decode("utf-8", "replace") for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes), pa.array(listed, _RUNS), pa.array(collapsed, pa.string())],
                names=["key", "n_words", "runs", "collapsed"])

    found = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("key", key)

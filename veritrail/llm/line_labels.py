"""Content and boilerplate lines by a linear-chain conditional random field.

Every line with a word is described by ``FEATURES``: whether its length, its shares of symbols, capitals, punctuation and
digits, its word length, its last character and its repeats in the text pass fixed marks. A chain of two labels scores
the lines of a text by these and by which label follows which; the best labelling of the whole text is found by Viterbi
decoding. A text is kept if its plain counts do not fail it and half of its words or more stand in content lines.

The field is trained by the gradient of its likelihood (forward and backward sums over all labellings), on a bounded
sample: at most ``sample`` documents of each quality label, those with the smallest hashes of the key, and of each at most
``sample_lines`` lines. Labels are known for whole documents only: lines of documents of quality 1 count as content, of
quality 0 as boilerplate. So that label changes are seen, documents of both kinds are strung together before training.
What is not in the sample is labelled, never learned from; the key and the source of a text are no features.

Every text is read whole, in the task that has it; only the sample, as features, reaches the driver. Without labels of
both kinds all lines count as content. Ties go to content.

Words are the maximal runs of bytes other than blank, ``\\t \\n \\v \\f \\r``. Null counts as the empty text: no words, all
counts 0, not kept. Repeated rows each get their result; an empty table gives an empty one. Only the key and the text are
read, so other columns cannot clash. Of several labels of a key the lowest counts; null labels and keys are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare, whole
from veritrail.operators.keys import top_per_key

SAMPLE = 600  # documents of each label
SAMPLE_LINES = 200  # of each document
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
CONTENT_SHARE = 0.5  # of the words
STRETCH = 64  # lines of one training sequence
ROUNDS, RATE, SHRINK = 150, 0.1, 1e-3

SYMBOLS = b"#*$%&|<>"
SENTENCE_ENDS = b".!?"
FEATURES = [
    "always", "1-2 words", "3-7 words", "40+ words", "2% symbols", "10% symbols", "30% capitals", "70% capitals",
    "8% punctuation", "15% punctuation", "20% digits", "sentence end", "seen before", "half repeated", "long words",
    "short words", "few letters", "sentences inside", "sentence end every other word",
]

_BLANK, _LOWER, _UPPER, _DIGIT, _SYMBOL, _OTHER, _INNER, _LEAD = range(8)
_KIND = np.array([
    _BLANK if b in b" \t\n\v\f\r" else _SYMBOL if b in SYMBOLS else _DIGIT if 48 <= b < 58 else _UPPER if 65 <= b < 91
    else _LOWER if 97 <= b < 123 else _OTHER if b < 128 else _INNER if b < 192 else _LEAD for b in range(256)
], np.uint8)


class Lines(NamedTuple):
    """What is counted in some texts: by text the plain counts, by line its text, words and features."""

    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    line_text: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _repeated(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words stand in a window of three that their text has twice or more. Windows are told apart by 64-bit hashes."""
    out = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return out
    inside = np.flatnonzero(text[2:] == text[:-2])
    x = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        key = text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for ahead, factor in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            key = (key ^ (key >> np.uint64(32)) ^ (x[inside + ahead] + np.uint64(1))) * np.uint64(factor)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for ahead in range(3):
        out[inside[twice] + ahead] = True
    return out


def count_lines(texts: list[bytes]) -> Lines:
    """Counts and features of texts in UTF-8."""
    joined = b"\n".join(texts) + b"\n"  # a text's last line ends like the others
    data = np.frombuffer(joined, np.uint8)
    kind = _KIND[data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line_text = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    lower, upper, digit, symbol, other, lead = (count(kind == k) for k in (_LOWER, _UPPER, _DIGIT, _SYMBOL, _OTHER, _LEAD))
    chars = lower + upper + digit + symbol + other + lead
    filled = kind != _BLANK
    line_words = count(filled & ~np.concatenate([[False], filled[:-1]]))
    by_text = lambda values: np.bincount(line_text, values, len(texts)).astype(np.int64)

    every = joined.split()
    words = np.empty(len(every), object)
    words[:] = every
    word_line = np.repeat(np.arange(len(starts)), line_words)
    repeated = np.bincount(word_line[_repeated(pd.factorize(words)[0], line_text[word_line])], minlength=len(starts))

    lines = np.empty(len(starts), object)
    lines[:] = joined.split(b"\n")[:-1]
    same = line_text * len(starts) + pd.factorize(lines)[0]
    first = np.zeros(len(starts), bool)
    first[np.unique(same, return_index=True)[1]] = True
    again = ~first & (line_words > 0)

    # the last byte of a line that is not blank
    last = np.maximum.accumulate(np.where(filled, np.arange(len(data)), 0))[ends]
    mark = np.isin(data, np.frombuffer(SENTENCE_ENDS, np.uint8))
    closed, marks = mark[last], count(mark & ~np.concatenate([filled[1:], [False]]))
    letters, size = lower + upper + lead, np.maximum(chars, 1)
    features = np.column_stack([
        np.ones(len(starts), bool), line_words <= 2, (line_words >= 3) & (line_words <= 7), line_words >= 40,
        50 * symbol >= size, 10 * symbol >= size, 10 * upper >= 3 * np.maximum(lower + upper, 1), 10 * upper >= 7 * np.maximum(lower + upper, 1),
        25 * other >= 2 * size, 20 * other >= 3 * size, 5 * digit >= size, closed, again, 2 * repeated >= np.maximum(line_words, 1),
        chars >= 12 * line_words, chars < 3 * line_words, 2 * letters < size,
        (marks > 0) & (5 * marks <= 2 * line_words), 2 * marks >= np.maximum(line_words, 1),
    ])
    return Lines(by_text(line_words), by_text(chars), by_text(symbol), by_text(again), by_text(repeated), line_text, line_words, features)


class Field(NamedTuple):
    """Label 0 is content, 1 boilerplate: how much the features speak for 1, and the weight of each label after each."""

    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features.astype(np.float64) @ self.weights

    def decode(self, scores: list[float]) -> list[bool]:
        """Which lines are content in the best labelling of one text."""
        (stay, leave), (enter, remain) = self.steps.tolist()
        content, other, back = 0.0, 0.0, []
        for i, score in enumerate(scores):
            if i:
                from_content, from_other = content + stay >= other + enter, content + leave >= other + remain
                back.append((from_content, from_other))
                content, other = (content + stay if from_content else other + enter), (content + leave if from_other else other + remain)
            other += score
        if not scores:
            return []
        out = [content >= other]
        for from_content, from_other in reversed(back):
            out.append(from_content if out[-1] else from_other)
        return out[::-1]


def likelihood(field: Field, features: np.ndarray, labels: np.ndarray, used: np.ndarray) -> tuple[float, Field]:
    """Log-likelihood of labelled sequences and its gradient. ``features`` is sequences x lines x features; the lines
    where ``used`` is false stand at the ends of sequences and do not count."""
    sequences, size, _ = features.shape
    score = np.stack([np.zeros((sequences, size)), field.scores(features)], axis=2)
    ahead, behind = np.zeros((sequences, size, 2)), np.zeros((sequences, size, 2))
    ahead[:, 0] = score[:, 0]
    for i in range(1, size):
        new = np.logaddexp.reduce(ahead[:, i - 1, :, None] + field.steps, axis=1) + score[:, i]
        ahead[:, i] = np.where(used[:, i, None], new, ahead[:, i - 1])
    for i in range(size - 2, -1, -1):
        new = np.logaddexp.reduce((behind[:, i + 1] + score[:, i + 1])[:, None, :] + field.steps, axis=2)
        behind[:, i] = np.where(used[:, i + 1, None], new, 0.0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    share = np.exp(ahead + behind - total[:, None, None])[..., 1] * used
    weights = ((labels * used - share)[..., None] * features).sum(axis=(0, 1))
    steps, follows = np.zeros((2, 2)), used[:, 1:]
    pair = np.exp(ahead[:, :-1, :, None] + field.steps + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
    value = (score[..., 1] * labels * used).sum() - total.sum()
    for a in (0, 1):
        for b in (0, 1):
            seen = (labels[:, :-1] == a) & (labels[:, 1:] == b) & follows
            steps[a, b] = seen.sum() - (pair[..., a, b] * follows).sum()
            value += seen.sum() * field.steps[a, b]
    return float(value), Field(weights, steps)


def train(documents: list[tuple[np.ndarray, int]], rounds: int = ROUNDS) -> Field:
    """The field for documents given as (lines x features, label), strung together label by label in turn."""
    field = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    groups = [[d for d in documents if d[1] == label and len(d[0])] for label in (0, 1)]
    if not all(groups):
        return field
    turns = [g[i % len(g)] for i in range(max(map(len, groups))) for g in groups]
    lines = np.concatenate([x for x, _ in turns]).astype(np.float64)
    labels = np.concatenate([np.full(len(x), label) for x, label in turns])
    pad = -len(lines) % STRETCH
    used = (np.arange(len(lines) + pad) < len(lines)).reshape(-1, STRETCH)
    lines = np.concatenate([lines, np.zeros((pad, lines.shape[1]))]).reshape(-1, STRETCH, lines.shape[1])
    labels = np.concatenate([labels, np.zeros(pad, labels.dtype)]).reshape(-1, STRETCH)
    flat, n = np.zeros(len(FEATURES) + 4), used.sum()
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for i in range(1, rounds + 1):  # gradient ascent with steps scaled by the gradient's running moments
        _, slope = likelihood(field, lines, labels, used)
        gradient = np.concatenate([slope.weights, slope.steps.ravel()]) / n - SHRINK * flat
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        flat = flat + RATE * (mean / (1 - 0.9 ** i)) / (np.sqrt(square / (1 - 0.99 ** i)) + 1e-9)
        field = Field(flat[:-4], flat[-4:].reshape(2, 2))
    return field


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), whole(text).cast("binary").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field:
    """The field for ``labels(key, label)``, label 1 for content and 0 for boilerplate, of some of ``docs``."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("key").agg(F.min("label").alias("label"))
    chosen = top_per_key(known, ["label"], [F.xxhash64("key"), F.col("key")], sample).drop("rank")
    rows = _texts(docs, key, text).join(F.broadcast(chosen), "key")  # at most 2 * sample rows of two columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_lines(batch.column("text").to_pylist())
            bits = np.packbits(found.features, axis=1)
            own = [bits[(found.line_text == i) & (found.line_words > 0)][:sample_lines].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own, pa.binary())], names=["label", "lines"])

    found = rows.select("key", "label", "text").mapInArrow(run, "label int, lines binary")
    wide = -(-len(FEATURES) // 8)
    read = lambda b: np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, wide), axis=1, count=len(FEATURES))
    return train([(read(r["lines"]), 1 - r["label"]) for r in sorted(found.collect(), key=lambda r: (r["label"], bytes(r["lines"])))])


def label_lines(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words, content, base_failed, kept).

    ``content`` has for every line, split at ``\\n``, whether it is content; null for lines without a word."""
    prepare(docs.sparkSession)
    rows = _texts(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_lines(batch.column("text").to_pylist())
            scores, texts = field.scores(found.features), batch.num_rows
            lined = np.flatnonzero(found.line_words > 0)
            cut = np.searchsorted(found.line_text[lined], np.arange(texts + 1))
            labels = [field.decode(scores[lined[cut[i]:cut[i + 1]]].tolist()) for i in range(texts)]
            content = np.zeros(len(found.line_words), bool)
            content[lined] = [x for own in labels for x in own]
            content_words = np.bincount(found.line_text, found.line_words * content, texts).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(found.line_text, minlength=texts))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(content, pa.bool_(), mask=found.line_words == 0))
            values = [found.words, found.word_chars, found.symbols, found.dup_lines, found.repeat_words, content_words]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, values), listed], names=["key", *counts, "content"])

    found = rows.mapInArrow(run, f"key {kind}, {', '.join(c + ' long' for c in counts)}, content array<boolean>")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    content = F.col("content_words") >= CONTENT_SHARE * F.col("n_words")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & content).withColumnRenamed("key", key)

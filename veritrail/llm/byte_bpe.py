"""Byte-level BPE by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap. The chunks are dealt over the cluster and
pre-tokenised side by side, each from its own first character, so the first pre-tokens of a chunk may be out of step.
The split pattern never looks back: from a boundary on, only what follows counts. So where two neighbours have a
boundary in common inside their overlap they are in step from there on, and the text is cut at the first such place.
The pieces are encoded apart, dealt over the cluster again, and their ids joined in order. Two neighbours without a
common boundary (a run of letters longer than the overlap) leave the rest of that text as one piece: slower, same ids.
A text of one chunk is one piece and is encoded where it lies.

Decoding concatenates the raw bytes of the ids; ids outside the vocabulary raise.

Null text counts as empty and has no ids. Repeated rows each keep their ids; equal long texts are encoded once.
Other columns pass through; a column named like an output is replaced.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import prepare

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
LOOKAHEAD = 2  # characters after a pre-token that can still change where it ends
CHARS_AT_ONCE = 1 << 20  # of texts encoded together
IDS_AT_ONCE = 1 << 17  # decoded together

_NO_IDS = np.zeros(0, np.uint32)


@lru_cache(maxsize=4)
def _vocabulary(path: str):
    """The rank file as an encoder, and its words one after another with the place of each id; once per worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_rank = {rank: word for word, rank in ranks.items()}
    listed = [by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)]
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    return encoder, (np.frombuffer(b"".join(listed), np.uint8), np.cumsum(sizes) - sizes, sizes)


def boundaries(text: str, last: bool, first: int | None = None, second: int = 0) -> list[int]:
    """Where the text may be cut: 0 and the ends of pre-tokens, as far as what follows cannot move them; with ``first``
    only those up to it and from ``second`` on.

    Not after white space: a run of it is split by what comes behind it, which a piece that ends there does not show.
    """
    import regex

    limit = len(text) if last else len(text) - LOOKAHEAD
    sizes = list(map(len, regex.findall(public_tokenizers.PATTERN, text)))
    if sum(sizes) != len(text):  # the pattern leaves characters out
        ends = [m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)]
    else:
        ends = list(accumulate(sizes))
    del ends[bisect_right(ends, limit):]
    within = lambda place: first is None or place <= first or place >= second
    return [0] + [e for e in ends if within(e) and not text[e - 1].isspace()]


def places(bytes_of: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids one after another, and how many each has. Ids outside the vocabulary raise."""
    words, start, sizes = bytes_of
    if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
        raise KeyError("an id is outside the vocabulary")
    size = sizes[ids]
    return words[np.repeat(start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def joined_bytes(bytes_of: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, most: int = IDS_AT_ONCE) -> tuple[bytes, np.ndarray]:
    """``places`` as bytes, at most ``most`` ids at a time: the place of every byte takes many times the byte."""
    found = [places(bytes_of, ids[start:start + most]) for start in range(0, len(ids), most)]
    return b"".join(raw.tobytes() for raw, _ in found), np.concatenate([np.zeros(0, np.int64), *[size for _, size in found]])


def by_size(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch in slices (start, rows) of 128 rows at most, and of ``most`` in size but for single larger rows."""
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and (total + size > most or row - start == 128):
            yield start, batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if batch.num_rows > start:
        yield start, batch.slice(start)


def _with_column(frame: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(frame.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([frame.column(i) for i in kept] + [values],
                                      names=[frame.schema.names[i] for i in kept] + [name])


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _encode_rows(df: DataFrame, text: str, ids: str, path: str) -> DataFrame:
    """``ids`` of each row's text as one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _vocabulary(path)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(text)), 0))
            for _, rows in by_size(batch, sizes, CHARS_AT_ONCE):
                # without special tokens there is none to be allowed or refused
                found = [encoder.encode_to_numpy(t, disallowed_special=()) if t else _NO_IDS for t in rows.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                listed = pa.array(np.concatenate([_NO_IDS, *found]).astype(np.int32))
                yield _with_column(rows, ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed))

    return df.mapInArrow(run, _schema_with(df, ids, T.ArrayType(T.IntegerType())))


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, no, start, part, last) of every text; equal texts once, dealt by key and number."""
    size = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), size - 1), F.lit(chunk))
    rows = texts.select("key", "text", F.posexplode(starts).alias("no", "start"))
    return rows.select(
        "key", "no", "start",
        F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("part"),
        (F.col("start") + chunk + overlap >= size).alias("last"),
    ).dropDuplicates(["key", "no"])


def _edges(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The boundaries of every chunk inside the overlaps it shares with its neighbours, as places in the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads, tails = [], []
            for part, start, last in zip(frame["part"], frame["start"], frame["last"]):
                found = boundaries(part, last, overlap, chunk)
                heads.append([start + b for b in found if b <= overlap])
                tails.append([start + b for b in found if b >= chunk])
            yield frame[["key", "no"]].assign(heads=heads, tails=tails)

    return chunks.select("key", "no", "start", "part", "last").mapInPandas(
        run, "key string, no int, heads array<int>, tails array<int>")


def cut_places(heads: list[list[int]], tails: list[list[int]]) -> list[int | None]:
    """For every chunk but the first the first boundary it shares with the chunk before it; ``None`` for it and all
    later chunks once two neighbours share none."""
    cuts: list[int | None] = []
    for before, after in zip(tails, heads[1:]):
        shared = set(before).intersection(after) if not cuts or cuts[-1] is not None else set()
        cuts.append(min(shared) if shared else None)
    return cuts


def _parts(edges: DataFrame, chunk: int) -> DataFrame:
    """(key, piece, no, from, to): which stretch of which chunk belongs to which piece."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no")
        cuts = cut_places([list(x) for x in frame["heads"]], [list(x) for x in frame["tails"]])
        rows, begin, piece = [], 0, 0
        for no in range(len(frame)):
            cut = cuts[no] if no < len(cuts) else None
            joined = no < len(cuts) and cut is None  # the next chunk goes on with this piece
            end = cut if cut is not None else (no + 1) * chunk if joined else None
            rows.append((piece, no, begin - no * chunk, None if end is None else end - no * chunk))
            begin = end
            piece += not joined
        return pd.DataFrame(rows, columns=["piece", "no", "begin", "end"]).assign(key=frame["key"].iloc[0])

    return edges.groupBy("key").applyInPandas(run, "piece int, no int, begin int, end int, key string")


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", ids: str = "ids",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): the byte-level BPE ids of the whole text."""
    prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = docs.drop(ids)
    size = F.coalesce(F.length(text), F.lit(0))
    short = _encode_rows(docs.where(size <= chunk_chars), text, ids, path)

    own = f"key_{uuid.uuid4().hex}"  # no column of the caller's has this name
    long = docs.where(size > chunk_chars).withColumn(own, F.sha2(F.col(text), 256))
    chunks = _chunks(long.select(F.col(own).alias("key"), F.col(text).alias("text")), chunk_chars, overlap_chars)
    parts = _parts(_edges(chunks, chunk_chars, overlap_chars), chunk_chars)
    stretch = F.substring("part", F.col("begin") + 1,
                          F.when(F.col("end").isNull(), F.length("part")).otherwise(F.col("end") - F.col("begin")))
    pieces = (
        chunks.select("key", "no", "part").join(parts, ["key", "no"])
        .groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("no", stretch.alias("s")))).alias("s"))
        .select("key", "piece", F.array_join("s.s", "").alias("piece_text"))
    )
    encoded = (
        _encode_rows(pieces, "piece_text", "piece_ids", path)
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "piece_ids"))).alias("p"))
        .select(F.col("key").alias(own), F.flatten("p.piece_ids").alias(ids))
    )
    return short.unionByName(long.join(encoded, own).drop(own))


def decode(df: DataFrame, vocabulary: str | None = None, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``df`` with the column ``raw`` (binary): the bytes of the ids one after another; null ids give no bytes."""
    prepare(df.sparkSession)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words = _vocabulary(path)
        for batch in batches:
            counted = np.asarray(pc.fill_null(pc.list_value_length(batch.column(ids)), 0))
            for start, rows in by_size(batch, counted, IDS_AT_ONCE):
                counts = counted[start:start + rows.num_rows]
                flat, size = joined_bytes(words, rows.column(ids).flatten().to_numpy(zero_copy_only=False))
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
                yield _with_column(rows, raw, pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()))

    return df.mapInArrow(run, _schema_with(df, raw, T.BinaryType()))

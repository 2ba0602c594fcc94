"""Removal of repeated 100-byte strings by column-wise construction of many-text suffix orders.

A byte goes if some 100-byte string that covers it also starts earlier: in a text with a smaller key, or further left in
the same text. Strings are judged on the input.

Where to look. In every 100-byte window the smallest hashed 32-gram is its anchor; equal windows have equal anchors at
the same place. Anchors that occur once end there. Around every other anchor the bytes of its windows (at most 168) are a
short document of a collection, and the documents of one anchor value meet in one place.

How they are compared. The documents are aligned on the anchor, so the collection's suffix order and common prefixes are
built column by column from the right: each round puts one symbol in front of every document, sorts stably by it (the
symbols in the order before are the round's Burrows-Wheeler column), and updates the common prefix of neighbours: one
more than the smallest one between their places before. The symbols of the anchor are equal and are put in at once. After
a round of the window columns, neighbours that share 100 symbols and more are one string; all but the earliest start are
marked. Documents that can no longer share 100 symbols with a neighbour are dropped. Many collections are built side by
side in one task; a task's columns are small arrays, so they stay in memory rather than in files.

How it runs. Equal texts are one: all copies but the first go whole. Texts become blocks of some megabytes, written once.
Blocks send their distinct anchor hashes to buckets of the hash space and get back which of them are shared, then send
the shared anchors' documents; equal ones in a block are sent once. An anchor with more than ``HOT`` documents is sent
window by window, each under its own hash, so no collection grows with the corpus. Marks return to the blocks.

Null and empty texts, and those under 100 bytes, keep all. Of repeated rows and equal texts the one with the smallest key
counts as the first; null keys come last. Different texts with one key are ordered by their hash. Other columns are not used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare, whole
from veritrail.session import Job

WINDOW = 100
GRAM = 32
LEFT = WINDOW - GRAM  # bytes of a window that can stand on either side of its anchor
WIDTH = LEFT + WINDOW  # bytes of a document of the collection
BLOCK_BYTES = 3 << 20
STRETCH = 1 << 20  # bytes hashed together
BUCKET_KEYS = 1_000_000
BUCKET_DOCUMENTS = 25_000
HOT = 50_000
LAST_KEY = (1 << 63) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(3).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(28))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes from every place on."""
    values, size = _letters()[data], 1
    while size < GRAM:
        values = mixed(values[:-size] * np.uint64(0xD6E8FEB86659FD93) + values[size:])
        size *= 2
    return values


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place, lowest column, highest column, hash): every anchor of the texts with the columns, from 0 to 68, at
    which the windows begin that it is the anchor of; the anchor itself stands at column 68."""
    found: list[tuple[np.ndarray, ...]] = []
    part: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in part])
        begins = ends - [len(p) for _, _, p in part]
        hashes = gram_hashes(data)
        low = np.uint64(STRETCH * 2 - 1)
        least = (mixed(hashes) & ~low) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while size * 2 <= LEFT + 1:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = LEFT + 1 - size
        least = np.minimum(least[:-rest], least[rest:])
        ok = np.ones(len(least), bool)
        for end in ends:
            ok[max(0, end - WINDOW + 1):end] = False
        start = np.flatnonzero(ok)
        chosen = (least[start] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(first[1:], len(start)) - 1
        at = chosen[first]
        number = np.searchsorted(ends, at, side="right")
        text = np.array([t for t, _, _ in part])[number]
        offset = np.array([o for _, o, _ in part])[number] - begins[number]
        found.append((text, at + offset, start[first] - at + LEFT, start[last] - at + LEFT, hashes[at]))
        part.clear()

    held = 0
    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - WINDOW + 1), STRETCH // 2):
            piece = text[offset:offset + STRETCH // 2 + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            if part and held + len(piece) > STRETCH:
                flush()
                held = 0
            part.append((i, offset, piece))
            held += len(piece)
    if part:
        flush()
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found))


def documents_of(texts: list[bytes], text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes of every anchor's windows, aligned: anchors x 168, zero outside."""
    starts = np.cumsum([LEFT] + [len(t) for t in texts])
    data = np.frombuffer(bytes(LEFT) + b"".join(texts) + bytes(WIDTH), np.uint8)
    columns = np.arange(WIDTH)
    out = np.empty((len(text), WIDTH), np.uint8)
    for s in range(0, len(text), 16_384):
        e = slice(s, s + 16_384)
        out[e] = data[(starts[text[e]] + place[e] - LEFT)[:, None] + columns]
        out[e][(columns < low[e, None]) | (columns >= high[e, None] + WINDOW)] = 0
    return out


def _least_between(common: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest common prefix on the way from place ``before`` to place ``at``."""
    out = common[at]
    far = np.flatnonzero(at > before + 1)
    if len(far):
        sizes = at[far] - before[far]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(before[far] + 1, sizes)
        out[far] = np.minimum.reduceat(common[places], ends - sizes)
    return out


def repeated(group: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows (documents x 69 columns) start earlier elsewhere: ``rank`` orders the documents by their start."""
    marks = np.zeros((len(docs), LEFT + 1), bool)
    order = np.argsort(group, kind="stable")
    _, number = np.unique(group, return_inverse=True)
    # common[i]: common prefix of the documents at places i - 1 and i; -1 between collections
    own = number[order]
    common = np.where(np.concatenate([[True], own[1:] != own[:-1]]), -1, 0)
    for column in range(WIDTH - 1, -1, -1):
        if LEFT <= column < LEFT + GRAM:
            if column == LEFT:
                common = np.where(common < 0, -1, common + GRAM)
            else:
                continue
        else:
            symbol = docs[order, column].astype(np.int64)
            key = own * 256 + symbol
            moved = np.argsort(key, kind="stable")
            key = key[moved]
            before = np.concatenate([[-1], moved[:-1]])
            same = np.concatenate([[False], key[1:] == key[:-1]])
            fresh = np.zeros(len(order), np.int64)
            fresh[same] = _least_between(common, before[same], moved[same]) + 1
            own = own[moved]
            fresh[np.concatenate([[True], own[1:] != own[:-1]])] = -1
            order, common = order[moved], fresh
        if column <= LEFT:
            full = common >= WINDOW
            if full.any():
                heads = np.flatnonzero(~full)
                valid = (low[order] <= column) & (column <= high[order])
                ranks = np.where(valid, rank[order], len(docs))
                first = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, len(order))))
                late = valid & (ranks > first)
                marks[order[late], column] = True
            # a document lives on while it can still share a whole window with a neighbour
            able = common >= WINDOW - column
            stays = able | np.append(able[1:], False)
            if not stays.all():
                heads = ~able
                order, own = order[stays], own[stays]
                common = np.where(heads[stays], -1, common[stays])
                if not len(order):
                    break
                # what is cut off from its neighbours forms a collection of its own
                own = np.cumsum(common < 0) - 1
    return marks


def _marked_ranges(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of the runs of marks."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, first, after - 1


# --- tables -----------------------------------------------------------------------------------------------------------


def _blocks(texts: DataFrame) -> DataFrame:
    """(block, owners, hashes, lengths, data): texts of (owner, hash, text) one after another, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            data = pa.compress(b"".join(t for _, _, t in held), codec="zstd", asbytes=True)
            one = lambda values, kind: pa.array([values], kind)
            return pa.RecordBatch.from_arrays(
                [one(uuid.uuid4().hex, pa.string()), one([o for o, _, _ in held], pa.list_(pa.int64())),
                 one([h for _, h, _ in held], pa.list_(pa.binary())), one([len(t) for _, _, t in held], pa.list_(pa.int64())),
                 one(data, pa.binary())], names=["block", "owners", "hashes", "lengths", "data"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("owner", "hash", "body"))):
                held.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield emit()
                    held.clear()
                    size = 0
        if held:
            yield emit()

    return texts.mapInArrow(run, "block string, owners array<long>, hashes array<binary>, lengths array<long>, data binary")


def _unpacked(lengths, data: bytes) -> list[bytes]:
    ends = np.cumsum(lengths)
    raw = pa.decompress(data, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
    return [raw[e - n:e] for n, e in zip(lengths, ends)]


def _cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The non-empty buckets of sorted hashes."""
    places = np.append(np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)), len(keys))
    return [(b, slice(places[b], places[b + 1])) for b in range(buckets) if places[b] < places[b + 1]]


def _asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, counts): the distinct anchor hashes of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.unique(anchors(_unpacked(row["lengths"], row["data"]))[4], return_counts=True)
                cuts = _cuts(keys, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in cuts], pa.int32()), pa.array([row["block"]] * len(cuts), pa.string()),
                     pa.array([keys[c].tobytes() for _, c in cuts], pa.binary()),
                     pa.array([counts[c].astype(np.int64).tobytes() for _, c in cuts], pa.binary())],
                    names=["bucket", "block", "keys", "counts"])

    return blocks.select("block", "lengths", "data").mapInArrow(run, "bucket int, block string, keys binary, counts binary")


def _answers(asked: DataFrame, hot: int) -> DataFrame:
    """(bucket, block, kinds, documents): for every hash asked 0 (occurs once), 1 (shared) or 2 (hot)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(k) // 8 for k in frame["keys"]]
        keys = np.frombuffer(b"".join(frame["keys"]), np.uint64)
        counts = np.frombuffer(b"".join(frame["counts"]), np.int64)
        _, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts)[at]
        kinds = np.where(total > hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        ends = np.cumsum(sizes)
        shared = [int(counts[e - s:e][kinds[e - s:e] > 0].sum()) for s, e in zip(sizes, ends)]
        return frame[["bucket", "block"]].assign(kinds=[kinds[e - s:e].tobytes() for s, e in zip(sizes, ends)], documents=shared)

    return asked.groupBy("bucket").applyInPandas(run, "bucket int, block string, kinds binary, documents long")


_PACKED = "bucket int, block string, n long, doc binary, body binary"
_META = np.dtype([("hash", np.uint64), ("owner", np.int64), ("name", np.uint64), ("text", np.int64), ("place", np.int64),
                  ("low", np.int64), ("high", np.int64)])


def _pack(bucket: np.ndarray, block: str, meta: np.ndarray, docs: np.ndarray) -> pd.DataFrame:
    rows = []
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        at = at[np.argsort(meta["hash"][at], kind="stable")]
        rows.append((int(b), block, len(at), pa.compress(meta[at].tobytes(), codec="zstd", asbytes=True),
                     pa.compress(docs[at].tobytes(), codec="zstd", asbytes=True)))
    return pd.DataFrame(rows, columns=["bucket", "block", "n", "doc", "body"])


def _sent(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """The documents around shared anchors by bucket; bucket -1 has those that equal an earlier one of the same block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        texts = _unpacked(row["lengths"], row["data"])
        text, place, low, high, hashes = anchors(texts)
        keys = np.unique(hashes)
        kinds = np.frombuffer(b"".join(right.sort_values("bucket")["kinds"]), np.uint8)
        kind = kinds[np.searchsorted(keys, hashes)] if len(keys) else np.zeros(0, np.uint8)
        keep = np.flatnonzero(kind > 0)
        text, place, low, high, hashes, kind = (v[keep] for v in (text, place, low, high, hashes, kind))
        # a hot anchor's windows stand alone
        times = np.where(kind == 2, high - low + 1, 1)
        source = np.repeat(np.arange(len(text)), times)
        step = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
        alone = kind[source] == 2
        text, place = text[source], place[source]
        low = low[source] + np.where(alone, step, 0)
        high = np.where(alone, low, high[source])
        docs = documents_of(texts, text, place, low, high)
        content = np.zeros(len(docs), np.uint64)
        for word in docs.view(np.uint64).T:
            content = mixed(content ^ word) + np.uint64(1)
        meta = np.empty(len(docs), _META)
        meta["hash"] = np.where(alone, mixed(content ^ low.astype(np.uint64)), hashes[source])
        owners = np.array([LAST_KEY if o is None or o != o else int(o) for o in row["owners"]], np.int64)
        names = np.array([int.from_bytes(h[:8], "big") for h in row["hashes"]], np.uint64)
        meta["owner"], meta["name"], meta["text"], meta["place"] = owners[text], names[text], text, place
        meta["low"], meta["high"] = low, high
        # equal documents of this block: the earliest is sent, the others are marked here
        order = np.lexsort((place, meta["name"], meta["owner"], high, low, content))
        equal = np.zeros(len(order), bool)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            equal[1:] = (content[a] == content[b]) & (low[a] == low[b]) & (high[a] == high[b]) & (docs[a] == docs[b]).all(axis=1)
        bucket = np.empty(len(order), np.int64)
        spread = mixed(meta["hash"] + np.uint64(0x51ED27)) >> np.uint64(33)
        bucket[:] = (spread % np.uint64(buckets)).astype(np.int64)
        copies = order[equal]
        sent = np.setdiff1d(np.arange(len(order)), copies)
        out = [_pack(bucket[sent], row["block"], meta[sent], docs[sent])]
        if len(copies):
            out.append(pd.DataFrame({"bucket": [-1], "block": [row["block"]], "n": [len(copies)],
                                     "doc": [pa.compress(meta[copies].tobytes(), codec="zstd", asbytes=True)], "body": [b""]}))
        return pd.concat(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, _PACKED)


_RANGE = np.dtype([("text", np.int64), ("start", np.int64), ("end", np.int64)])


def _ranges(meta: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), _RANGE)
    out["text"] = meta["text"][row]
    out["start"] = meta["place"][row] - LEFT + first
    out["end"] = meta["place"][row] - LEFT + last + WINDOW
    return out


def _unpack_meta(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=int(n) * _META.itemsize, codec="zstd", asbytes=True), _META)


def _judged(sent: DataFrame) -> DataFrame:
    """(block, ranges): the repeated stretches of every block's texts."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        metas = [_unpack_meta(d, n) for d, n in zip(frame["doc"], frame["n"])]
        meta = np.concatenate(metas)
        docs = np.frombuffer(b"".join(pa.decompress(b, decompressed_size=int(n) * WIDTH, codec="zstd", asbytes=True)
                                      for b, n in zip(frame["body"], frame["n"])), np.uint8).reshape(-1, WIDTH)
        rank = np.empty(len(meta), np.int64)
        rank[np.lexsort((meta["place"], meta["name"], meta["owner"]))] = np.arange(len(meta))
        row, first, last = _marked_ranges(repeated(meta["hash"], docs, meta["low"], meta["high"], rank))
        found = _ranges(meta, row, first, last)
        owner = np.searchsorted(np.cumsum([len(m) for m in metas]), row, side="right")
        blocks = frame["block"].to_numpy()
        rows = [(blocks[i], found[owner == i].tobytes()) for i in np.unique(owner)]
        return pd.DataFrame(rows, columns=["block", "ranges"])

    def copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for block, n, doc in zip(frame["block"], frame["n"], frame["doc"]):
                meta = _unpack_meta(doc, n)
                rows.append((block, _ranges(meta, np.arange(len(meta)), meta["low"], meta["high"]).tobytes()))
            yield pd.DataFrame(rows, columns=["block", "ranges"])

    return sent.where("bucket >= 0").groupBy("bucket").applyInPandas(build, "block string, ranges binary").unionByName(
        sent.where("bucket < 0").mapInPandas(copies, "block string, ranges binary"))


def _kept(blocks: DataFrame, judged: DataFrame) -> DataFrame:
    """(key, n_bytes, spans, kept) of the first row of every text."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"key": [], "n_bytes": [], "spans": [], "kept": []})
        row = left.iloc[0]
        texts = _unpacked(row["lengths"], row["data"])
        found = np.frombuffer(b"".join(right["ranges"]), _RANGE)
        found = found[np.lexsort((found["start"], found["text"]))]
        cuts = np.searchsorted(found["text"], np.arange(len(texts) + 1))
        out = []
        for i, (owner, text) in enumerate(zip(row["owners"], texts)):
            spans: list[list[int]] = []
            for start, end in zip(found["start"][cuts[i]:cuts[i + 1]].tolist(), found["end"][cuts[i]:cuts[i + 1]].tolist()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            at, parts = 0, []
            for start, end in spans:
                parts.append(text[at:start])
                at = end
            parts.append(text[at:])
            missing = owner is None or owner != owner or owner == LAST_KEY
            out.append((None if missing else int(owner), len(text), [{"start": s, "end": e} for s, e in spans], b"".join(parts)))
        frame = pd.DataFrame(out, columns=["key", "n_bytes", "spans", "kept"])
        return frame.assign(key=frame["key"].astype("Int64"))

    schema = "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return blocks.groupBy("block").cogroup(judged.groupBy("block")).applyInPandas(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, n_bytes, spans, kept) of every row: the removed byte ranges, and the bytes that stay."""
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))  # blocks are large rows
    job = Job(spark, "window-dedup")
    rows = docs.select(F.col(key).cast("long").alias("key"), whole(text).cast("binary").alias("body"))
    size = F.octet_length("body")
    spans = "array<struct<start:bigint,end:bigint>>"
    short = rows.where(size < WINDOW).select("key", size.cast("long").alias("n_bytes"), F.array().cast(spans).alias("spans"),
                                             F.col("body").alias("kept"))
    long = rows.where(size >= WINDOW).withColumn("hash", F.unhex(F.sha2("body", 256)))
    owned = F.coalesce("key", F.lit(LAST_KEY))  # null keys come last
    texts = long.groupBy("hash").agg(F.min(owned).alias("owner"), F.first("body").alias("body"))
    made = _blocks(texts.select("owner", "hash", "body"))
    made.write.option("compression", "zstd").option("maxRecordsPerFile", 8).parquet(f"{job.folder}/blocks")
    blocks = job.read("blocks", made)
    total = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-total // (35 * BUCKET_KEYS)))  # about one anchor in 35 bytes
    answers = job.keep(_answers(_asked(blocks, buckets), hot), "answers")
    shared = answers.agg(F.sum("documents")).first()[0] or 0
    sent = job.keep(_sent(blocks, answers, max(1, -(-shared // BUCKET_DOCUMENTS))), "sent")
    judged = job.keep(_judged(sent), "judged")
    job.drop("sent", "answers")
    first = _kept(blocks, judged)

    # all other rows of a text go whole
    counted = long.groupBy("hash", "key").agg(F.count("*").alias("rows"), F.first(size).cast("long").alias("n_bytes"))
    owners = counted.groupBy("hash").agg(F.min(F.coalesce("key", F.lit(LAST_KEY))).alias("owner"))
    more = counted.join(owners, "hash").withColumn(
        "more", F.col("rows") - (F.coalesce("key", F.lit(LAST_KEY)) == F.col("owner")).cast("int")).where("more > 0")
    gone = more.select("key", "n_bytes", F.explode(F.sequence(F.lit(1), "more")).alias("_"))
    gone = gone.select("key", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias(
        "spans"), F.lit(b"").alias("kept"))
    return first.unionByName(gone).unionByName(short).withColumnRenamed("key", key)


"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders: word given its context, word alone, and an even share of the
vocabulary and one unknown word. The weights depend on how often the context was seen (buckets by powers of two). They
are learned by expectation-maximisation on held-out counts: a part of the training texts is deleted from the counts, and
the weights that predict this part best are found. The scores then use the counts of all training texts.

How it runs. Tokens become blocks of about ``BLOCK_TOKENS`` tokens with a vocabulary of their own, written once. Every
block sends each of its distinct n-grams once, as 64-bit hashes with counts, to a bucket of the key space; the bucket adds
up all blocks and returns to each block the totals of just the n-grams it asked for. So a frequent n-gram costs one entry
a block, nothing of the size of the vocabulary is broadcast or collected, and the texts are never shuffled. Buckets grow
in number with the tokens and hold about ``BUCKET_KEYS`` entries. For the weights the held-out blocks give a histogram
over a fixed grid (context bucket and the estimates' logarithms in steps of 1/16 octave); only this grid is collected.

Two n-grams share a hash with a chance of their number over 2^64; then both have the sum of their counts.

Tokens are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end. Null and empty texts are just the end. Repeated
rows count and are scored each. Without training texts every token has base log10(1) and the even share. Other columns
are not used.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import fold, prepare
from veritrail.session import Job

ORDER = 2
BLOCK_TOKENS = 400_000
BUCKET_KEYS = 500_000
GRID = 16  # steps of an octave in the histogram of estimates
NEVER = -(1 << 20)  # grid value of an estimate of zero
ROUNDS = 40
_END, _START = 0x5F4D3C2B1A09F8E7, 0x1B873593CC9E2D51


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit numbers, compressed byte place by byte place; ascending ones by their differences."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: type, ascending: bool = False) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=int(size) * 8, codec="zstd", asbytes=True)
    values = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if ascending else values


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, kind, keys, held, train, lengths, words, tokens): kind 1 holds the part deleted for the weights.

    ``words`` are the hashes of the block's distinct words, the end first; ``tokens`` are places in it."""
    key = docs.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def empty() -> dict:
            words = defaultdict(count(1).__next__)
            return {"words": words, "keys": [], "held": [], "train": [], "tokens": [], "size": 0}

        def emit(kind: int, b: dict) -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in b["words"]), np.uint64, len(b["words"]))
            hashes = np.concatenate([np.array([_END], np.uint64), hashes])
            one = lambda values, kind: pa.array([values], kind)
            return pa.RecordBatch.from_arrays(
                [one(uuid.uuid4().hex, pa.string()), one(kind, pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(b["keys"])], pa.int32()), pa.concat_arrays(b["keys"])),
                 one(b["held"], pa.list_(pa.bool_())), one(b["train"], pa.list_(pa.bool_())),
                 one([len(t) for t in b["tokens"]], pa.list_(pa.int32())), one(hashes.tobytes(), pa.binary()),
                 one(np.concatenate(b["tokens"]).tobytes(), pa.binary())],
                names=["block", "kind", "keys", "held", "train", "lengths", "words", "tokens"])

        open_blocks = [empty(), empty()]
        for batch in batches:
            keys = batch.column("key")
            for i, (text, train, deleted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "train", "deleted")))):
                b = open_blocks[deleted]
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                b["tokens"].append(np.fromiter(map(b["words"].__getitem__, words), np.int32, len(words)))
                b["tokens"][-1] = np.append(b["tokens"][-1], np.int32(0))
                b["keys"].append(keys.slice(i, 1))
                b["held"].append(not train)
                b["train"].append(train)
                b["size"] += len(words) + 1
                if b["size"] >= BLOCK_TOKENS:
                    yield emit(int(deleted), b)
                    open_blocks[deleted] = empty()
        for deleted, b in enumerate(open_blocks):
            if b["keys"]:
                yield emit(deleted, b)

    kind = key.simpleString()
    return docs.mapInArrow(run, f"block string, kind int, keys array<{kind}>, held array<boolean>, train array<boolean>, "
                                "lengths array<int>, words binary, tokens binary")


class Grams:
    """The n-grams of a block: per order the distinct ones' hashes in order, and which of them stands at every token."""

    def __init__(self, lengths, words: bytes, tokens: bytes, order: int):
        self.lengths = np.asarray(lengths, np.int64)
        self.tokens = np.frombuffer(tokens, np.int32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashes = np.frombuffer(words, np.uint64)
        self.hashes: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        gram, gram_hash = self.tokens, hashes
        for n in range(1, order + 1):
            if n > 1:
                context = self.before(gram, len(gram_hash))  # one more number stands for the beginning of a text
                code = context * len(hashes) + self.tokens
                distinct, gram = np.unique(code, return_inverse=True)
                context_hash = np.append(gram_hash, np.uint64(_START))[distinct // len(hashes)]
                gram_hash = mixed(mixed(context_hash + np.uint64(n)) ^ hashes[distinct % len(hashes)])
            place = np.argsort(gram_hash, kind="stable")
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            self.hashes.append(gram_hash[place])
            self.at.append(rank[gram])

    def before(self, values: np.ndarray, beginning: int) -> np.ndarray:
        """What stands at the token before, ``beginning`` at the first token of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = beginning
        return out


def _asked(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(n, bucket, block, kind, size, keys, counts): the distinct n-grams of every block with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row["lengths"], row["words"], row["tokens"], order)
                weight = np.repeat(np.array(row["train"], np.float64), grams.lengths)
                for n in range(1, order + 1):
                    keys = grams.hashes[n - 1]
                    counts = np.bincount(grams.at[n - 1], weight, len(keys)).astype(np.int64)
                    cuts = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64))
                    cuts = np.append(cuts, len(keys))
                    full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * len(full), pa.int32()), pa.array(full, pa.int32()),
                         pa.array([row["block"]] * len(full), pa.string()), pa.array([row["kind"]] * len(full), pa.int32()),
                         pa.array([cuts[b + 1] - cuts[b] for b in full], pa.int64()),
                         pa.array([packed(keys[cuts[b]:cuts[b + 1]], True) for b in full], pa.binary()),
                         pa.array([packed(counts[cuts[b]:cuts[b + 1]]) for b in full], pa.binary())],
                        names=["n", "bucket", "block", "kind", "size", "keys", "counts"])

    return blocks.select("block", "kind", "train", "lengths", "words", "tokens").mapInArrow(
        run, "n int, bucket int, block string, kind int, size long, keys binary, counts binary")


def _totals(asked: DataFrame) -> DataFrame:
    """(n, bucket, block, kind, size, all, deleted, tokens, deleted_tokens, distinct): the totals every block asked for;
    the bucket's own sums stand in one of its rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["size"].tolist()
        keys = np.concatenate([unpacked(k, n, np.uint64, True) for k, n in zip(frame["keys"], sizes)])
        counts = np.concatenate([unpacked(c, n, np.int64) for c, n in zip(frame["counts"], sizes)])
        distinct, at = np.unique(keys, return_inverse=True)
        every = np.zeros(len(distinct), np.int64)
        gone = np.zeros(len(distinct), np.int64)
        np.add.at(every, at, counts)
        np.add.at(gone, at, counts * np.repeat(frame["kind"].to_numpy(), sizes))
        ends = np.cumsum(sizes)
        cut = lambda values: [packed(values[at[e - s:e]]) for s, e in zip(sizes, ends)]
        own = lambda value: [int(value)] + [0] * (len(frame) - 1)
        return frame[["n", "bucket", "block", "kind", "size"]].assign(
            all=cut(every), deleted=cut(gone), tokens=own(every.sum()), deleted_tokens=own(gone.sum()),
            distinct=own((every > 0).sum()))

    return asked.groupBy("n", "bucket").applyInPandas(
        run, "n int, bucket int, block string, kind int, size long, all binary, deleted binary, tokens long, deleted_tokens long, distinct long")


def _estimates(grams: Grams, counts: list[np.ndarray], tokens: int, texts: int, vocabulary: int):
    """(estimates per order from 0, the highest context's counts) at every token; NaN where there is no context."""
    estimates = [np.full(len(grams.tokens), 1.0 / (vocabulary + 1))]
    context = np.full(len(grams.tokens), tokens, np.int64)
    for n, own in enumerate(counts, 1):
        at = own[grams.at[n - 1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            estimates.append(np.where(context > 0, at / context, np.nan))
        if n < len(counts):
            context = grams.before(at, texts)
    return estimates, context


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket per power of two."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def _per_block(blocks: DataFrame, totals: DataFrame, order: int, use, schema: str) -> DataFrame:
    """``use(row, grams, all, deleted)`` for every block with the totals of its n-grams."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        grams = Grams(row["lengths"], row["words"], row["tokens"], order)
        right = right.sort_values(["n", "bucket"])
        every, gone = [], []
        for n in range(1, order + 1):
            of = right[right["n"] == n]
            whole = lambda column: np.concatenate([unpacked(x, m, np.int64) for x, m in zip(of[column], of["size"])])  # noqa: E731,B023
            every.append(whole("all"))
            gone.append(whole("deleted"))
        return use(row, grams, every, gone)

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(run, schema)


def learn_weights(cells: pd.DataFrame, order: int, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Mixture weights per context bucket by expectation-maximisation on the held-out histogram.

    ``cells`` has the bucket, the grid value of every order's estimate from 0 up (null: no context), and ``n``."""
    weights = {}
    for bucket, part in cells.groupby("bucket"):
        values = part[[f"q{k}" for k in range(order + 1)]].to_numpy(np.float64)
        p = np.where(np.isnan(values) | (values <= NEVER), 0.0, np.exp2(values / GRID))
        usable = ~np.isnan(values)
        n = part["n"].to_numpy(np.float64)
        w = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(rounds):
            mix = w * usable
            mix /= mix.sum(axis=1, keepdims=True)
            share = mix * p
            total = share.sum(axis=1, keepdims=True)
            share = np.divide(share, total, out=np.zeros_like(share), where=total > 0)
            w = (share * n[:, None]).sum(axis=0)
            w = (w + 1e-3) / (w + 1e-3).sum()  # no weight falls to zero
        weights[int(bucket)] = w
    return weights


def score_texts(docs: DataFrame, training: Column, deleted: Column, key: str = "doc_id", text: str = "text",
                order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``training`` says which rows are learned from, ``deleted`` which of these the weights are learned on."""
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))  # blocks are large rows
    job = Job(spark, "lm-scoring")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), training.alias("train"),
                       (training & deleted).alias("deleted"))
    kind = rows.schema["key"].dataType.simpleString()
    made = _blocks(rows)
    made.write.option("compression", "zstd").option("maxRecordsPerFile", 8).parquet(f"{job.folder}/blocks")
    blocks = job.read("blocks", made)
    size = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"),
                         F.sum(F.size(F.filter(F.arrays_zip("train"), lambda z: z["train"]))).alias("texts"),
                         F.sum(F.when(F.col("kind") == 1, F.size("train"))).alias("gone")).first()
    buckets = max(1, -(-(size.tokens or 0) // BUCKET_KEYS))
    totals = job.keep(_totals(_asked(blocks, order, buckets)), "totals")
    sums = totals.where("n = 1").agg(F.sum("tokens").alias("tokens"), F.sum("deleted_tokens").alias("gone"),
                                     F.sum("distinct").alias("distinct")).first()
    tokens, gone, vocabulary = sums.tokens or 0, sums.gone or 0, sums.distinct or 0
    texts, texts_gone = size.texts or 0, size.gone or 0

    def histogram(row, grams, every, deleted_counts) -> pd.DataFrame:
        kept = [a - d for a, d in zip(every, deleted_counts)]
        estimates, context = _estimates(grams, kept, tokens - gone, texts - texts_gone, vocabulary)
        columns = {"bucket": context_bucket(context)}
        for k, p in enumerate(estimates):
            with np.errstate(divide="ignore"):
                columns[f"q{k}"] = np.where(p > 0, np.round(GRID * np.log2(np.where(p > 0, p, 1))), np.where(np.isnan(p), np.nan, NEVER))
        frame = pd.DataFrame(columns)
        return frame.groupby(list(columns), dropna=False).size().reset_index(name="n")

    names = "".join(f"q{k} double, " for k in range(order + 1))
    cells = _per_block(blocks.where("kind = 1"), totals.where("kind = 1"), order, histogram, f"bucket long, {names}n long")
    grid = cells.groupBy("bucket", *[f"q{k}" for k in range(order + 1)]).agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(grid, order)
    top = max(weights, default=0)
    table = np.full((top + 1, order + 1), 1.0 / (order + 1))
    for bucket in range(top + 1):  # a bucket that was never held out takes the weights of the next smaller one
        table[bucket] = weights.get(bucket, table[bucket - 1] if bucket else table[0])

    def scores(row, grams, every, _) -> pd.DataFrame:
        estimates, context = _estimates(grams, every, tokens, texts, vocabulary)
        own = every[0][grams.at[0]]
        mix = table[np.minimum(context_bucket(context), top)]
        usable = np.stack([~np.isnan(p) for p in estimates], axis=1)
        mix = mix * usable
        mix /= mix.sum(axis=1, keepdims=True)
        p = (mix * np.stack([np.nan_to_num(p) for p in estimates], axis=1)).sum(axis=1)
        base = np.log10((own + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        add = lambda values: np.add.reduceat(values, grams.starts)
        return pd.DataFrame({
            "key": pd.Series(list(row["keys"]), dtype=object), "held_out": list(row["held"]), "n_tokens": grams.lengths,
            "n_known": add((own > 0).astype(np.int64)), "train_tokens": tokens, "base_score": add(base), "score": add(np.log10(p))})

    result = _per_block(blocks, totals, order, scores, f"key {kind}, held_out boolean, n_tokens long, n_known long, "
                                                       "train_tokens long, base_score double, score double")
    return job.finish(result.withColumnRenamed("key", key))


def held_out(key: str = "doc_id") -> Column:
    """A fifth of the rows, never learned from."""
    return fold(key, 5) == 1


def deleted(key: str = "doc_id") -> Column:
    """About an eighth of the rows, by another hash: those of them that train are deleted to learn the weights."""
    return F.pmod(F.xxhash64(F.lit("deleted"), F.col(key)), F.lit(8)) == 0

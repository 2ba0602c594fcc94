import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from veritrail.llm import byte_bpe
from veritrail.llm.common import ARROW_BYTES, prepare

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = ["a", "Zé", " ", "  ", "\n", "\t ", "12", "!?", "'re", "'", "ll", "日本", "😀", " ", "_", "x" * 9]
    out = ["", None, " ", "a", "x" * 500, " " * 400, "<|endoftext|> a", "it's 'r e'll" * 30]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    return out + out[:20]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (50, 20), (32_768, 1024)])
def test_chunks_give_the_ids_of_the_whole_text(spark, encoder, chunk, overlap):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "other", i, "k", 1, 2) for i, t in rows],
                                 "doc_id long, text string, raw string, key int, _key string, piece int, no int")
    done = byte_bpe.decode(byte_bpe.encode(docs, chunk_chars=chunk, overlap_chars=overlap)).collect()
    assert len(done) == len(rows)
    by_id = dict(rows)
    for row in done:
        text = by_id[row.doc_id] or ""
        assert list(row.ids) == encoder.encode_ordinary(text), (row.doc_id, text)
        assert bytes(row.raw) == text.encode()
        assert row._key == "k" and (row.piece, row.no) == (1, 2)
        assert row.key == row.doc_id and row.text == by_id[row.doc_id]


def test_neighbours_are_cut_at_the_first_shared_boundary():
    assert byte_bpe.cut_places([[0], [10, 12, 15], [30, 33]], [[11, 12, 15], [31, 34], []]) == [12, None]
    assert byte_bpe.cut_places([[0], [10], [30]], [[11], [30], []]) == [None, None]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs)).count() == 0


def test_boundaries_by_range_and_ids_outside(spark):
    text = "it's a  long\n\n text, 12 x" * 20
    whole = byte_bpe.boundaries(text, True)
    assert byte_bpe.boundaries(text, True, 30, 400) == [p for p in whole if p <= 30 or p >= 400]
    bad = spark.createDataFrame([([1, 10_000_000],)], "ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(bad).collect()
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    assert [len(r.raw) for r in byte_bpe.decode(nulls).orderBy("doc_id").collect()][:2] == [0, 0]


def test_long_rows_are_taken_by_size(spark, monkeypatch):
    rows = pa.RecordBatch.from_arrays([pa.array(range(300))], names=["doc_id"])
    sizes = np.array([10] * 150 + [900, 5, 400, 400, 400] + [0] * 145)
    slices = list(byte_bpe.by_size(rows, sizes, 1_000))
    assert [i for _, part in slices for i in part.column(0).to_pylist()] == list(range(300))
    for start, part in slices:
        assert part.num_rows <= 128 and (part.num_rows == 1 or sizes[start:start + part.num_rows].sum() <= 1_000)
    assert list(byte_bpe.by_size(rows.slice(0, 0), sizes[:0], 1_000)) == []

    _, words = byte_bpe._vocabulary(PATH)
    ids = np.random.default_rng(1).integers(0, 40_000, 1_000)
    asked, plain = [], byte_bpe.places
    whole, counts = plain(words, ids)
    monkeypatch.setattr(byte_bpe, "places", lambda words, ids: (asked.append(len(ids)), plain(words, ids))[1])
    raw, size = byte_bpe.joined_bytes(words, ids, most=64)
    assert raw == whole.tobytes() and size.tolist() == counts.tolist() and max(asked) == 64
    assert byte_bpe.joined_bytes(words, ids[:0])[0] == b""


def test_arrow_batches_are_bounded_in_bytes(spark):
    prepare(spark)
    docs = spark.range(600).select(F.repeat(F.lit("abcd efgh"), 10_000).alias("text")).coalesce(1)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    seen = [r.bytes for r in docs.mapInArrow(run, "bytes long").collect()]
    assert sum(seen) > 50_000_000 and max(seen) < 2 * ARROW_BYTES

import base64
import os
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_minmax_dedup import plain_classes
from tests.llm.test_secret_grammar import plain_base

FOLDER = "/root/testdata/sf0.001"


def plain_mask(text):
    out, at = "", 0
    for start, _, end in plain_base(text):
        if end <= at:
            continue
        out += text[at:max(start, at)] + ("" if start < at else "<secret>")
        at = end
    return out + text[at:]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")
def test_pipeline_equals_the_plain_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sure = {i: r for i, r in docs.items() if re.search(r"[^\W\d_]", r.text)}  # every language is told at this scale
    firsts = {k for k, _, c in plain_classes([(i, r.text) for i, r in sure.items()]) if k == c}
    want = {i: plain_mask(sure[i].text) for i in firsts if not any(t in sure[i].text for t in items)}
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(done) == set(want)
    for i, text in want.items():
        r = done[i]
        assert (r.text, r.n_chars, r.lang, r.source) == (text, len(text), docs[i].lang, docs[i].source)
        assert list(r.ids) == encoder.encode_ordinary(text) and r.n_tokens == len(r.ids) and r.same_bytes


def test_stages_keep_columns_rows_and_clean_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, ids int, node string"
    rows = [(i, f"the house number {i} and the garden of {i * 7} with trees {i * 3} and a wall", "en", "s", 9, "x", 1, "y")
            for i in range(40)]
    rows += [(50, None, "en", None, None, None, None, None), (51, "", None, "s", 0, "x", 1, "y"), (None, "the wall of the garden is old and grey", "en", "s", 38, "x", 1, "y"),
             rows[3], (3, "the same id with another text about the garden wall", "en", "s", 1, "x", 1, "y")]
    docs = spark.createDataFrame(rows, schema)
    for (name, stage), left in zip(corpus_pipeline.STAGES, (43, 44, 45, 45, 45)):
        out = stage(spark, docs, FOLDER)
        if name != "tokens":
            assert out.columns == docs.columns and out.schema == docs.schema
        assert out.count() == left, name
        assert stage(spark, docs.where("false"), FOLDER).count() == 0


NAMES = ["own", "row", "stay", "empty", "copy", "raw", "spans", "base_spans", "lang_pred", "score", "key", "node", "bucket", "label",
         "_own", "_row", "_copy", "_empty", "_key", "piece", "no", "part", "kept", "sha", "item_id", "lines"]


def test_no_name_of_the_operators_meets_a_column(spark):
    rows = [(i, f"the house number {i} and the garden of {i * 7} with trees {i * 3} and a wall", "en", "s", 9) for i in range(12)]
    docs = spark.createDataFrame([r + tuple(f"{n} {r[0]}" for n in NAMES) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    done = docs.collect()
    assert len(done) == 12 and all(r[n] == f"{n} {r.doc_id}" for r in done for n in NAMES)

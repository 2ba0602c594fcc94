import os

import numpy as np
import public_tokenizers
import pytest

from veritrail.llm import language_id as li
from veritrail.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


def all_segmentations(word, probability):
    """The summed probability by listing every segmentation."""
    if not word:
        return 1.0
    return sum(probability(word[:n]) * all_segmentations(word[n:], probability)
               for n in range(1, len(word) + 1) if probability(word[:n]))


def test_forward_pass_sums_all_segmentations():
    pieces = li.piece_ids(PATH)
    number = {name: i for i, name in enumerate(pieces.names, 1)}
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces.names) + 1, 2)) / 100
    table[0] = 0
    words = ["the", "thandorin", "über", "日本", "ñ", "zzzzqqq"]
    logs = li.log_probabilities(words, pieces, table)
    for word, row in zip(words, logs):
        for language in range(2):
            def probability(piece):
                if piece in number:
                    return table[number[piece], language]
                return li.STRANGE if len(piece) == 1 else 0.0
            assert np.isclose(np.exp(row[language]), all_segmentations(li.START + word, probability), rtol=1e-9)


def test_pieces_are_found_by_hash():
    pieces = li.piece_ids(PATH)
    for i, name in list(enumerate(pieces.names, 1))[::97]:
        value = np.zeros(1, np.uint64)
        for c in name:
            value = li.Pieces.extend(value, np.array([ord(c)]))
        assert pieces.find(value)[0] == i


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, FOLDER).collect()
    assert len(rows) == len(truth)
    unseen = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in unseen) / len(unseen) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, tmp_path):
    rows = [(i, "the house and the garden " * 5, "en", 1) for i in range(0, 40)]
    rows += [(i, "das haus und der garten " * 5, "de", 1) for i in range(40, 80)]
    rows += [(90, None, "en", 1), (91, "", "de", 1), (92, "1234 !! ²", None, 1), (93, "das haus", None, 1),
             (94, "the garden " * 30_000, None, 1), (95, "x" * 200_000, None, 1), (None, "the house", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    done = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, str(tmp_path)).collect()}
    assert [done[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and done[92].score == 0
    assert (done[93].lang_pred, done[94].lang_pred, done[None].lang_pred) == ("de", "en", "en")
    assert done[95].lang_pred in ("de", "en") and done[None].held_out is False
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    assert {r.lang_pred for r in li.predict(docs, li.fit(docs.where("false"), li.held_out())).collect()} == {"und"}
    assert li.predict(docs.where("false"), li.fit(docs, ~li.held_out())).count() == 0


def plain_log_sum(word, number, column):
    """Forward pass in logs, one character after another."""
    logs = [0.0]
    for end in range(1, len(word) + 1):
        terms = []
        for size in range(1, min(40, end) + 1):  # no piece is that long
            piece = word[end - size:end]
            p = column[number[piece]] if piece in number else li.STRANGE if size == 1 else 0.0
            if p:
                terms.append(logs[end - size] + np.log(p))
        logs.append(np.logaddexp.reduce(terms))
    return logs[-1]


def long_words(pieces):
    """Runs of unknown letters, of letters that stand only in one language, and of usual ones."""
    unknown = next(c for c in map(chr, range(0xAC00, 0xD7A4)) if c not in set(pieces.names))
    return [unknown * 63, "日本" * 31 + "日", "thandorin" * 6, "a" * 16 + unknown * 40, "th" * 8, "x" * 17, unknown * 300]


def test_long_words_have_the_sums_of_a_pass_in_logs():
    pieces = li.piece_ids(PATH)
    number = {name: i for i, name in enumerate(pieces.names, 1)}
    rng = np.random.default_rng(1)
    table = rng.random((len(pieces.names) + 1, 2)) / 100
    table[[number["日"], number["本"]], 1] = 1e-12
    table[0] = 0
    words = long_words(pieces)
    logs = li.log_probabilities(words, pieces, table)
    assert np.isfinite(logs).all()
    for word, row in zip(words, logs):
        for i in range(2):
            want = plain_log_sum(li.START + word, number, table[:, i])
            assert np.isclose(row[i], want, rtol=1e-10)


def test_expected_counts_of_long_words():
    """Pieces' expected lengths add up to the letters that are pieces, for every language and word."""
    pieces = li.piece_ids(PATH)
    lengths = np.array([0] + [len(name) for name in pieces.names])
    rng = np.random.default_rng(2)
    table = rng.random((len(pieces.names) + 1, 3)) ** 8 / 100 + 1e-12
    table[0] = 0
    for word in long_words(pieces):
        marked = li.START + word
        found, shares = li.Lattice([marked], pieces).expected(table, np.array([[2.0, 1.0, 0.0]]))
        strange = sum(c not in pieces.names for c in marked)
        assert np.isfinite(shares).all()
        assert np.allclose((shares[found > 0] * lengths[found[found > 0], None]).sum(axis=0),
                           np.array([2.0, 1.0, 0.0]) * (len(marked) - strange), rtol=1e-9)


def test_every_piece_and_no_cut(monkeypatch):
    """The whole vocabulary takes part, and words of any length are summed as one, also over windows."""
    pieces = li.piece_ids(PATH)
    number = {name: i for i, name in enumerate(pieces.names, 1)}
    assert pieces.longest > 8 and max(map(len, pieces.names)) == pieces.longest < 40
    rng = np.random.default_rng(5)
    table = rng.random((len(pieces.names) + 1, 2)) / 1000
    table[0] = 0
    longest = [n.replace(li.START, "") for n in pieces.names if len(n) == pieces.longest][:3]
    words = [*longest, "internationalization", "thandorinhouse" * 6, "verwaltungsgericht" * 17, "x" * 300]
    for window in (4_096, 20, 50):
        monkeypatch.setattr(li, "WINDOW", window)
        for word, row in zip(words, li.log_probabilities(words, pieces, table)):
            for i in range(2):
                assert np.isclose(row[i], plain_log_sum(li.START + word, number, table[:, i]), rtol=1e-10)


def test_one_long_run_spoils_neither_fit_nor_prediction(spark):
    unknown = long_words(li.piece_ids(PATH))[0] + "각"
    han = "日本" * 32
    rows = [(i, "the house and the garden " * 5, "en") for i in range(20)]
    rows += [(i, "das haus und der garten " * 5, "de") for i in range(20, 40)]
    rows += [(40, f"the house {unknown} and", "en"), (41, f"{han} das haus", "de")]
    rows += [(50, f"the garden and the house {unknown}", None), (51, f"das haus und der garten {unknown}", None),
             (52, unknown, None), (53, han, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, table = li.fit(docs, li.F.col("doc_id") < 50)
    assert languages == ["de", "en"] and np.isfinite(table).all() and np.allclose(table.sum(axis=0), 1)
    done = {r.doc_id: r for r in li.predict(docs, (languages, table)).collect()}
    assert all(0 <= r.score <= 1 for r in done.values())
    assert [done[i].lang_pred for i in (0, 20, 50, 51, 53)] == ["en", "de", "en", "de", "de"]


def test_frequent_names_stay_remembered():
    """Rare names beyond the limit push out one another, not the frequent ones; every row is right all the same."""
    computed = []

    def compute(names):
        computed.extend(names)
        return np.array([[float(len(n)), float(hash(n) % 997)] for n in names]).reshape(len(names), 2)

    known = li.Remembered(40, 2)
    often = [f"often{'x' * i}" for i in range(8)]
    for turn in range(30):
        names = often * 3 + [f"rare{turn}-{i}" for i in range(9)] * 2
        assert np.array_equal(known.rows_of(names, compute), np.array([[len(n), hash(n) % 997] for n in names], float))
        assert len(known.place) <= 40
    assert len(computed) == len(often) + 30 * 9
    many = [f"many{i}" for i in range(300)]  # more than are ever remembered
    assert known.rows_of(many, compute)[:, 0].tolist() == [len(n) for n in many]
    assert known.rows_of([], compute).shape == (0, 2)


def test_words_of_tokens():
    for token, words in [("word", ["word"]), ("\"Word,\"", ["word"]), ("(a-B).", ["a", "b"]), ("...", []), ("x1y", ["x", "y"]),
                         ("ΑΣ.", ["ας"]), ("", []), ("“q”", ["q"])]:
        assert li.words_of(token) == words

import html
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.functions.numbers import exact_round, rating
from veritrail.functions.text import clean_text, fold, fold_literal, strip, unescape, word_count, words


def column(spark, values, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v"))).collect()]


MIXED = [
    "", " ", "a", " a  b ", "a\tb\n\nc", "a\xa0b", "a\x1cb\x1fc", " x　y z", "one two three",
    "a b  c", "ends ", "\nstarts", "é ç\x85ã",
]


def test_words_split_like_unicode_whitespace(spark):
    assert column(spark, MIXED, words) == [t.split() for t in MIXED]
    assert column(spark, MIXED, word_count) == [len(t.split()) for t in MIXED]
    assert column(spark, MIXED, strip) == [t.strip() for t in MIXED]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab .\t\n\x0b\x1d\x85\xa0 　", max_size=30), min_size=300, max_size=300))
def test_word_count_on_random_text(spark, texts):
    assert column(spark, texts, word_count) == [len(t.split()) for t in texts]


def test_clean_text(spark):
    dirty = " a  b \n\n\n\n c\t\td \n e \n\n\nf  "
    assert column(spark, [dirty], clean_text) == ["a b\n\nc d\ne\n\nf"]


def test_unescape_matches_the_standard(spark):
    texts = [
        "a &amp; b", "&lt;p&gt;", "&amp;lt;", "&copy;&nbsp;x", "&#233;&#x1F600;", "&nosuch; &", "&;", "AT&T", "x&eacute;y&ccedil;",
        "&NotEqualTilde;", "&quot;q&quot;&apos;", "&&amp;&", "plain",
    ]
    assert column(spark, texts, unescape) == [html.unescape(t) for t in texts]


def test_fold(spark):
    texts = ["AÇÃO", "Évolution naïve", "São às três", "ñandú", "é", "ＡＢ", "plain"]
    expected = [
        "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)) for t in texts
    ]
    assert column(spark, texts, fold) == expected
    assert [fold_literal(t) for t in texts] == expected


def test_round_looks_at_the_binary_value(spark):
    generator = random.Random(7)
    values = [2.675, 0.625, 1.005, 0.125, 7.915, 130.355, 257.155, 0.0, 10.0]
    values += [generator.randint(0, n) * 10.0 / n for n in range(1, 120) for _ in range(5)]
    values += [generator.randint(0, 10**6) / 1000 for _ in range(2000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[1] for r in frame.select("v", exact_round(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_rating_bands(spark):
    scores = [10.0, 8.0, 7.999, 6.0, 5.99, 4.0, 3.9, 2.0, 1.99, 0.0]
    frame = spark.createDataFrame([(s,) for s in scores], "s double").select("s", rating(F.col("s")))
    assert [r[1] for r in frame.collect()] == list("AABBCCDDEE")

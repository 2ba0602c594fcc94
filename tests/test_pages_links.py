from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from veritrail.functions.html import page_text, table_text
from veritrail.functions.urls import content_type, url_filename, url_join
from veritrail.operators import links as K
from veritrail.operators import pages as P


def texts(spark, pages, build=page_text):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").orderBy("i")
    return [r[0] for r in frame.select(build(F.col("html"))).collect()]


def test_content_area_order(spark):
    main = "<body><article>art</article><main>the <b>main</b></main></body>"
    article = "<body>x<article>a<article>inner</article>b</article><article>second</article></body>"
    role = "<body>x<section role='main'>r<section>in</section>s</section>t</body>"
    div = '<body>x<div class="side">n</div><div id="a" class="big content-box">c<div>d</div>e</div>f</body>'
    body = "<html><head><title>t</title></head><body>only <i>body</i></body></html>"
    assert texts(spark, [main, article, role, div, body, "no tags"]) == [
        "the\n\nmain", "a\n\ninner\n\nb", "r\n\nin\n\ns", "c\n\nd\n\ne", "only\n\nbody", "no tags",
    ]


def test_dropped_elements(spark):
    nested = "<body>a<nav>b<nav>c</nav>d</nav>e<header>f</header><svg/>g<form>h</form><aside>i</aside><footer>j</footer>k</body>"
    script = "<body>a<script>if (x < y) { '</p><nav>' }</script>b<style>p{}</style>c<!-- <main>no</main> -->d<iframe src=x>e</iframe>f</body>"
    unclosed = "<body>a<form>b"
    assert texts(spark, [nested, script, unclosed]) == ["a\n\ne\n\ng\n\nk", "a\n\nb\n\nc\n\nd\n\nf", "a"]


def test_each_text_once_and_decoded(spark):
    assert texts(spark, ["<p>Ol&aacute; <b>mundo</b> &lt;p&gt;</p><p>&nbsp;</p>"]) == ["Olá\n\nmundo\n\n<p>"]


def test_tables(spark):
    table = "<table><thead><tr><th>Ano</th><th>t | CO2</th></tr></thead><tr><td>2024<td><b>1</b> 2</tr><tr></tr></table>"
    assert texts(spark, [table, "<table></table>"], table_text) == ["Ano | t | CO2\n--- | --- | ---\n2024 | 12", ""]
    assert texts(spark, [f"<body>before{table}after</body>"]) == [
        "before\n\nAno | t | CO2\n--- | --- | ---\n2024 | 12\n\nafter"
    ]


def test_deeply_nested_page_is_handled(spark):
    deep = "<body>" + "<div class='content'>x" * 3000 + "</div>" * 3000 + "</body>"
    assert texts(spark, [deep])[0].count("x") == 3000


def test_unusable_reasons(spark):
    long = "palavra " * 200
    rows = [
        ("curto", "<p>"), (long + '"exception" : 1', "<p>"), ("a " * 300, "<script>" * 6),
        (long, "<script>" * 4 + "react <table>"), (long + "1.000 2.000 3.000 4.000", "<script>" * 4 + "react <table>"), (long, "<p>"),
        (long + "<noscript>please\nENABLE javascript", "<p>"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, html string").orderBy("i")
    got = [r[0] for r in frame.select(P.unusable_reason(F.col("text"), F.col("html"))).collect()]
    assert got == ["short", "garbage", "scripts", "unrendered table", None, None, "garbage"]


BASES = ["http://a.com/b/c/d?x=1#f", "https://a.com", "https://a.com/", "http://a.com/b/c/", "/x/y/z"]
LINKS = [
    "g", "./g", "../g", "../../g", "../../../g", "/g", "/a/../g", "//h.com/z", "?q=1", "#s", "", "http://z.com/a/../b",
    "g/./h", "g/../h", "..", ".", "g?x=/../y", "a//b", "../a//b/c", "/a//b", "g;p=1",
]


def test_url_join_matches_the_standard(spark):
    pairs = [(b, link) for b in BASES for link in LINKS]
    rows = spark.createDataFrame(pairs, "b string, l string").select("b", "l", url_join(F.col("b"), F.col("l")).alias("u"))
    assert [(r.b, r.l, r.u) for r in rows.collect() if r.u != urljoin(r.b, r.l)] == []


@pytest.mark.parametrize("url, name", [
    ("https://www.x.com/docs/rel.pdf?v=1", "rel.pdf"), ("https://x.com/docs/politica/", "politica.html"),
    ("https://www.x.com", "x.com.html"), ("https://x.com/" + "a" * 90, "a" * 80 + ".html"), ("https://x.com/a.b;p=1", "a.b"),
])
def test_url_filename(spark, url, name):
    assert spark.range(1).select(url_filename(F.lit(url))).first()[0] == name


def test_content_type(spark):
    rows = [("http://x/a.PDF?x=1", None), ("http://x/a", "Application/PDF"), ("http://x/a", "text/html"), ("http://x/a", None)]
    frame = spark.createDataFrame(rows, "u string, h string").select(content_type(F.col("u"), F.col("h")))
    assert [r[0] for r in frame.collect()] == ["pdf", "pdf", "html", "html"]


PAGE = """<html><head><base href="https://b.org/ir/"></head><body>
<a href="rel.pdf">Relat&oacute;rio anual (3 MB)</a> <a href='#x'>skip</a> <a href="mailto:a@b">m</a> <a HREF=contato>Fale</a>
<a href="rel.pdf/">de novo</a><a href="noticia#1">Not&iacute;cia</a><a href="noticia#2">energia limpa</a>
<div onclick="open('https://c.org/codigo.pdf','x')">C&oacute;digo <div>de</div> conduta</div>
<span data-file="https://c.org/a.pdf" data-url="https://c.org/b.pdf">par</span>
<iframe src="/doc/document?id=1"></iframe><iframe src="/video"></iframe>
<script>var u = "https:\\/\\/d.org"; var v = "https://d.org/raw.pdf?k=1";</script></body></html>"""


def found(spark):
    page = spark.createDataFrame([("https://x.org/p", PAGE)], "url string, html string")
    return K.find_links(page)


def test_links_in_generator_order(spark):
    rows = K.unfold(found(spark), []).collect()
    assert [(r.generator, r.url, r.text) for r in rows] == [
        (1, "https://b.org/ir/rel.pdf", "Relatório anual (3 MB)"), (1, "https://b.org/ir/contato", "Fale"),
        (1, "https://b.org/ir/rel.pdf/", "de novo"), (1, "https://b.org/ir/noticia#1", "Notícia"),
        (1, "https://b.org/ir/noticia#2", "energia limpa"),
        (2, "https://c.org/codigo.pdf", "Códigodeconduta"), (2, "https://c.org/b.pdf", "par"), (2, "https://c.org/a.pdf", "par"),
        (3, "https://b.org/doc/document?id=1", "Embedded Document"),
        (4, "https://c.org/codigo.pdf", ""), (4, "https://c.org/a.pdf", ""), (4, "https://c.org/b.pdf", ""),
        (4, "https://d.org/raw.pdf?k=1", ""),
    ]


def test_rejected_links_still_claim_their_address(spark):
    rows = K.candidates(K.rank_links(K.dedup_links(found(spark))), []).collect()
    urls = [r.url for r in rows]
    assert "https://b.org/ir/noticia#2" not in urls  # its first form was not on the subject
    assert len(urls) == len(set(urls)) == 5  # the frame has no keyword and no document ending
    assert [r.relevance_score for r in rows] == sorted((r.relevance_score for r in rows), reverse=True)
    report = next(r for r in rows if r.url.endswith("rel.pdf"))
    assert (report.name, report.file_type, report.relevance_score) == ("Relatório anual", "pdf", 5)


def test_short_pages_have_no_links(spark):
    page = spark.createDataFrame([("u", '<a href="x.pdf">x</a>')], "url string, html string")
    assert K.unfold(K.find_links(page), []).count() == 0


@pytest.mark.parametrize("url, text, name", [
    ("http://x/a", "Política - Download", "Política"), ("http://x/a", "Relatório 12MB", "Relatório"),
    ("http://x/rel_anual-2024.PDF", "pdf", "rel anual 2024"), ("http://x/", "", "Documento"), ("http://x/c%C3%B3digo.docx", "", "código"),
    ("http://x/100%25+a.pdf", "", "100%+a"), ("http://x/bad%zz.pdf", "", "bad%zz"),
])
def test_link_name(spark, url, text, name):
    assert spark.range(1).select(K.link_name(F.lit(url), F.lit(text))).first()[0] == name


def test_document_names(spark):
    rows = [("http://x/a.pdf", "Relatório", "pdf"), ("http://x/a.pdf", "R.PDF", "pdf"), ("http://x/dir/b", "", "html"), ("http://x/c", "", "pdf")]
    frame = spark.createDataFrame(rows, "url string, name string, file_type string")
    assert [r.filename for r in K.document_names(frame).collect()] == ["Relatório.pdf", "R.PDF", "b.html", "c.html.pdf"]

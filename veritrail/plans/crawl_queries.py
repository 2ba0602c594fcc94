"""Page text, unusable pages, file names and document links."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import html as H
from veritrail.functions import urls as U
from veritrail.functions.text import clean_text
from veritrail.operators import links as K
from veritrail.operators import pages as P
from veritrail.plans import flows
from veritrail.plans.checks import SENTENCES, sql_blocks, sql_clean, sql_nodes, sql_packing
from veritrail.plans.fixtures import VIEWS
from veritrail.plans.registry import query

VIEWS["o_markup"] = r"""
SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '<!>', 'g'),
       '(?is)<style.*?</style>', '<!>', 'g'), '(?s)<!--.*?-->', '<!>', 'g') AS markup FROM {d_pages}"""

# The article of a page without menus; its table, if any, as one text.
VIEWS["o_articles"] = r"""
SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         replace(regexp_extract(markup, '(?is)<article[^>]*>(.*)</article>', 1), '<nav>menu<nav>sub</nav>fim</nav>', '<!>'),
         '(?is)<iframe.*?</iframe>', '<!>', 'g'), '(?is)<header.*?</header>', '<!>', 'g'), '<svg/>', '<!>', 'g'),
         '(?is)<table.*?</table>', '<!>Ano | Emiss&otilde;es' || chr(10) || '--- | ---' || chr(10) ||
         CAST(2000 + page_id % 25 AS VARCHAR) || ' | 1.234.567,8 t' || chr(10) || 'Meta | <!>', 'g') AS article FROM {o_markup}"""

VIEWS["o_page_text"] = f"""
SELECT page_id, html, {sql_clean(f"array_to_string({sql_nodes('article')}, chr(10) || chr(10))")} AS text FROM {{o_articles}}"""


def page_texts(fx):
    return P.extract_pages(fx["d_pages"])


@query("page_text", """
SELECT page_id, text, CAST(greatest(1, length(text) // 3000) AS INT) AS page_count FROM {o_page_text}""")
def _(fx):
    return page_texts(fx).select("page_id", "text", "page_count")


@query("table_text", """
SELECT page_id, 0 AS position, 'Ano | Emissões' || chr(10) || '--- | ---' || chr(10) || CAST(2000 + page_id % 25 AS VARCHAR)
       || ' | 1.234.567,8 t' || chr(10) || 'Meta | ' AS text FROM {pages} WHERE page_id % 6 = 0""")
def _(fx):
    tables = F.regexp_extract_all("html", F.lit(r"(?is)(<table\b.*?</table>)"), 1)
    rows = fx["d_pages"].select("page_id", F.posexplode(tables).alias("position", "table"))
    return rows.select("page_id", "position", H.table_text(F.col("table")).alias("text"))


# Document texts with the line breaks and blanks a crawl leaves.
_RAGGED = "replace(replace(text, '. ', '.  ' || chr(9)), chr(10), ' ' || chr(10) || chr(10) || chr(10) || chr(10) || '  ')"


@query("clean_text", f"SELECT doc_id, {sql_clean(_RAGGED)} AS text FROM {{documents}}")
def _(fx):
    ragged = F.replace(F.replace("text", F.lit(". "), F.lit(".  \t")), F.lit("\n"), F.lit(" \n\n\n\n  "))
    return fx["documents"].select("doc_id", clean_text(ragged).alias("text"))


_REASON = r"""
SELECT page_id, CASE WHEN length(text) < 500 THEN 'short'
  WHEN regexp_matches(text, '(?is)"exception"\s*:|"trace"\s*:|"stacktrace"\s*:|Symfony\\|Laravel\\|500 Internal Server Error|"message"\s*:\s*"No query results|<noscript>.*enable javascript|__NEXT_DATA__') THEN 'garbage'
  WHEN scripts > 5 AND length(text) < 1000 THEN 'scripts'
  WHEN regexp_matches(lower(html), 'react|vue|angular|nuxt|next|data-v-|ng-app') AND scripts > 3
       AND regexp_matches(lower(html), '<table|data-table')
       AND len(regexp_extract_all(text, '\d{1,3}(?:\.\d{3})+(?:,\d+)?')) <= 3 THEN 'unrendered table' END AS reason
FROM (SELECT *, len(regexp_extract_all(lower(html), '<script')) AS scripts FROM {o_page_text})"""


VIEWS["o_web_chunks"] = sql_packing(f"""
SELECT page_id AS doc_id, CASE WHEN len(b) <= 1 AND length(text) > 2000 THEN {SENTENCES} ELSE b END AS parts,
       list_transform(CASE WHEN len(b) <= 1 AND length(text) > 2000 THEN {SENTENCES} ELSE b END, lambda s: 0) AS pages
FROM (SELECT page_id, text, {sql_blocks('text')} AS b FROM {{o_page_text}}
      WHERE page_id NOT IN (SELECT page_id FROM ({_REASON}) WHERE reason IS NOT NULL))""")


@query("web_chunks", "SELECT doc_id AS page_id, chunk_index, content, token_count FROM {o_web_chunks}")
def _(fx):
    chunks = flows.chunk_web_pages(fx["d_pages"], ["page_id"])
    return chunks.select("page_id", "chunk_index", "content", "token_count")


@query("unusable_pages", f"SELECT * FROM ({_REASON}) WHERE reason IS NOT NULL")
def _(fx):
    return page_texts(fx).where(F.col("unusable").isNotNull()).select("page_id", F.col("unusable").alias("reason"))


_HEADER = """CASE page_id % 4 WHEN 0 THEN 'Application/PDF; qs=1' WHEN 1 THEN 'text/html; charset=utf-8'
  WHEN 2 THEN 'application/xhtml+xml' END"""
_ASKED = "CASE WHEN page_id % 3 = 0 THEN concat(url, '/Anexo.PDF?download=1') ELSE url END"


@query("content_type", f"""
SELECT page_id, CASE WHEN ends_with(string_split(lower({_ASKED}), '?')[1], '.pdf') THEN 'pdf'
  WHEN contains(lower({_HEADER}), 'application/pdf') THEN 'pdf' ELSE 'html' END AS content_type FROM {{pages}}""")
def _(fx):
    return fx["pages"].select("page_id", U.content_type(F.expr(_ASKED), F.expr(_HEADER)).alias("content_type"))


@query("url_filename", r"""
WITH parts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM
  (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) ELSE url END AS url FROM {pages})),
named AS (SELECT *, string_split(path, '/')[-1] AS segment FROM parts)
SELECT page_id, CASE WHEN contains(segment, '.') THEN left(segment, 120) WHEN segment <> '' THEN left(segment, 80) || '.html'
  ELSE left(replace(host, 'www.', ''), 60) || '.html' END AS filename FROM named""")
def _(fx):
    url = F.when(F.col("page_id") % 5 == 0, F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0)).otherwise(F.col("url"))
    return fx["pages"].select("page_id", U.url_filename(url).alias("filename"))


VIEWS["o_links"] = rf"""
WITH based AS (SELECT page_id, html, markup, CASE WHEN page_id % 9 = 0 THEN 'https://base.example.org/raiz/ir/' ELSE url END AS base FROM {{o_markup}}),
places AS (SELECT *, regexp_extract(base, '^[a-z]+://[^/?#]*', 0) AS origin,
  regexp_replace(regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM based),
anchors AS (SELECT page_id, generate_subscripts(found, 1) - 1 AS position, unnest(found) AS a, base, origin, folder FROM (
  SELECT *, list_filter(regexp_extract_all(markup, '(?is)<a [^>]*>.*?</a>'), lambda x:
    NOT regexp_matches(regexp_extract(x, 'href="([^"]*)"', 1), '^(#|mailto:|javascript:|$)')) AS found FROM places)),
resolved AS (SELECT page_id, position, regexp_extract(a, 'href="([^"]*)"', 1) AS href, array_to_string({sql_nodes('a')}, '') AS text, base, origin, folder FROM anchors)
SELECT page_id, 1 AS generator, CAST(position AS INT) AS position, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN origin || href
    WHEN href LIKE '?%' THEN regexp_extract(base, '^[^?#]*', 0) || href
    ELSE origin || coalesce(nullif(regexp_replace(rtrim(folder, '/'), '[^/]*$', ''), ''), '/') || replace(href, '../', '') END AS url, text FROM resolved
UNION ALL SELECT page_id, 2, 0, 'https://files.example.org/codigo-conduta-' || CAST(page_id % 8 AS VARCHAR) || '.pdf', 'Código deconduta- Download'
  FROM places WHERE page_id % 4 = 0
UNION ALL SELECT page_id, 3, 0, origin || '/viewer/document/' || CAST(page_id AS VARCHAR), 'Embedded Document' FROM places WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 4, CAST(generate_subscripts(raw, 1) - 1 AS INT), unnest(raw), '' FROM (
  SELECT page_id, regexp_extract_all(html, '(?i)https?://[^\s''"<>\\]+\.pdf(?:\?[^\s''"<>\\]*)?') AS raw FROM places)"""


def found_links(fx):
    return K.find_links(fx["d_pages"])


def ranked_links(fx):
    return K.rank_links(K.dedup_links(found_links(fx)))


@query("page_links", "SELECT * FROM {o_links}")
def _(fx):
    return K.unfold(found_links(fx), ["page_id"]).drop("rank")


VIEWS["o_distinct_links"] = """
SELECT * FROM {o_links} QUALIFY row_number() OVER (PARTITION BY page_id, rtrim(string_split(url, '#')[1], '/')
                                                   ORDER BY generator, position) = 1"""


@query("dedup_links", "SELECT * FROM {o_distinct_links}")
def _(fx):
    return K.unfold(K.dedup_links(found_links(fx)), ["page_id"]).drop("rank")


VIEWS["o_ranked_links"] = """
WITH scored AS (SELECT *, len(list_filter(['sustentabilidade', 'sustainability', 'esg', 'relatorio', 'relatório', 'politica', 'política',
    'policy', 'codigo', 'código', 'code', 'governanca', 'governança', 'governance', 'estatuto', 'bylaws', 'conselho', 'board',
    'diretoria', 'etica', 'ética', 'ethics', 'conduta', 'conduct', 'compliance', 'integridade', 'integrity', 'anticorrup',
    'diversidade', 'diversity', 'direitos humanos', 'human rights', 'saude', 'saúde', 'seguranca', 'segurança', 'safety',
    'fornecedor', 'supplier', 'cadeia', 'ambiental', 'environmental', 'clima', 'climate', 'emiss', 'residuo', 'resíduo',
    'waste', 'hidric', 'hídric', 'water', 'energia', 'energy', 'biodiversidade', 'fre', 'formulario', 'formulário', 'anual',
    'annual', 'integrado', 'integrated', 'indicador', 'cvm', 'inventario', 'inventário', 'ghg', 'gee'],
    lambda k: contains(lower(text || ' ' || url_decode(url)), k))) AS hits, string_split(lower(url), '?')[1] AS bare
  FROM {o_distinct_links}),
kept AS (SELECT *, hits + CASE WHEN ends_with(bare, '.pdf') THEN 3 ELSE 0 END AS score FROM scored
  WHERE hits > 0 OR regexp_matches(bare, '\\.(pdf|xlsx|xls|docx)$'))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, generator, position) AS INT) AS rank, url, text,
       CAST(score AS INT) AS relevance_score, CASE WHEN ends_with(bare, '.pdf') THEN 'pdf'
         WHEN regexp_matches(bare, '\\.xlsx?$') THEN 'excel' WHEN ends_with(bare, '.docx') THEN 'word' ELSE 'html' END AS file_type,
       CASE WHEN length(trim(text)) > 5 AND length(trim(text)) < 200
         THEN trim(regexp_replace(regexp_replace(trim(text), '(?i)\\s*\\(?\\d+\\s*(kb|mb|gb)\\)?$', ''), '(?i)\\s*-\\s*download$', ''))
         ELSE coalesce(nullif(trim(translate(regexp_replace(url_decode(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[-1]),
              '(?i)\\.(pdf|xlsx|docx)$', ''), '-_', '  ')), ''), 'Documento') END AS name
FROM kept"""


@query("rank_links", """
SELECT page_id, rank, url, file_type, relevance_score, left(text, 200) AS link_text FROM {o_ranked_links}""")
def _(fx):
    return K.candidates(ranked_links(fx), ["page_id"]).drop("name")


@query("link_name", "SELECT page_id, rank, name FROM {o_ranked_links}")
def _(fx):
    return K.candidates(ranked_links(fx), ["page_id"]).select("page_id", "rank", "name")


@query("selected_links", """
SELECT page_id, url, name, relevance_score FROM {o_ranked_links} WHERE file_type = 'pdf' AND relevance_score >= 2""")
def _(fx):
    chosen = K.selected(K.candidates(ranked_links(fx), ["page_id"]))
    return chosen.select("page_id", "url", "name", "relevance_score")


@query("batch_names", """
SELECT page_id, rank, CASE WHEN file_type = 'pdf' AND NOT ends_with(lower(name), '.pdf') THEN name || '.pdf' ELSE name END AS filename
FROM {o_ranked_links}""")
def _(fx):
    return K.document_names(K.candidates(ranked_links(fx), ["page_id"])).select("page_id", "rank", "filename")

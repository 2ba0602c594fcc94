"""Domain tables derived from the driver's test tables.

Each view is one SQL text that Spark and DuckDB both accept, so a query and its check
start from the same rows. ``{name}`` refers to another view or to a test table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.session import ship_package, written

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["d_companies"] = """
SELECT s_suppkey AS company_id, s_name AS name,
       concat('TCK', CAST(s_suppkey % 7 AS STRING), CAST(s_nationkey AS STRING)) AS ticker,
       CASE s_nationkey % 5 WHEN 0 THEN 'Energia' WHEN 1 THEN 'bancos' WHEN 2 THEN 'Varejo Online'
            WHEN 3 THEN 'Saneamento' ELSE 'Outro' END AS sector
FROM {supplier}"""

VIEWS["d_themes"] = """
SELECT n_nationkey AS theme_id, n_name AS name, n_nationkey AS display_order, n_nationkey + 1 AS theme_number,
       CASE WHEN n_regionkey <= 1 THEN 'environmental' WHEN n_regionkey <= 3 THEN 'social'
            ELSE 'governance' END AS dimension
FROM {nation}"""

VIEWS["d_questions"] = """
SELECT p_partkey AS question_pk, CAST(p_partkey % 25 AS INT) AS theme_id, p_partkey AS display_order,
       concat(CAST(p_partkey % 25 + 1 AS STRING), '.',
              CAST(CAST(floor(p_partkey / 25) AS BIGINT) % 9 + 1 AS STRING), '.',
              CAST(CAST(floor(p_partkey / 225) AS BIGINT) + 1 AS STRING)) AS question_id,
       p_name AS question_text, CASE WHEN p_size % 5 = 0 THEN 'Não' ELSE 'Sim' END AS expected_answer
FROM {part}"""

# Longer question wordings, some of them led by the question's own id.
VIEWS["d_question_texts"] = """
SELECT q.question_pk, q.theme_id, q.display_order, q.question_id,
       CASE p.p_size % 8
            WHEN 0 THEN concat(q.question_id, '. A empresa POSSUI ', p.p_name, '?')
            WHEN 1 THEN concat(q.question_id, ' Qual a Evolução de ', p.p_name, ' nos ÚLTIMOS 3 ANOS?')
            WHEN 2 THEN concat('Há política ou compromisso público sobre ', p.p_name, ' e ', lower(p.p_type), '?')
            WHEN 3 THEN concat('Os fornecedores de ', p.p_name, ' seguem critérios definidos por norma interna, com ',
                               'revisão anual, publicação dos resultados e consulta às partes interessadas no processo?')
            WHEN 4 THEN concat(q.question_id, '..  São auditadas as informações de ', p.p_name, '?')
            WHEN 5 THEN concat('Avaliação de riscos: ', p.p_name)
            WHEN 6 THEN p.p_name
            ELSE concat('Indicadores de ', p.p_name, ' por marca ', p.p_brand, ' estão disponíveis') END AS question_text
FROM {d_questions} q JOIN {part} p ON p.p_partkey = q.question_pk"""

VIEWS["d_materiality"] = """
SELECT DISTINCT c.sector, t.theme_id, ((t.theme_id * 7 + length(c.sector)) % 4) * 0.5E0 AS weight
FROM {d_companies} c JOIN {d_themes} t ON t.theme_id % 5 = c.company_id % 5
WHERE (t.theme_id + length(c.sector)) % 6 <> 0"""

VIEWS["d_answers_raw"] = """
SELECT l_suppkey * 10000 + year(l_shipdate) AS analysis_id, l_suppkey AS company_id,
       CAST(year(l_shipdate) AS INT) AS report_year,
       l_partkey AS question_pk, l_shipdate AS created_at, l_discount * 15 - 0.2E0 AS confidence_score,
       CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'sim' ELSE 'Sim' END
            WHEN l_returnflag = 'A' THEN CASE l_linenumber % 3 WHEN 0 THEN 'Nao' WHEN 1 THEN 'não' ELSE 'Não' END
            ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'talvez' ELSE 'N/A' END END AS answer,
       l_orderkey, l_linenumber, l_quantity, l_extendedprice
FROM {lineitem}"""

# The text columns of an answer, with blanks, generic sources and over-long values among them.
VIEWS["d_answer_details"] = """
SELECT r.*,
       CASE WHEN r.l_linenumber % 4 = 0 THEN NULL
            ELSE concat('"', repeat(concat('Trecho ', CAST(r.l_orderkey AS STRING), ' '), CAST(r.l_quantity AS INT) * 2), '"')
            END AS justification,
       CASE r.l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Documentos Analisados'
            WHEN 3 THEN concat('Relatorio ', CAST(r.report_year AS STRING), '.pdf, p.', CAST(r.l_orderkey % 90 + 1 AS STRING))
            WHEN 4 THEN ' n/a ' WHEN 5 THEN repeat('Politica.pdf; ', CAST(r.l_quantity AS INT))
            ELSE concat('Formulario ', CAST(r.l_orderkey % 13 AS STRING), '.pdf') END AS source_reference,
       CASE WHEN r.l_linenumber % 3 = 0 THEN '' WHEN r.l_linenumber % 3 = 1 THEN NULL
            ELSE repeat('melhorar ', CAST(r.l_quantity AS INT)) END AS improvement_points
FROM {d_answers_raw} r"""

VIEWS["d_documents"] = """
SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS company_id,
       concat('report_', CAST(doc_id % 140 AS STRING), '.pdf') AS filename,
       CAST(2020 + doc_id % 5 AS INT) AS report_year,
       CASE WHEN doc_id % 3 = 0 THEN 'url' ELSE 'pdf' END AS source_type,
       CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 19 = 0 THEN 'processing' ELSE 'ready' END AS status,
       greatest(1, CAST(floor(n_chars / 3000) AS BIGINT)) AS page_count, text
FROM {documents}"""

VIEWS["d_reference"] = """
SELECT question_pk, question_id, theme_id,
       CASE WHEN question_pk % 7 = 0 THEN 'N/A' WHEN question_pk % 7 <= 2 THEN 'Não' ELSE 'Sim' END AS answer
FROM {d_questions}"""

# What an analyst's workbook gives: sheet, id, answer and source per row, with rows to be refused.
VIEWS["d_workbook_answers"] = """
SELECT CASE WHEN r.question_pk % 31 = 0 THEN 'Materialidade' WHEN r.question_pk % 37 = 0 THEN 'Folha solta'
            ELSE t.name END AS sheet,
       CASE WHEN r.question_pk % 23 = 0 THEN NULL WHEN r.question_pk % 29 = 0 THEN '4.2'
            WHEN r.question_pk % 41 = 0 THEN '0.7' WHEN r.question_pk % 43 = 0 THEN concat(r.question_id, '.99')
            ELSE r.question_id END AS question_id,
       CASE WHEN r.question_pk % 19 = 0 THEN NULL WHEN r.question_pk % 13 = 0 THEN 'Parcial'
            WHEN r.question_pk % 11 = 0 THEN concat(' ', r.answer, ' ') ELSE r.answer END AS answer,
       concat('Analista p.', CAST(r.question_pk % 50 AS STRING)) AS source, r.question_pk AS row_number
FROM {d_reference} r JOIN {d_themes} t ON t.theme_id = r.theme_id"""

# A questionnaire workbook as cells: the id sits in B, C, D or A; some rows are headers or blanks.
VIEWS["d_cell_rows"] = """
SELECT p_partkey AS row_number,
       CASE WHEN p_partkey % 29 = 0 THEN 'Capa' WHEN p_partkey % 31 = 0 THEN 'Notas' ELSE n.n_name END AS sheet,
       CASE WHEN p_size % 6 = 3 THEN concat('  ', q.question_id) WHEN p_size % 6 = 5 THEN 'Tema' END AS a,
       CASE p_size % 6 WHEN 0 THEN concat(q.question_id, ' ', p_name, ' de ', p_type) WHEN 1 THEN q.question_id
            WHEN 4 THEN concat(q.question_id, '.') WHEN 5 THEN p_type END AS b,
       CASE p_size % 6 WHEN 1 THEN concat('Texto longo sobre ', p_name) WHEN 2 THEN concat(q.question_id, '.4 ')
            WHEN 3 THEN p_name WHEN 5 THEN concat('Pergunta sem id: ', p_name) END AS c,
       CASE p_size % 6 WHEN 3 THEN repeat(concat(p_name, ' ; '), p_size * 2) WHEN 2 THEN concat('Sobre ', p_type, ' e ', p_name)
            END AS d,
       CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Sim ' WHEN 2 THEN 'Não' WHEN 3 THEN 'N/A' ELSE '' END AS e,
       CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN repeat(concat('Evidência ', p_brand, ' '), p_size * 3) END AS f,
       CASE WHEN p_size % 3 = 0 THEN concat('Fonte ', p_brand) END AS l
FROM {part} JOIN {d_questions} q ON q.question_pk = p_partkey JOIN {nation} n ON n.n_nationkey = p_partkey % 25"""

VIEWS["d_cells"] = " UNION ALL ".join(
    f"SELECT sheet, row_number, '{c.upper()}' AS col, {c} AS value, TRUE AS is_text FROM {{d_cell_rows}} WHERE {c} IS NOT NULL"
    for c in "abcdefl"
)

# The pages with what they lack: pdf links, download attributes, frames, tables, a base tag, scripts.
VIEWS["d_pages"] = """
SELECT page_id, url,
       replace(replace(html, '</article>', concat(
           CASE WHEN page_id % 3 = 0 THEN concat('<a class="x" href="/docs/relatorio_anual-', CAST(page_id AS STRING),
                '.pdf?v=2#p">Relat&oacute;rio <b>Anual</b> ', CAST(page_id AS STRING), ' (2 MB)</a><a href="mailto:x@y.z">m</a>',
                '<a href="../politica%20etica.pdf">Baixar</a><a href="/docs/relatorio_anual-', CAST(page_id AS STRING),
                '.pdf?v=2">Outra vez</a>') ELSE '' END,
           CASE WHEN page_id % 4 = 0 THEN concat('<button data-url="https://files.example.org/codigo-conduta-',
                CAST(page_id % 8 AS STRING), '.pdf">C&oacute;digo de <i>conduta</i> - Download</button>') ELSE '' END,
           CASE WHEN page_id % 5 = 0 THEN concat('<iframe src="/viewer/document/', CAST(page_id AS STRING), '"></iframe>',
                '<a href="https://www.example.org/planilha.XLSX">dados</a><a href="#topo">topo</a><a href="?aba=esg">Aba ESG</a>')
                ELSE '' END,
           CASE WHEN page_id % 6 = 0 THEN concat('<table class="t"><tr><th>Ano</th><th>Emiss&otilde;es</th></tr><tr><td>',
                CAST(2000 + page_id % 25 AS STRING), '</td><td><b>1.234.567</b>,8 t</td></tr><tr></tr><tr><td>Meta</td><td></td></tr></table>')
                ELSE '' END,
           CASE WHEN page_id % 7 = 0 THEN concat('<nav>menu<nav>sub</nav>fim</nav><header>cabe&ccedil;alho</header><svg/>',
                '<script src="react.js"></script><script>var u="https://cdn.example.net/ghg-', CAST(page_id AS STRING),
                '.pdf?x=1";</script><script>1</script><script>2</script><script>3</script>') ELSE '' END,
           '</article>')),
         '<head>', CASE WHEN page_id % 9 = 0 THEN '<head><base href="https://base.example.org/raiz/ir/">' ELSE '<head>' END) AS html
FROM {pages}"""

# One analysis per company and year with stored status and timestamps.
VIEWS["d_analyses"] = """
SELECT analysis_id, company_id, report_year,
       CASE analysis_id % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'error' ELSE 'completed' END AS status,
       min(created_at) AS started_at, max(created_at) AS completed_at, max(created_at) AS created_at
FROM {d_answers_raw} GROUP BY analysis_id, company_id, report_year"""

# The questions each analysis was asked, and the ones that came back with a usable answer.
VIEWS["d_asked"] = """
SELECT DISTINCT analysis_id, company_id, report_year, question_pk FROM {d_answers_raw}"""

VIEWS["d_progress"] = """
SELECT user_id AS analysis_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'heartbeat' ELSE 'answer' END AS kind
FROM {events}"""

_REFERENCE = re.compile(r"\{(\w+)\}")


def view_order(names: list[str]) -> list[str]:
    """The views needed for ``names``, each after the views it reads."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for needed in _REFERENCE.findall(VIEWS[name]):
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(sql: str) -> str:
    """DuckDB text of ``sql``: the views it names become common table expressions."""
    names = _REFERENCE.findall(sql)
    plain = lambda text: _REFERENCE.sub(lambda m: m.group(1), text)
    parts = [f"{name} AS ({plain(VIEWS[name])})" for name in view_order(names)]
    body = plain(sql).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Fixtures:
    """Lazy access to the test tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        self._made: dict[str, str] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in TABLES:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                frame = self.spark.sql(text, **{n: self[n] for n in set(_REFERENCE.findall(text))})
            self._frames[name] = frame
        return self._frames[name]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``build``, written to the shared folder once per session and read from there.

        For tables that later steps read again and again: recomputing them would repeat the work,
        caching them would lose it with an executor.
        """
        if name not in self._frames:
            self._frames[name] = written(build(), name)
        return self._frames[name]

    def made(self, name: str, build: Callable[[], str]) -> str:
        """The path that ``build`` wrote to, made once per session."""
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]


_open: dict[tuple[int, str], Fixtures] = {}


def fixtures(spark: SparkSession, folder: str) -> Fixtures:
    """The fixtures of a folder, opened once per session."""
    key = (id(spark._jsparkSession), folder)
    if key not in _open or _open[key].spark is not spark:
        ship_package(spark)
        _open[key] = Fixtures(spark, folder)
    return _open[key]

"""SQL fragments the check queries share. DuckDB reads them; Spark never does."""

from veritrail.plans.fixtures import VIEWS


def sql_round(x: str, digits: int) -> str:
    """Round the column ``x`` on its exact binary value, ties to even."""
    scale, unit = f"{10 ** (digits + 1)}::DOUBLE", f"{10 ** digits}::DOUBLE"
    near = f"round({x} * {scale})"
    high = f"({x} * 134217729::DOUBLE - ({x} * 134217729::DOUBLE - {x}))"
    error = f"(({high} * {scale} - {near}) + ({x} - {high}) * {scale})"
    below = f"floor({near} / 10::DOUBLE)"
    return (
        f"CASE WHEN CAST(abs({near}) AS BIGINT) % 10 = 5 AND abs({error}) < 0.25 THEN "
        f"CASE WHEN {error} > 0 OR ({error} = 0 AND CAST({below} AS BIGINT) % 2 <> 0) "
        f"THEN ({below} + 1) / {unit} ELSE {below} / {unit} END "
        f"ELSE round({x} * {unit}) / {unit} END"
    )


def sql_rating(x: str) -> str:
    return f"CASE WHEN {x} >= 8 THEN 'A' WHEN {x} >= 6 THEN 'B' WHEN {x} >= 4 THEN 'C' WHEN {x} >= 2 THEN 'D' ELSE 'E' END"


NORMAL = """CASE WHEN answer IN ('Nao', 'nao', 'NAO', 'não') THEN 'Não' WHEN answer IN ('sim', 'SIM') THEN 'Sim'
            WHEN answer IN ('Sim', 'Não', 'N/A') THEN answer ELSE 'N/A' END"""

RAW_ORDER = ["created_at", "l_orderkey", "l_linenumber", "answer", "l_quantity", "l_extendedprice", "confidence_score"]
LATEST = ", ".join(f"{c} DESC" for c in RAW_ORDER)
EARLIEST = ", ".join(RAW_ORDER)

VIEWS["o_answers"] = f"""
SELECT analysis_id, company_id, report_year, question_pk, created_at, confidence_score, {NORMAL} AS answer
FROM {{d_answers_raw}}
QUALIFY row_number() OVER (PARTITION BY analysis_id, question_pk ORDER BY {LATEST}) = 1"""

VIEWS["o_theme_scores"] = f"""
SELECT analysis_id, company_id, report_year, theme_id, scored, matches, {sql_round('x', 2)} AS raw_score
FROM (SELECT analysis_id, company_id, report_year, theme_id, count(*) FILTER (WHERE answer <> 'N/A') AS scored,
             count(*) FILTER (WHERE answer <> 'N/A' AND answer = expected_answer) AS matches,
             CASE WHEN count(*) FILTER (WHERE answer <> 'N/A') > 0
                  THEN count(*) FILTER (WHERE answer <> 'N/A' AND answer = expected_answer) * 10::DOUBLE
                       / count(*) FILTER (WHERE answer <> 'N/A') ELSE 0 END AS x
      FROM {{o_answers}} JOIN {{d_questions}} USING (question_pk)
      GROUP BY analysis_id, company_id, report_year, theme_id)"""

VIEWS["o_weighted"] = """
SELECT s.*, c.sector, t.dimension, coalesce(m.weight, 1.0)::DOUBLE AS weight,
       s.raw_score * coalesce(m.weight, 1.0)::DOUBLE AS weighted_score
FROM {o_theme_scores} s LEFT JOIN {d_companies} c USING (company_id) JOIN {d_themes} t USING (theme_id)
LEFT JOIN {d_materiality} m ON m.sector = c.sector AND m.theme_id = s.theme_id"""


def sql_weighted_mean(condition: str = "TRUE") -> str:
    points = f"sum(raw_score::DECIMAL(4,2) * weight::DECIMAL(12,6)) FILTER (WHERE {condition})"
    total = f"sum(weight::DECIMAL(12,6)) FILTER (WHERE {condition})"
    return f"CASE WHEN {total} > 0 THEN {points}::DOUBLE / {total}::DOUBLE ELSE 0::DOUBLE END"


VIEWS["o_exact"] = f"""
SELECT *, environmental * 0.35::DOUBLE + social * 0.30::DOUBLE + governance * 0.35::DOUBLE AS overall
FROM (SELECT analysis_id, company_id, report_year,
             {sql_weighted_mean("dimension = 'environmental'")} AS environmental,
             {sql_weighted_mean("dimension = 'social'")} AS social,
             {sql_weighted_mean("dimension = 'governance'")} AS governance
      FROM {{o_weighted}} GROUP BY analysis_id, company_id, report_year)"""

VIEWS["o_overall"] = f"""
SELECT analysis_id, company_id, report_year, {sql_round('environmental', 2)} AS environmental_score,
       {sql_round('social', 2)} AS social_score, {sql_round('governance', 2)} AS governance_score,
       {sql_round('overall', 2)} AS overall_score, {sql_rating('overall')} AS overall_rating
FROM {{o_exact}}"""


def sql_blocks(text: str) -> str:
    strip = "list_filter(list_transform({}, lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
    blocks = strip.format(f"string_split_regex({text}, '\\n\\s*\\n')")
    lines = strip.format(f"string_split({text}, chr(10))")
    return f"CASE WHEN len({blocks}) <= 1 AND contains({text}, chr(10)) THEN {lines} ELSE {blocks} END"


def sql_packing(paragraphs: str) -> str:
    """Chunks of ``paragraphs`` (doc_id, parts, pages): word counts are folded one paragraph per round."""
    return f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, parts, pages, list_transform(parts, lambda s: len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> ''))) AS counts
  FROM ({paragraphs}) WHERE len(parts) > 0),
fold AS (
  SELECT doc_id, counts, 0 AS i, 0 AS first, 0 AS fresh, 0::BIGINT AS words, NULL::INT AS c_first, NULL::INT AS c_fresh,
         NULL::INT AS c_last, NULL::BIGINT AS c_words FROM counted
  UNION ALL
  SELECT doc_id, counts, i + 1, CASE WHEN closing THEN i - 1 ELSE first END, CASE WHEN closing THEN i ELSE fresh END,
         CASE WHEN closing THEN counts[i] ELSE words END + counts[i + 1],
         CASE WHEN closing THEN first END, CASE WHEN closing THEN fresh END, CASE WHEN closing THEN i - 1 END,
         CASE WHEN closing THEN words END
  FROM (SELECT *, words + counts[i + 1] > 500 AND first < i AS closing FROM fold WHERE i < len(counts))),
ranges AS (
  SELECT doc_id, c_first AS a, c_fresh AS f, c_last AS b, c_words AS words FROM fold WHERE c_last IS NOT NULL
  UNION ALL SELECT doc_id, first, fresh, i - 1, words FROM fold WHERE i = len(counts)),
placed AS (
  SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY b) - 1 AS chunk_index,
         array_to_string(c.parts[a + 1:b + 1], chr(10) || chr(10)) AS content, words AS token_count,
         list_sort(list_distinct(list_filter(c.pages[f + 1:b + 1], lambda p: p > 0))) AS page_list
  FROM ranges r JOIN counted c USING (doc_id))
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, content, CAST(token_count AS INT) AS token_count,
       list_min(page_list) AS page_number, CASE WHEN len(page_list) > 0 THEN page_list END AS page_range FROM placed"""


SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),"
    " lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
)
VIEWS["o_chunks"] = sql_packing(
    f"""SELECT doc_id, CASE WHEN len(b) <= 1 AND length(text) > 2000 THEN {SENTENCES} ELSE b END AS parts,
    list_transform(CASE WHEN len(b) <= 1 AND length(text) > 2000 THEN {SENTENCES} ELSE b END, lambda s: 0) AS pages
    FROM (SELECT doc_id, text, {sql_blocks('text')} AS b FROM {{d_documents}})"""
)
VIEWS["o_paged_chunks"] = sql_packing(
    f"""SELECT conv_id AS doc_id, flatten(list(parts ORDER BY turn)) AS parts,
    flatten(list(list_transform(parts, lambda s: CAST(turn + 1 AS INT)) ORDER BY turn)) AS pages
    FROM (SELECT conv_id, turn, {sql_blocks('text')} AS parts FROM {{conversations}}) GROUP BY conv_id"""
)


STOP = """'para', 'como', 'mais', 'sobre', 'qual', 'quais', 'pela', 'pelo', 'seus', 'suas', 'esse', 'essa', 'esses', 'esta',
 'este', 'sido', 'cada', 'ainda', 'mesmo', 'entre', 'sendo', 'outros', 'outras', 'muito', 'pode', 'deve', 'onde', 'apos',
 'forma', 'tipo', 'anos', 'possui', 'empresa', 'tema', 'seguintes', 'temas', 'relacionada'"""

# Query vectors: the mean vector of every label. Query texts: the benchmark passages.
VIEWS["o_query_vectors"] = """
SELECT label AS query_id, list(m ORDER BY i) AS v
FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
      FROM {embeddings}) GROUP BY label, i) GROUP BY label"""
VIEWS["o_vector_pairs"] = """
SELECT d.company_id, d.report_year, e.vec_id AS doc_id, 0 AS chunk_index, q.query_id,
       round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 9) AS score
FROM {embeddings} e JOIN {d_documents} d ON d.doc_id = e.vec_id AND d.status = 'ready' CROSS JOIN {o_query_vectors} q"""
VIEWS["o_keyword_pairs"] = f"""
SELECT * FROM (
  SELECT d.company_id, d.report_year, c.doc_id, c.chunk_index, b.query_id,
         len(list_filter(b.words, lambda w: contains(lower(c.content), w))) AS score
  FROM {{o_chunks}} c JOIN {{d_documents}} d ON d.doc_id = c.doc_id AND d.status = 'ready'
  CROSS JOIN (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'),
              lambda w: length(w) > 3 AND w NOT IN ({STOP}))) AS words FROM {{benchmark}}) b)
WHERE score > 0"""


def sql_rank(pairs: str, scope: str, k: int) -> str:
    by = f"{scope}, query_id" if scope else "query_id"
    return (f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id, chunk_index) AS rank"
            f" FROM {pairs} QUALIFY rank <= {k}")


VIEWS["o_hybrid"] = f"""
SELECT company_id, report_year, doc_id, chunk_index, query_id, score, rank, 'vector' AS method
FROM ({sql_rank("{o_vector_pairs} WHERE score >= 0.3", 'company_id, report_year', 20)})
UNION ALL
SELECT company_id, report_year, doc_id, chunk_index, query_id, score::DOUBLE, rank, 'keyword'
FROM ({sql_rank('{o_keyword_pairs}', 'company_id, report_year', 20)}) k
WHERE NOT EXISTS (SELECT 1 FROM {{o_vector_pairs}} v WHERE v.score >= 0.3 AND v.company_id = k.company_id
                  AND v.report_year = k.report_year AND v.query_id = k.query_id)"""
VIEWS["o_hybrid_texts"] = """
SELECT h.*, c.content, d.filename, CAST(h.doc_id % 40 + 1 AS INT) AS page_number,
       CASE WHEN h.doc_id % 3 = 0 THEN h.doc_id % 40 + 3 END AS last_page
FROM {o_hybrid} h JOIN {o_chunks} c USING (doc_id, chunk_index) JOIN {d_documents} d USING (doc_id)"""


_ENTITIES = [("&oacute;", "ó"), ("&otilde;", "õ"), ("&ccedil;", "ç"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def sql_nodes(html: str) -> str:
    """The trimmed, decoded texts between the tags of the fixture's pages."""
    text = f"regexp_replace({html}, '<[a-zA-Z/!?][^>]*>', chr(1), 'g')"
    for name, char in _ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    return f"list_filter(list_transform(string_split({text}, chr(1)), lambda s: trim(s, {_BLANKS})), lambda s: s <> '')"


def sql_clean(text: str) -> str:
    squeezed = f"regexp_replace(regexp_replace({text}, '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    squeezed = squeezed.replace("{{3,}}", "{3,}")
    lines = f"list_transform(string_split({squeezed}, chr(10)), lambda s: trim(s, {_BLANKS}))"
    return f"trim(array_to_string({lines}, chr(10)), {_BLANKS})"

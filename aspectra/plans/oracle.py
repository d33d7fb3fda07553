"""DuckDB SQL oracles, one per catalogue entry (same column names and types).

The SQL is assembled from shared CTE fragments that restate the derivation
rules of ``aspectra.plans.tables`` in plain SQL.
"""

from __future__ import annotations

from aspectra.functions.text import WORD_CLASS, WS_CHARS, WS_CLASS
from aspectra.operators.prepare import NA_STRINGS
from aspectra.plans import tables as D

ORACLE: dict[str, str] = {}

WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"
WORD = WORD_CLASS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def mark(x: str) -> str:
    return f"regexp_replace({x}, '([{WORD}]+)', chr(1) || '\\1' || chr(1), 'g')"


def word_runs(x: str) -> str:
    return f"regexp_extract_all({x}, '[{WORD}]+')"


def contains_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def seq_split(x: str, delims) -> str:
    expr = f"[{x}]"
    for d in delims:
        expr = f"flatten(list_transform({expr}, lambda p: string_split(p, {q(d)})))"
    return expr


def split_clauses(x: str, delims) -> str:
    return f"list_filter(list_transform({seq_split(x, delims)}, lambda p: {strip('p')}), lambda p: p <> '')"


def clean(x: str) -> str:
    out = f"regexp_replace({x}, '\\*+', '', 'g')"
    out = f"regexp_replace({out}, '#[^{WS_CLASS}]+', '', 'g')"
    out = f"regexp_replace({out}, 'http[^{WS_CLASS}]+', '', 'g')"
    return f"regexp_replace({out}, '[^{WORD}{WS_CLASS},.!?:;<>/]', '', 'g')"


def na(x: str) -> str:
    return f"CASE WHEN {x} IN ({', '.join(q(s) for s in NA_STRINGS)}) THEN NULL ELSE {x} END"


def remap(x: str) -> str:
    return f"CASE WHEN {x} = -1 THEN 0 WHEN {x} = 0 THEN 1 WHEN {x} = 1 THEN 2 END"


# ---------------------------------------------------------------- shared CTEs
RAW_LINES = """raw_lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
)"""

LINES = RAW_LINES + f""",
lines AS (SELECT doc_id, line_no, line AS sentence FROM raw_lines WHERE {strip('line')} <> '')"""

LEXICON = f"""bench_tok AS (SELECT {word_runs('lower(text)')} AS t FROM benchmark),
lexicon AS (
  SELECT DISTINCT keyword FROM (
    SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS keyword
    FROM bench_tok)
),
lex AS (
  SELECT keyword, length(keyword) AS kw_len, {mark('keyword')} AS kw_marked,
         {word_runs('keyword')}[1] AS kw_first
  FROM (SELECT DISTINCT lower(keyword) AS keyword FROM lexicon)
)"""

CLAUSES = f"""clauses AS (
  SELECT doc_id, line_no, unnest(range(len(parts))) AS clause_no, unnest(parts) AS clause
  FROM (
    SELECT doc_id, line_no,
      CASE WHEN {contains_any('lower(sentence)', D.CONNECTOR_GATE)}
           THEN {split_clauses('lower(sentence)', D.CONNECTOR_SPLIT)}
           ELSE [lower(sentence)] END AS parts
    FROM lines)
)"""

MAIN = f"""clause_hits AS (
  SELECT c.doc_id, c.line_no, c.clause_no, c.clause, x.keyword, x.kw_len
  FROM (SELECT *, {mark('clause')} AS m FROM clauses) c JOIN lex x ON contains(c.m, x.kw_marked)
),
main AS (
  SELECT doc_id, line_no, clause_no, clause, keyword AS aspect FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, clause_no ORDER BY kw_len DESC, keyword) AS rn
    FROM clause_hits) WHERE rn = 1
)"""

LINE_HITS = f"""line_hits AS (
  SELECT l.doc_id, l.line_no, x.keyword, x.kw_len
  FROM (SELECT *, {mark('lower(sentence)')} AS m FROM lines) l JOIN lex x ON contains(l.m, x.kw_marked)
),
line_main AS (
  SELECT doc_id, line_no, keyword AS aspect FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY kw_len DESC, keyword) AS rn
    FROM line_hits) WHERE rn = 1
)"""

RAW_TRIPLES = f"""raw_triples AS (
  SELECT l.doc_id, l.line_no, replace(lower(l.sentence), m.aspect, '$T$') AS sentence, m.aspect,
         CAST(CASE WHEN b.toxic = 1 THEN -1 WHEN b.quality = 0 THEN 0 ELSE 1 END AS VARCHAR) AS sentiment
  FROM lines l JOIN labels b ON l.doc_id = b.doc_id
  JOIN line_main m ON l.doc_id = m.doc_id AND l.line_no = m.line_no
)"""


def three(x: str) -> str:
    return f"CASE WHEN len(string_split({strip(x)}, chr(9))) = 3 THEN string_split({strip(x)}, chr(9)) END"


PREPARED = f"""step1 AS (
  SELECT doc_id, line_no,
    {three("replace(sentence, '$T$', '<aspect> ' || aspect || ' </aspect>') || chr(9) || aspect || chr(9) || sentiment")} AS f
  FROM raw_triples
),
step2 AS (
  SELECT doc_id, line_no, {three(f"{clean('f[1]')} || chr(9) || {clean('f[2]')} || chr(9) || f[3]")} AS f
  FROM step1 WHERE f IS NOT NULL
),
prepared AS (
  SELECT * FROM (
    SELECT doc_id, line_no, {na('f[1]')} AS sentence, {na("replace(f[2], '.', '')")} AS aspect,
           {remap('TRY_CAST(f[3] AS INTEGER)')} AS sentiment
    FROM step2 WHERE f IS NOT NULL)
  WHERE sentence IS NOT NULL AND aspect IS NOT NULL AND sentiment IS NOT NULL
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


TRIPLES_CTES = (LINES, LEXICON, LINE_HITS, RAW_TRIPLES)

# ---------------------------------------------------------------- sources
ORACLE["lexicon_set"] = with_(LEXICON) + "SELECT DISTINCT keyword FROM lexicon"
ORACLE["lexicon_ranked"] = with_(LEXICON) + """SELECT keyword, CAST(kw_len AS BIGINT) AS kw_len, kw_first,
  CAST(row_number() OVER (ORDER BY kw_len DESC, keyword) AS BIGINT) AS rank_no FROM lex"""

VALID = f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, f[1] AS sentence, f[2] AS aspect, f[3] AS sentiment
FROM (SELECT doc_id, line_no, {three("replace(sentence, ', ', chr(9))")} AS f FROM lines) WHERE f IS NOT NULL"""
ORACLE["valid_triples"] = with_(LINES) + VALID
ORACLE["read_tsv"] = with_(LINES) + f"""SELECT doc_id, line_no, {na('sentence')} AS sentence,
  {na('aspect')} AS aspect, {na('sentiment')} AS sentiment FROM ({VALID})"""

THREE_LINE = f"""groups AS (
  SELECT file_no, line_no // 3 AS rec_no,
    max(CASE WHEN line_no % 3 = 0 THEN {strip('line')} END) AS sentence,
    max(CASE WHEN line_no % 3 = 1 THEN {strip('line')} END) AS aspect,
    max(CASE WHEN line_no % 3 = 2 THEN {strip('line')} END) AS sentiment,
    count(*) AS n_lines
  FROM (SELECT doc_id // 100 AS file_no, line,
               row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id, line_no) - 1 AS line_no FROM raw_lines)
  GROUP BY 1, 2
)"""
ORACLE["read_three_line"] = with_(RAW_LINES, THREE_LINE) + """SELECT file_no, CAST(rec_no AS BIGINT) AS rec_no,
  sentence, aspect, sentiment FROM groups WHERE n_lines = 3"""
ORACLE["three_line_rejects"] = with_(RAW_LINES, THREE_LINE) + """SELECT file_no, CAST(rec_no AS BIGINT) AS rec_no,
  CAST(n_lines AS BIGINT) AS n_lines, sentence FROM groups WHERE n_lines < 3"""

# ---------------------------------------------------------------- transforms
ORACLE["mark_aspect"] = with_(*TRIPLES_CTES) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  replace(sentence, '$T$', '<aspect> ' || aspect || ' </aspect>') AS marked FROM raw_triples"""
ORACLE["format_triple"] = with_(*TRIPLES_CTES) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  sentence || chr(9) || aspect || chr(9) || sentiment AS line FROM raw_triples"""
ORACLE["clean_text"] = with_(LINES) + f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {clean('sentence')} AS cleaned FROM lines"
ORACLE["clean_pages"] = f"SELECT page_id, {clean('url')} AS url_clean, {clean('html')} AS html_clean FROM pages"
ORACLE["aspect_no_period"] = with_(LINES) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  replace(sentence, '.', '') AS no_period FROM lines"""

CODED = "coded AS (SELECT doc_id, quality * 2 + toxic - 1 AS code, quality, toxic FROM labels)"
ORACLE["remap_label"] = with_(CODED) + f"""SELECT doc_id, CAST(code AS BIGINT) AS code,
  CAST({remap('code')} AS BIGINT) AS sentiment FROM coded"""
ORACLE["decode_label"] = with_(CODED) + """SELECT doc_id, CAST(code + 1 AS BIGINT) AS cls,
  CASE WHEN code + 1 = 0 THEN 'negative' WHEN code + 1 = 1 THEN 'neutral' ELSE 'positive' END AS label FROM coded"""
ORACLE["decode_label_title"] = with_(CODED) + """SELECT doc_id, CAST(code + 1 AS BIGINT) AS cls,
  CASE WHEN code + 1 = 2 THEN 'Positive' WHEN code + 1 = 1 THEN 'Neutral' ELSE 'Negative' END AS label FROM coded"""
NULLABLE = CODED + f""",
nullable AS (SELECT doc_id, {remap('code')} AS sentiment, nullif(quality, 0) AS quality, toxic FROM coded)"""
ORACLE["null_profile"] = with_(NULLABLE) + """SELECT column_name, CAST(null_count AS BIGINT) AS null_count FROM (
  SELECT 'doc_id' AS column_name, count(*) FILTER (WHERE doc_id IS NULL) AS null_count FROM nullable
  UNION ALL SELECT 'sentiment', count(*) FILTER (WHERE sentiment IS NULL) FROM nullable
  UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM nullable
  UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM nullable)"""
ORACLE["drop_nulls"] = with_(NULLABLE) + """SELECT doc_id, CAST(sentiment AS BIGINT) AS sentiment,
  CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM nullable
  WHERE doc_id IS NOT NULL AND sentiment IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL"""
ORACLE["strip_ws"] = with_(RAW_LINES) + f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {strip('line')} AS stripped FROM raw_lines"
ORACLE["prepare_triples"] = with_(*TRIPLES_CTES, PREPARED) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  sentence, aspect, CAST(sentiment AS BIGINT) AS sentiment FROM prepared"""

# ---------------------------------------------------------------- clauses
ORACLE["clause_gate"] = with_(LINES) + f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CAST({contains_any('lower(sentence)', D.CONNECTOR_GATE)} AS BIGINT) AS gate FROM lines"""
ORACLE["split_clauses"] = with_(LINES) + f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CAST(unnest(range(len(parts))) AS BIGINT) AS clause_no, unnest(parts) AS clause
  FROM (SELECT doc_id, line_no, {split_clauses('sentence', D.CONNECTOR_SPLIT)} AS parts FROM lines)"""
CLAUSE_CTES = (LINES, LEXICON, CLAUSES, MAIN)
ORACLE["aspect_prompt"] = with_(*CLAUSE_CTES) + f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CAST(clause_no AS BIGINT) AS clause_no, format({q(D.PROMPT_EN.replace('%s', '{}'))}, aspect, clause) AS prompt FROM main"""

# ---------------------------------------------------------------- matching
ORACLE["match_substring"] = with_(LINES, LEXICON) + """SELECT l.doc_id, CAST(l.line_no AS BIGINT) AS line_no, x.keyword
  FROM lines l JOIN (SELECT DISTINCT keyword FROM lexicon) x ON contains(l.sentence, x.keyword)"""
ORACLE["match_word"] = with_(LINES, LEXICON, LINE_HITS) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, keyword
  FROM line_hits"""
ORACLE["main_aspect"] = with_(*CLAUSE_CTES) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CAST(clause_no AS BIGINT) AS clause_no, aspect FROM main"""
ORACLE["clauses_without_aspect"] = with_(*CLAUSE_CTES) + """SELECT c.doc_id, CAST(c.line_no AS BIGINT) AS line_no,
  CAST(c.clause_no AS BIGINT) AS clause_no, c.clause FROM clauses c
  WHERE NOT EXISTS (SELECT 1 FROM main m WHERE m.doc_id = c.doc_id AND m.line_no = c.line_no AND m.clause_no = c.clause_no)"""
ORACLE["aspect_counts"] = with_(*CLAUSE_CTES) + """SELECT aspect, CAST(count(*) AS BIGINT) AS n_clauses,
  CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM main GROUP BY aspect"""


def all_oracles() -> dict[str, str]:
    from aspectra.plans import oracle_model  # noqa: F401  (registers more entries)
    from aspectra.plans import oracle_eval  # noqa: F401
    from aspectra.plans import oracle_infer  # noqa: F401
    from aspectra.plans import oracle_fit  # noqa: F401
    from aspectra.plans import oracle_files  # noqa: F401

    return dict(ORACLE)

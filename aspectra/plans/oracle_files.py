"""Oracle SQL for quoted TSV, the lexicon from a file and the other two encodings."""

from __future__ import annotations

from aspectra.operators import features as FE
from aspectra.plans import tables as D
from aspectra.plans.oracle import LEXICON, ORACLE, na, q, with_
from aspectra.plans.oracle_model import BASE, ENCODE, split_ws
from aspectra.plans.queries_files import SHORT

FIELDS = f"""fields AS (
  SELECT doc_id, trim(replace(replace(text, ', ', chr(9)), '. ', ' "." '), chr(13) || chr(10)) AS sentence,
         'the "' || coalesce(lang, 'NA') || '"' AS aspect, doc_id % 3 - 1 AS sentiment
  FROM documents WHERE text IS NOT NULL
)"""
ORACLE["read_tsv_quoted"] = with_(FIELDS) + f"""SELECT doc_id, {na('sentence')} AS sentence, {na('aspect')} AS aspect,
  CAST(sentiment AS BIGINT) AS sentiment FROM fields"""
ORACLE["tsv_quoted_kept"] = with_(FIELDS) + f"""SELECT doc_id, {na('sentence')} AS sentence, aspect,
  CAST(CASE WHEN doc_id % 5 = 4 THEN sentiment END AS BIGINT) AS sentiment FROM fields WHERE doc_id % 5 IN (3, 4)"""
QUOTED = "'\"' || replace(aspect, '\"', '\"\"') || '\"'"
ORACLE["tsv_quoted_rejects"] = with_(FIELDS) + f"""SELECT CASE WHEN doc_id % 5 = 2 THEN 'int' ELSE 'fields' END AS reason,
  CASE WHEN doc_id % 5 = 2 THEN 'sentiment' END AS "column", CASE WHEN doc_id % 5 = 2 THEN 'x' || sentiment END AS value,
  CASE doc_id % 5 WHEN 0 THEN doc_id || chr(9) || '"short' || chr(9) || doc_id || '"' || chr(9) || {QUOTED}
    WHEN 1 THEN doc_id || chr(9) || '"long' || chr(9) || doc_id || '"' || chr(9) || {QUOTED} || chr(9) || sentiment || chr(9) || 'more' END AS record
FROM fields WHERE doc_id % 5 < 3"""

ORACLE["lexicon_from_file"] = with_(LEXICON) + """SELECT keyword, CAST(kw_len AS BIGINT) AS kw_len,
  CAST(row_number() OVER (ORDER BY kw_len DESC, keyword) AS BIGINT) AS rank_no FROM lex"""
ORACLE["main_aspect_ranked"] = ORACLE["main_aspect"]

FIRST = f"""firsts AS (
  SELECT doc_id, line_no, ia, ib, greatest(len(ia) - greatest(len(ia) + len(ib) - {SHORT - 4}, 0), 0) AS ka, least(len(ib), {SHORT - 4}) AS kb FROM pairs
),
first_ids AS (
  SELECT doc_id, line_no, flatten([[{FE.BOS_ID}], ia[1:ka], [{FE.EOS_ID}, {FE.EOS_ID}], ib[1:kb], [{FE.EOS_ID}]]) AS ids FROM firsts
)"""


def padded(src: str, length: int) -> str:
    return f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  array_to_string(list_concat(ids, list_transform(range({length} - len(ids)), lambda x: {FE.PAD_ID})), ' ') AS input_ids,
  CAST(len(ids) AS BIGINT) AS n_attended FROM {src}"""


ORACLE["encode_first"] = with_(*BASE[:5], ENCODE, FIRST) + padded("first_ids", SHORT)
PROMPT = f"format({q(D.PROMPT_EN.replace('%s', '{}'))}, aspect, sentence)"
SINGLE = f"""texts AS (SELECT doc_id, line_no, {split_ws('prompt')} AS ws FROM (SELECT *, {PROMPT} AS prompt FROM prepared)),
single_words AS (SELECT doc_id, line_no, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM texts),
single_vocab AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) + {FE.UNK_ID} AS id FROM (SELECT word, count(*) AS n FROM single_words GROUP BY word)
),
single_ids AS (
  SELECT t.doc_id, t.line_no, flatten([[{FE.BOS_ID}], coalesce(list(v.id ORDER BY w.pos) FILTER (v.id IS NOT NULL), [])[1:{FE.MAX_LENGTH - 2}], [{FE.EOS_ID}]]) AS ids
  FROM texts t LEFT JOIN single_words w ON w.doc_id = t.doc_id AND w.line_no = t.line_no LEFT JOIN single_vocab v USING (word) GROUP BY t.doc_id, t.line_no
)"""
ORACLE["encode_single"] = with_(*BASE[:5], SINGLE) + padded("single_ids", FE.MAX_LENGTH)

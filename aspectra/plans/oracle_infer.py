"""Oracle SQL for inference and the aspect map."""

from __future__ import annotations

from aspectra.plans import tables as D
from aspectra.plans.oracle import CLAUSES, LEXICON, LINE_HITS, LINES, MAIN, ORACLE, PREPARED, RAW_TRIPLES, q, with_
from aspectra.plans.oracle_model import SPLIT, nb_fit, nb_proba_fix, nb_score

CK = ("doc_id", "line_no", "clause_no")
FMT = q(D.PROMPT_EN.replace("%s", "{}"))

MODELS = (
    nb_fit("b", "train", "sentence", 1, 4, 1.0),
    f"train_p AS (SELECT *, format({FMT}, aspect, sentence) AS prompt FROM train)",
    nb_fit("pa", "train_p", "prompt", 1, 1, 0.1),
)
BASE = (LINES, LEXICON, LINE_HITS, RAW_TRIPLES, PREPARED, SPLIT, *MODELS, CLAUSES, MAIN)

INFER = (
    f"main_p AS (SELECT *, format({FMT}, aspect, clause) AS prompt FROM main)",
    nb_score("pa", "ia", "main_p", "prompt", 1, 1, CK),
    nb_proba_fix("ia", CK),
    nb_score("b", "ib", "main", "clause", 1, 4, CK),
    """ia_best AS (
  SELECT doc_id, line_no, clause_no, cls AS pred_a, p AS p_a FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, clause_no ORDER BY p DESC, cls) AS rn FROM ia_prob)
  WHERE rn = 1
)""",
    """voted AS (
  SELECT m.doc_id, m.line_no, m.clause_no, m.aspect, a.pred_a, b.pred AS pred_b,
    CASE WHEN a.pred_a = b.pred THEN a.pred_a WHEN a.p_a * 0.6 > 0.4 THEN a.pred_a ELSE b.pred END AS final
  FROM main m
  JOIN ia_best a ON a.doc_id = m.doc_id AND a.line_no = m.line_no AND a.clause_no = m.clause_no
  JOIN ib_pred b ON b.doc_id = m.doc_id AND b.line_no = m.line_no AND b.clause_no = m.clause_no
)""",
)
INFER_SELECT = """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(clause_no AS BIGINT) AS clause_no, aspect,
  CAST(pred_a AS BIGINT) AS pred_a, CAST(pred_b AS BIGINT) AS pred_b, CAST(final AS BIGINT) AS final,
  CASE WHEN final = 2 THEN 'Positive' WHEN final = 1 THEN 'Neutral' ELSE 'Negative' END AS sentiment FROM voted"""
ORACLE["infer_aspects"] = with_(*BASE, *INFER) + INFER_SELECT
for name in ("stream_infer", "stream_infer_batches", "infer_row_local"):
    ORACLE[name] = ORACLE["infer_aspects"]

def _letters(c: str) -> str:
    return f"length(prompt) - length(replace(prompt, '{c}', ''))"


USER = (
    INFER[0],
    f"""ua AS (
  SELECT doc_id, line_no, clause_no, length(prompt) % 7 - 2 + ({_letters(" ")}) % 6 - 2 AS s0,
    ({_letters("e")}) % 5 - 2 + ({_letters("o")}) % 3 - 2 AS s1, ({_letters("a")}) % 4 - 2 + ({_letters("t")}) % 5 - 2 AS s2 FROM main_p
)""",
    """ia_best AS (
  SELECT doc_id, line_no, clause_no, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred_a,
    greatest(s0, s1, s2) AS p_a FROM ua
)""",
    INFER[3],
    INFER[-1],
)
ORACLE["infer_user_scorer"] = with_(LINES, LEXICON, LINE_HITS, RAW_TRIPLES, PREPARED, SPLIT, MODELS[0], CLAUSES, MAIN, *USER) + INFER_SELECT

HK = ("doc_id", "line_no", "aspect")
ALL_HITS = (
    f"""hit_p AS (
  SELECT l.doc_id, l.line_no, x.keyword AS aspect, format({FMT}, x.keyword, l.sentence) AS prompt
  FROM lines l JOIN (SELECT DISTINCT keyword FROM lexicon) x ON contains(l.sentence, x.keyword)
)""",
    nb_score("pa", "ha", "hit_p", "prompt", 1, 1, HK),
    """hits_scored AS (
  SELECT doc_id, line_no, aspect, pred,
    CASE WHEN pred = 0 THEN 'negative' WHEN pred = 1 THEN 'neutral' ELSE 'positive' END AS label FROM ha_pred
)""",
)
ORACLE["infer_all_hits"] = with_(*BASE, *ALL_HITS) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, aspect,
  CAST(pred AS BIGINT) AS pred, label FROM hits_scored"""
ORACLE["aspect_map"] = with_(*BASE, *ALL_HITS) + """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CAST(count(*) AS BIGINT) AS n_aspects, string_agg(aspect || '=' || label, ';' ORDER BY aspect, label) AS aspect_map
  FROM hits_scored GROUP BY doc_id, line_no"""

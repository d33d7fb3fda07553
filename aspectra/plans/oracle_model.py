"""Oracle SQL for features and the Naive Bayes slice."""

from __future__ import annotations

from aspectra.operators import features as FE
from aspectra.plans import tables as D
from aspectra.plans.oracle import (
    LEXICON,
    LINE_HITS,
    LINES,
    ORACLE,
    PREPARED,
    RAW_TRIPLES,
    WORD,
    WS_CLASS,
    q,
    strip,
    with_,
)


def vec_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]{{2,}}')"


def ngrams(t: str, lo: int, hi: int) -> str:
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
        else:
            parts.append(f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def grams_cte(px: str, src: str, text: str, lo: int, hi: int, cols, keys) -> str:
    """Word n-grams lo..hi of the vectoriser tokens, built from lead() over token positions."""
    c = ", ".join(cols)
    k = ", ".join(keys)
    leads = ", ".join(f"lead(tk, {j}) OVER w AS t{j}" for j in range(1, hi))
    grams = []
    for n in range(lo, hi + 1):
        grams.append(" || ' ' || ".join(["tk"] + [f"t{j}" for j in range(1, n)]))
    return f"""{px}_tok AS (
  SELECT {c}, unnest(range(len(t))) AS pos, unnest(t) AS tk FROM (SELECT {c}, {vec_tokens(text)} AS t FROM {src})
),
{px}_lead AS (SELECT {c}, tk{", " + leads if leads else ""} FROM {px}_tok{f" WINDOW w AS (PARTITION BY {k} ORDER BY pos)" if leads else ""}),
{px}_grams AS (
  SELECT {c}, term FROM (SELECT {c}, unnest([{", ".join(grams)}]) AS term FROM {px}_lead) WHERE term IS NOT NULL
)"""


SPLIT = f"""train AS (SELECT * FROM prepared WHERE doc_id % {D.TEST_FOLD} <> 0),
test AS (SELECT * FROM prepared WHERE doc_id % {D.TEST_FOLD} = 0)"""


def nb_fit(px: str, src: str, text: str, lo: int, hi: int, alpha: float, keys=("doc_id", "line_no")) -> str:
    k = ", ".join(keys)
    return f"""{grams_cte(px, src, text, lo, hi, (*keys, "sentiment"), keys)},
{px}_tf AS (SELECT {k}, sentiment, term, count(*) AS tf FROM {px}_grams GROUP BY ALL),
{px}_vocab AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, total, df,
         ln((1 + (SELECT count(*) FROM {src})) / (1 + df)) + 1 AS idf
  FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM {px}_tf GROUP BY term
        ORDER BY total DESC, term LIMIT {FE.MAX_FEATURES})
),
{px}_w AS (
  SELECT {k}, sentiment, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS weight
  FROM (SELECT f.*, v.idx, f.tf * v.idf AS w FROM {px}_tf f JOIN {px}_vocab v USING (term))
),
{px}_prior AS (
  SELECT sentiment AS cls, count(*) AS n, ln(count(*) / (SELECT count(*) FROM {src})) AS log_prior
  FROM {src} GROUP BY 1
),
{px}_fc AS (SELECT sentiment AS cls, term, sum(weight) AS fc FROM {px}_w GROUP BY 1, 2),
{px}_tot AS (SELECT cls, sum(fc) AS fc_total FROM {px}_fc GROUP BY 1),
{px}_lp AS (
  SELECT v.term, p.cls,
         ln(coalesce(f.fc, 0) + {alpha}) - ln(coalesce(t.fc_total, 0) + {alpha} * (SELECT count(*) FROM {px}_vocab)) AS log_prob
  FROM {px}_vocab v CROSS JOIN {px}_prior p
  LEFT JOIN {px}_fc f ON f.term = v.term AND f.cls = p.cls
  LEFT JOIN {px}_tot t ON t.cls = p.cls
)"""


def nb_score(px: str, name: str, src: str, text: str, lo: int, hi: int, keys=("doc_id", "line_no")) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"d.{c} = r.{c}" for c in keys)
    return f"""{grams_cte(name, src, text, lo, hi, keys, keys)},
{name}_tf AS (SELECT {k}, term, count(*) AS tf FROM {name}_grams GROUP BY ALL),
{name}_w AS (
  SELECT {k}, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS weight
  FROM (SELECT f.*, v.idx, f.tf * v.idf AS w FROM {name}_tf f JOIN {px}_vocab v USING (term))
),
{name}_dot AS (
  SELECT {", ".join("w." + c for c in keys)}, l.cls, sum(w.weight * l.log_prob) AS dot
  FROM {name}_w w JOIN {px}_lp l USING (term) GROUP BY ALL
),
{name}_s AS (
  SELECT {", ".join("r." + c for c in keys)}, p.cls, p.log_prior + coalesce(d.dot, 0) AS score
  FROM (SELECT DISTINCT {k} FROM {src}) r CROSS JOIN {px}_prior p
  LEFT JOIN {name}_dot d ON {on} AND d.cls = p.cls
),
{name}_pred AS (
  SELECT {k}, cls AS pred FROM (
    SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, cls) AS rn FROM {name}_s) WHERE rn = 1
)"""


def nb_proba_fix(name: str, keys=("doc_id", "line_no")) -> str:
    # DuckDB does not nest window functions; compute the max first.
    k = ", ".join(keys)
    return f"""{name}_mx AS (SELECT {k}, cls, score - max(score) OVER (PARTITION BY {k}) AS z FROM {name}_s),
{name}_prob AS (SELECT {k}, cls, exp(z) / sum(exp(z)) OVER (PARTITION BY {k}) AS p FROM {name}_mx)"""


BASE = (LINES, LEXICON, LINE_HITS, RAW_TRIPLES, PREPARED, SPLIT)
BAYES = nb_fit("b", "train", "sentence", 1, 4, 1.0)
TEST_SCORE = nb_score("b", "bt", "test", "sentence", 1, 4)
PRED = """bt_eval AS (SELECT t.doc_id, t.line_no, t.sentiment AS label, p.pred FROM test t
  JOIN bt_pred p ON p.doc_id = t.doc_id AND p.line_no = t.line_no)"""


def _int(c: str) -> str:
    return f"CAST({c} AS BIGINT) AS {c}"


ORACLE["tokenize"] = with_(*BASE[:5]) + f"""SELECT doc_id, {_int('line_no')},
  CAST(len({vec_tokens('sentence')}) AS BIGINT) AS n_tokens, array_to_string({vec_tokens('sentence')}, ' ') AS tokens
  FROM prepared"""
ORACLE["ngrams"] = with_(*BASE, BAYES) + f"SELECT doc_id, {_int('line_no')}, term, {_int('tf')} FROM b_tf"
ORACLE["vocabulary"] = with_(*BASE, BAYES) + f"SELECT term, {_int('idx')}, {_int('total')}, {_int('df')} FROM b_vocab"
ORACLE["idf"] = with_(*BASE, BAYES) + "SELECT term, round(idf, 6) AS idf FROM b_vocab"
ORACLE["tfidf"] = with_(*BASE, BAYES, TEST_SCORE) + f"SELECT doc_id, {_int('line_no')}, term, round(weight, 6) AS weight FROM bt_w"
ORACLE["nb_fit_prior"] = with_(*BASE, BAYES) + f"SELECT {_int('cls')}, {_int('n')}, round(log_prior, 6) AS log_prior FROM b_prior"
ORACLE["nb_fit_terms"] = with_(*BASE, BAYES) + f"SELECT term, {_int('cls')}, round(log_prob, 6) AS log_prob FROM b_lp"
ORACLE["model_roundtrip"] = ORACLE["nb_fit_terms"]
ORACLE["nb_predict"] = with_(*BASE, BAYES, TEST_SCORE, PRED) + f"SELECT doc_id, {_int('line_no')}, {_int('label')}, {_int('pred')} FROM bt_eval"
ORACLE["model_load_predict"] = ORACLE["nb_predict"]
ORACLE["nb_proba"] = with_(*BASE, BAYES, TEST_SCORE, nb_proba_fix("bt")) + f"""SELECT doc_id, {_int('line_no')},
  round(max(p) FILTER (WHERE cls = 0), 6) AS p0, round(max(p) FILTER (WHERE cls = 1), 6) AS p1,
  round(max(p) FILTER (WHERE cls = 2), 6) AS p2 FROM bt_prob GROUP BY doc_id, line_no"""


def accuracy_sql(src: str) -> str:
    return f"SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM {src}"


def report_sql(src: str, names=("negative", "neutral", "positive")) -> str:
    dims = " UNION ALL ".join(f"SELECT {i} AS cls, {q(n)} AS name" for i, n in enumerate(names))
    return f"""WITH dims AS ({dims}),
per0 AS (
  SELECT d.cls, d.name,
    (SELECT count(*) FROM {src} WHERE label = d.cls) AS support,
    (SELECT count(*) FROM {src} WHERE label = d.cls AND pred = d.cls) AS tp,
    (SELECT count(*) FROM {src} WHERE pred = d.cls) AS predicted
  FROM dims d
),
per1 AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
            CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per0
),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per1)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per"""


def confusion_sql(src: str, classes=(0, 1, 2)) -> str:
    dims = " UNION ALL ".join(f"SELECT {c} AS label" for c in classes)
    cols = ", ".join(
        f"CAST((SELECT count(*) FROM {src} s WHERE s.label = d.label AND s.pred = {c}) AS BIGINT) AS c{c}" for c in classes
    )
    return f"SELECT CAST(d.label AS BIGINT) AS label, {cols} FROM ({dims}) d"


ORACLE["nb_accuracy"] = with_(*BASE, BAYES, TEST_SCORE, PRED) + accuracy_sql("bt_eval")
ORACLE["nb_report"] = with_(*BASE, BAYES, TEST_SCORE, PRED) + "SELECT * FROM (" + report_sql("bt_eval") + ")"
ORACLE["nb_confusion"] = with_(*BASE, BAYES, TEST_SCORE, PRED) + confusion_sql("bt_eval")
ORACLE["concat_pad"] = with_(*BASE, BAYES, TEST_SCORE) + f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM (
    SELECT doc_id, line_no, cls AS pos, score AS value FROM bt_s
    UNION ALL SELECT doc_id, line_no, idx + 3 AS pos, weight AS value FROM bt_w)
  WHERE pos < {FE.FORCED_WIDTH} AND value <> 0"""


def split_ws(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({strip(x)}, '[{WS_CLASS}]+') END"


ENCODE = f"""words AS (
  SELECT doc_id, line_no, 'a' AS part, unnest(range(len(ws))) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, line_no, {split_ws('sentence')} AS ws FROM prepared)
  UNION ALL
  SELECT doc_id, line_no, 'b' AS part, unnest(range(len(ws))) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, line_no, {split_ws('aspect')} AS ws FROM prepared)
),
wvocab AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) + {FE.UNK_ID} AS id FROM (
    SELECT word, count(*) AS n FROM words GROUP BY word)
),
ids AS (
  SELECT w.doc_id, w.line_no, w.part, list(coalesce(v.id, {FE.UNK_ID}) ORDER BY w.pos) AS ids
  FROM words w LEFT JOIN wvocab v USING (word) GROUP BY ALL
),
pairs AS (
  SELECT p.doc_id, p.line_no, coalesce(a.ids, []) AS ia, coalesce(b.ids, []) AS ib
  FROM prepared p
  LEFT JOIN ids a ON a.doc_id = p.doc_id AND a.line_no = p.line_no AND a.part = 'a'
  LEFT JOIN ids b ON b.doc_id = p.doc_id AND b.line_no = p.line_no AND b.part = 'b'
),
cut AS (
  SELECT *, len(ia) AS la, len(ib) AS lb, greatest(len(ia) + len(ib) - {FE.MAX_LENGTH - 4}, 0) AS over FROM pairs
),
kept AS (
  SELECT doc_id, line_no, ia, ib,
    CASE WHEN over = 0 THEN la WHEN la - lb >= over THEN la - over WHEN lb - la >= over THEN la
         ELSE least(la, lb) - (greatest(over - abs(la - lb), 0) // 2) END AS ka,
    CASE WHEN over = 0 THEN lb WHEN la - lb >= over THEN lb WHEN lb - la >= over THEN lb - over
         ELSE least(la, lb) - ((greatest(over - abs(la - lb), 0) + 1) // 2) END AS kb
  FROM cut
),
enc AS (
  SELECT doc_id, line_no,
    list_concat(list_concat(list_concat(list_concat([{FE.BOS_ID}], ia[1:ka]), [{FE.EOS_ID}, {FE.EOS_ID}]), ib[1:kb]), [{FE.EOS_ID}]) AS ids
  FROM kept
)"""
ORACLE["encode_pairs"] = with_(*BASE[:5], ENCODE) + f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  array_to_string(list_concat(ids, list_transform(range({FE.MAX_LENGTH} - len(ids)), lambda x: {FE.PAD_ID})), ' ') AS input_ids,
  CAST(len(ids) AS BIGINT) AS n_attended FROM enc"""

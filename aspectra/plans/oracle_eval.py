"""Oracle SQL for scoring, fusion, evaluation, runs and balancing."""

from __future__ import annotations

from aspectra.functions.text import WS_CLASS
from aspectra.operators import synonyms as SY
from aspectra.plans import tables as D
from aspectra.plans.oracle import (
    LEXICON,
    LINE_HITS,
    LINES,
    ORACLE,
    PREPARED,
    RAW_TRIPLES,
    WORD,
    q,
    strip,
    with_,
)
from aspectra.plans.oracle_model import SPLIT, accuracy_sql, confusion_sql, nb_fit, nb_score, report_sql


def _residue(e: str, j: int, shift: int, sign: str) -> str:
    # 1-based position k holds component i = k - 1; class (i - shift) mod 3.
    return f"{sign}list_sum(list_filter({e}, lambda x, k: (k - 1 - {shift} + 3) % 3 = {j}))"


def _lse(a: str) -> str:
    m = f"greatest({a}[1], {a}[2], {a}[3])"
    return f"({m} + ln(exp({a}[1] - {m}) + exp({a}[2] - {m}) + exp({a}[3] - {m})))"


def _argmax(a: str) -> str:
    return f"(CASE WHEN {a}[1] >= {a}[2] AND {a}[1] >= {a}[3] THEN 0 WHEN {a}[2] >= {a}[3] THEN 1 ELSE 2 END)"


def _softmax(a: str) -> str:
    m = f"greatest({a}[1], {a}[2], {a}[3])"
    e = [f"exp({a}[{i}] - {m})" for i in (1, 2, 3)]
    tot = f"({e[0]} + {e[1]} + {e[2]})"
    return f"[{e[0]} / {tot}, {e[1]} / {tot}, {e[2]} / {tot}]"


def _ce(a: str, y: str) -> str:
    return f"({_lse(a)} - {a}[{y} + 1])"


def fusion_sql(src: str, keys: str) -> str:
    """``src`` with keys, label and the score lists la, lb -> fu (fused probabilities) and pr (classes)."""
    return f"""sm AS (SELECT *, {_softmax('la')} AS pa, {_softmax('lb')} AS pb FROM {src}),
mix AS (SELECT *, [0.8 * pa[1] + 0.2 * pb[1], 0.8 * pa[2] + 0.2 * pb[2], 0.8 * pa[3] + 0.2 * pb[3]] AS mx FROM sm),
fu AS (
  SELECT {keys}, label, la, lb, [mx[1] / (mx[1] + mx[2] + mx[3]), mx[2] / (mx[1] + mx[2] + mx[3]),
         mx[3] / (mx[1] + mx[2] + mx[3])] AS fused
  FROM mix
),
pr AS (SELECT *, {_argmax('la')} AS pred_a, {_argmax('lb')} AS pred_b, {_argmax('fused')} AS pred FROM fu)"""


SCORED = f"""emb AS (SELECT vec_id, label % 3 AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sc AS (
  SELECT vec_id, label,
    [{_residue('e', 0, 0, '')}, {_residue('e', 1, 0, '')}, {_residue('e', 2, 0, '')}] AS la,
    [{_residue('e', 0, 1, '-')}, {_residue('e', 1, 1, '-')}, {_residue('e', 2, 1, '-')}] AS lb
  FROM emb
),
{fusion_sql('sc', 'vec_id')}"""


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def i64(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


ORACLE["batch_score"] = with_(SCORED) + f"""SELECT vec_id, {i64('label', 'label')}, {r6('la[1]', 'a0')}, {r6('la[2]', 'a1')},
  {r6('la[3]', 'a2')} FROM sc"""
ORACLE["softmax"] = with_(SCORED) + f"SELECT vec_id, {r6('pa[1]', 'p0')}, {r6('pa[2]', 'p1')}, {r6('pa[3]', 'p2')} FROM sm"
ORACLE["argmax"] = with_(SCORED) + f"SELECT vec_id, {i64(_argmax('la'), 'pred_a')} FROM sc"
ORACLE["align_scores"] = with_(SCORED) + f"SELECT vec_id, {i64('label', 'label')}, {i64('pred_a', 'pred_a')}, {i64('pred_b', 'pred_b')} FROM pr"
ORACLE["fuse_weighted"] = with_(SCORED) + f"""SELECT vec_id, {r6('fused[1]', 'f0')}, {r6('fused[2]', 'f1')}, {r6('fused[3]', 'f2')},
  {i64('pred', 'pred')} FROM pr"""
ORACLE["fuse_vote"] = with_(SCORED) + f"""SELECT vec_id, {i64('pred_a', 'pred_a')}, {i64('pred_b', 'pred_b')},
  CAST(CASE WHEN pred_a = pred_b THEN pred_a WHEN la[pred_a + 1] * 0.6 > 0.4 THEN pred_a ELSE pred_b END AS BIGINT) AS final FROM pr"""
ORACLE["cross_entropy"] = with_(SCORED) + f"""SELECT model, round(avg(ce), 6) AS loss FROM (
  SELECT 'a' AS model, {_ce('la', 'label')} AS ce FROM pr
  UNION ALL SELECT 'b', {_ce('lb', 'label')} FROM pr
  UNION ALL SELECT 'fused', {_ce('fused', 'label')} FROM pr) GROUP BY model"""
FOCAL = f"""fl AS (
  SELECT [0.5, 2.0, 1.0][label + 1] * power(1.0 - exp(-ce), 2.0) * ce AS fl FROM (SELECT label, {_ce('la', 'label')} AS ce FROM sc)
)"""
ORACLE["focal_loss"] = with_(SCORED, FOCAL) + """SELECT 'mean' AS reduction, round(avg(fl), 6) AS loss FROM fl
  UNION ALL SELECT 'sum', round(sum(fl), 6) FROM fl"""
ORACLE["batch_mean_loss"] = with_(SCORED) + f"""SELECT round(avg(m), 6) AS mean_loss, CAST(count(*) AS BIGINT) AS n_batches FROM (
  SELECT pos // 16 AS b, avg(ce) AS m FROM (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, {_ce('fused', 'label')} AS ce FROM pr) GROUP BY 1)"""
ORACLE["accuracy"] = with_(SCORED) + accuracy_sql("pr")
ORACLE["class_report"] = with_(SCORED) + "SELECT * FROM (" + report_sql("pr") + ")"
ORACLE["confusion_matrix"] = with_(SCORED) + confusion_sql("pr")
COMPARE = f"""SELECT model, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(ce), 6) AS loss FROM (
    SELECT 'a' AS model, label, pred_a AS pred, {_ce('la', 'label')} AS ce FROM pr
    UNION ALL SELECT 'b', label, pred_b, {_ce('lb', 'label')} FROM pr
    UNION ALL SELECT 'fused', label, pred, {_ce('fused', 'label')} FROM pr) GROUP BY model"""
ORACLE["model_compare"] = with_(SCORED) + COMPARE
ORACLE["model_compare_epochs"] = with_(SCORED) + f"""SELECT CAST(epoch AS BIGINT) AS epoch, model,
  round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(ce), 6) AS loss FROM (
    SELECT vec_id % 6 AS epoch, 'a' AS model, label, pred_a AS pred, {_ce('la', 'label')} AS ce FROM pr
    UNION ALL SELECT vec_id % 6, 'b', label, pred_b, {_ce('lb', 'label')} FROM pr
    UNION ALL SELECT vec_id % 6, 'fused', label, pred, {_ce('fused', 'label')} FROM pr) GROUP BY epoch, model"""
ORACLE["best_run"] = """WITH runs AS (
  SELECT event_type AS run, event_id % 6 AS epoch, avg(value) / 100.0 AS accuracy FROM events GROUP BY 1, 2
),
b AS (
  SELECT *, coalesce(max(accuracy) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
    AS best_before FROM runs
)
SELECT run, CAST(epoch AS BIGINT) AS epoch, round(accuracy, 6) AS accuracy, round(best_before, 6) AS best_before,
  CAST(accuracy > best_before AS BIGINT) AS improved FROM b"""
ORACLE["best_epoch"] = """WITH runs AS (
  SELECT event_type AS run, event_id % 6 AS epoch, avg(value) / 100.0 AS accuracy FROM events GROUP BY 1, 2
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, epoch) AS rn FROM runs WHERE accuracy > 0)
SELECT run, CAST(epoch AS BIGINT) AS epoch, round(accuracy, 6) AS accuracy FROM ranked WHERE rn = 1"""

# ---------------------------------------------------------------- balancing
BASE = (LINES, LEXICON, LINE_HITS, RAW_TRIPLES, PREPARED, SPLIT)


def phash(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


BOOT = f"""idx AS (
  SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY h, doc_id, line_no) - 1 AS idx
  FROM (SELECT *, {phash("'row|42|' || doc_id || '|' || line_no")} AS h FROM train)
),
counts AS (SELECT sentiment, count(*) AS n FROM train GROUP BY 1),
draws AS (
  SELECT c.sentiment, s.slot, {phash("'42|' || c.sentiment || '|' || s.slot")} % c.n AS pick
  FROM counts c CROSS JOIN (SELECT unnest(range((SELECT max(n) FROM counts))) AS slot) s
),
boot AS (
  SELECT d.sentiment, d.slot, i.doc_id, i.line_no, i.sentence
  FROM draws d JOIN idx i ON i.sentiment = d.sentiment AND i.idx = d.pick
)"""

SYN = f"""bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{WORD}]+')) AS word FROM benchmark),
br AS (
  SELECT word, row_number() OVER w AS rn, lead(word, 1) OVER w AS n1, lead(word, 2) OVER w AS n2
  FROM bw WINDOW w AS (PARTITION BY substr(word, 1, 2) ORDER BY word)
),
syn AS (
  SELECT word, 0 AS set_no, n1 AS lemma FROM br WHERE n1 IS NOT NULL
  UNION ALL SELECT word, 1, n2 FROM br WHERE n2 IS NOT NULL AND rn % 3 = 1
),
sets AS (SELECT word, list(lemma ORDER BY set_no) AS lemmas FROM syn GROUP BY word)"""


def split_ws(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({strip(x)}, '[{WS_CLASS}]+') END"


def replace_sql(name: str, src: str, keys: tuple[str, ...]) -> str:
    k = ", ".join(keys)
    hk = " || '|' || ".join(f"{c}" for c in keys)
    return f"""{name}_ws AS (
  SELECT {k}, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT {k}, {split_ws('sentence')} AS w FROM {src})
),
{name}_rep AS (
  SELECT ws.{", ws.".join(keys)}, ws.pos,
    CASE WHEN s.lemmas IS NULL THEN ws.word
         ELSE s.lemmas[1 + {phash(f"'42|' || {hk} || '|' || ws.pos")} % len(s.lemmas)] END AS w
  FROM {name}_ws ws LEFT JOIN sets s ON s.word = ws.word
),
{name} AS (
  SELECT {", ".join("r." + c for c in keys)}, coalesce(a.txt, '') AS augmented FROM (SELECT DISTINCT {k} FROM {src}) r
  LEFT JOIN (SELECT {k}, string_agg(w, ' ' ORDER BY pos) AS txt FROM {name}_rep GROUP BY ALL) a
  ON {" AND ".join(f"a.{c} = r.{c}" for c in keys)}
)"""


ORACLE["class_counts"] = with_(*BASE) + """SELECT CAST(sentiment AS BIGINT) AS sentiment, CAST(count(*) AS BIGINT) AS n,
  CAST(max(count(*)) OVER () AS BIGINT) AS max_n FROM train GROUP BY sentiment"""
ORACLE["bootstrap_balance"] = with_(*BASE, BOOT) + """SELECT CAST(sentiment AS BIGINT) AS sentiment, CAST(slot AS BIGINT) AS slot,
  doc_id, CAST(line_no AS BIGINT) AS line_no FROM boot"""
ORACLE["synonym_augment"] = with_(*BASE, SYN, replace_sql("aug", "train", ("doc_id", "line_no"))) + """SELECT doc_id,
  CAST(line_no AS BIGINT) AS line_no, augmented FROM aug"""
# Lines split into words once; the numbers are the defaults of operators/synonyms.py.
LEARNED = f"""cx_t AS (SELECT regexp_extract_all(lower(sentence), '[{WORD}]+') AS t FROM lines),
cx_ab AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS p FROM cx_t WHERE len(t) > 1),
cx AS (
  SELECT word, feature, count(*) AS n FROM (
    SELECT p.b AS word, 'l:' || p.a AS feature FROM cx_ab UNION ALL SELECT p.a, 'r:' || p.b FROM cx_ab) GROUP BY 1, 2
),
cx_w AS (SELECT word, sum(n) AS nw FROM cx GROUP BY 1 HAVING sum(n) >= {SY.MIN_COUNT}),
cx_f AS (SELECT feature, sum(n) AS nf FROM cx GROUP BY 1),
wt AS (
  SELECT * FROM (
    SELECT word, feature, CAST(floor(1000.0::DOUBLE * ln(n::DOUBLE * (SELECT sum(n) FROM cx)::DOUBLE / (nw::DOUBLE * nf::DOUBLE))
      * (n::DOUBLE / (n::DOUBLE + 1.0::DOUBLE))) AS BIGINT) AS weight
    FROM cx JOIN cx_w USING (word) JOIN cx_f USING (feature) WHERE n >= {SY.MIN_PAIR}) WHERE weight > 0
),
wt_own AS (SELECT word, CAST(sum(weight) AS BIGINT) AS own FROM wt GROUP BY 1),
wt_kept AS (SELECT * FROM wt QUALIFY row_number() OVER (PARTITION BY feature ORDER BY weight DESC, word) <= {SY.PER_FEATURE}),
sim AS (
  SELECT a, b, s::DOUBLE / (x.own + y.own - s)::DOUBLE AS similarity FROM (
    SELECT l.word AS a, r.word AS b, CAST(sum(least(l.weight, r.weight)) AS BIGINT) AS s
    FROM wt_kept l JOIN wt_kept r ON l.feature = r.feature AND l.word < r.word GROUP BY 1, 2 HAVING count(*) >= {SY.SHARED}) p
  JOIN wt_own x ON x.word = p.a JOIN wt_own y ON y.word = p.b
),
near AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, lemma) AS rank FROM (
    SELECT a AS word, b AS lemma, similarity FROM sim UNION ALL SELECT b, a, similarity FROM sim)
  WHERE similarity >= {SY.LEAST} QUALIFY rank <= {SY.NEIGHBOURS}
),
near_l AS (SELECT word, list(lemma ORDER BY rank) AS lemmas FROM near GROUP BY 1),
seeded AS (
  SELECT n.word, n.rank, list_concat([n.lemma], list_filter(w.lemmas, lambda x: x <> n.lemma AND coalesce(list_contains(v.lemmas, x), false))) AS members
  FROM near n JOIN near_l w ON w.word = n.word LEFT JOIN near_l v ON v.word = n.lemma
),
sense AS (
  SELECT word, members, row_number() OVER (PARTITION BY word ORDER BY rank) - 1 AS set_no FROM (
    SELECT * FROM seeded QUALIFY row_number() OVER (PARTITION BY word, list_sort(members) ORDER BY rank) = 1)
)"""
ORACLE["synonym_learned_sets"] = with_(LINES, LEARNED) + """SELECT word, CAST(set_no AS BIGINT) AS set_no,
  CAST(unnest(range(len(members))) AS BIGINT) AS lemma_no, unnest(members) AS lemma FROM sense"""
LEARNED_FIRST = LEARNED + """,
sets AS (SELECT word, list(members[1] ORDER BY set_no) AS lemmas FROM sense GROUP BY word)"""
ORACLE["synonym_augment_learned"] = with_(*BASE, LEARNED_FIRST, replace_sql("aug", "train", ("doc_id", "line_no"))) + """SELECT doc_id,
  CAST(line_no AS BIGINT) AS line_no, augmented FROM aug"""
NEUTRAL = f"""neutral AS (SELECT slot, doc_id, line_no, sentence FROM boot WHERE sentiment = 1),
{replace_sql("naug", "neutral", ("slot", "doc_id", "line_no"))},
aug_neutral AS (
  SELECT slot, 0 AS copy, doc_id, line_no, sentence FROM neutral
  UNION ALL SELECT slot, 1, doc_id, line_no, augmented FROM naug
),
balanced AS (
  SELECT sentiment, slot, 0 AS copy, doc_id, line_no, sentence FROM boot WHERE sentiment <> 1
  UNION ALL SELECT 1, slot, copy, doc_id, line_no, sentence FROM aug_neutral
)"""
ORACLE["augment_neutral"] = with_(*BASE, BOOT, SYN, NEUTRAL) + """SELECT CAST(slot AS BIGINT) AS slot, CAST(copy AS BIGINT) AS copy,
  doc_id, CAST(line_no AS BIGINT) AS line_no, sentence FROM aug_neutral"""
ORACLE["balanced_union"] = with_(*BASE, BOOT, SYN, NEUTRAL) + """SELECT CAST(sentiment AS BIGINT) AS sentiment, CAST(slot AS BIGINT) AS slot,
  CAST(copy AS BIGINT) AS copy, doc_id, CAST(line_no AS BIGINT) AS line_no, sentence FROM balanced"""
ORACLE["shuffle_rows"] = with_(*BASE, BOOT, SYN, NEUTRAL) + f"""SELECT CAST(row_number() OVER (ORDER BY h, sentiment, slot, copy) - 1 AS BIGINT) AS row_index,
  CAST(sentiment AS BIGINT) AS sentiment, CAST(slot AS BIGINT) AS slot, CAST(copy AS BIGINT) AS copy FROM (
  SELECT *, {phash("'shuffle|42|' || sentiment || '|' || slot || '|' || copy")} AS h FROM balanced)"""

# ---------------------------------------------------------------- combined run
DRAW = ("drawn", "slot", "copy")
FMT = q(D.PROMPT_EN.replace("%s", "{}"))


def _three(px: str) -> str:
    return ", ".join(f"max({px}.score) FILTER (WHERE {px}.cls = {c})" for c in range(3))


COMBINED = with_(
    *BASE, BOOT, SYN, NEUTRAL,
    "drawn_rows AS (SELECT sentiment AS drawn, slot, copy, sentiment, sentence FROM balanced)",
    nb_fit("c", "drawn_rows", "sentence", 1, 1, 0.1, DRAW),
    f"train_p AS (SELECT *, format({FMT}, aspect, sentence) AS prompt FROM train)",
    nb_fit("pa", "train_p", "prompt", 1, 1, 0.1),
    f"test_p AS (SELECT *, format({FMT}, aspect, sentence) AS prompt FROM test)",
    nb_score("pa", "ta", "test_p", "prompt", 1, 1),
    nb_score("c", "tb", "test", "sentence", 1, 1),
    f"""wide AS (
  SELECT t.doc_id, t.line_no, t.sentiment AS label, [{_three('a')}] AS la, [{_three('b')}] AS lb
  FROM test t JOIN ta_s a ON a.doc_id = t.doc_id AND a.line_no = t.line_no
  JOIN tb_s b ON b.doc_id = t.doc_id AND b.line_no = t.line_no AND b.cls = a.cls
  GROUP BY t.doc_id, t.line_no, t.sentiment
)""",
    fusion_sql("wide", "doc_id, line_no"),
)
ORACLE["combined_scores"] = COMBINED + f"""SELECT doc_id, {i64('line_no', 'line_no')}, {i64('label', 'label')}, {i64('pred_a', 'pred_a')},
  {i64('pred_b', 'pred_b')}, {i64('pred', 'pred')}, {r6('fused[1]', 'f0')}, {r6('fused[2]', 'f1')}, {r6('fused[3]', 'f2')} FROM pr"""
ORACLE["combined_eval"] = COMBINED + COMPARE
ORACLE["combined_report"] = COMBINED + "SELECT * FROM (" + report_sql("pr") + ")"
ORACLE["combined_confusion"] = COMBINED + confusion_sql("pr")

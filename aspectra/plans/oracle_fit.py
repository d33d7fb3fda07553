"""Oracle SQL for the focal-loss classifier: every epoch is a few CTEs, one step after another."""

from __future__ import annotations

from aspectra.operators import focal as FO
from aspectra.plans import tables as D
from aspectra.plans.oracle import ORACLE, q, with_
from aspectra.plans.oracle_model import BASE, BAYES, TEST_SCORE, _int, grams_cte, nb_fit, nb_proba_fix
from aspectra.plans.queries_eval import FUSE_WEIGHTS
from aspectra.plans.queries_fit import BIAS, RUNS

FMT = q(D.PROMPT_EN.replace("%s", "{}"))
KEYS = ("doc_id", "line_no")

# Features of all prepared rows, with the training rows' vocabulary; the bias is one more term.
DATA = f"""all_p AS (SELECT *, format({FMT}, aspect, sentence) AS prompt FROM prepared),
train_p AS (SELECT * FROM all_p WHERE doc_id % {D.TEST_FOLD} <> 0),
{nb_fit("pa", "train_p", "prompt", 1, 1, 0.1)},
{grams_cte("ff", "all_p", "prompt", 1, 1, KEYS, KEYS)},
ff_tf AS (SELECT doc_id, line_no, term, count(*) AS tf FROM ff_grams GROUP BY ALL),
ff_x AS MATERIALIZED (
  SELECT doc_id, line_no, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, line_no)) AS x
  FROM (SELECT f.*, v.idx, f.tf * v.idf AS w FROM ff_tf f JOIN pa_vocab v USING (term))
  UNION ALL SELECT doc_id, line_no, (SELECT count(*) FROM pa_vocab), 1.0 FROM all_p
),
ff_rows AS MATERIALIZED (SELECT doc_id, line_no, sentiment AS label, doc_id % {D.TEST_FOLD} <> 0 AS train FROM all_p),
ff_n AS (SELECT count(*) AS n FROM ff_rows WHERE train),
w_0 AS (SELECT range AS idx, {", ".join(f"0.0::DOUBLE AS {c}{j}" for c in "wmv" for j in range(3))} FROM range((SELECT count(*) + 1 FROM pa_vocab)))"""


def _of_label(values) -> str:
    return "CASE label " + " ".join(f"WHEN {j} THEN {v}" for j, v in enumerate(values)) + " END"


def scores(px: str, k: int, s: FO.Settings) -> str:
    """``{px}z_k``: every row's scores at the weights after k steps; ``{px}p_k``: with probabilities, loss and slope."""
    return f"""{px}z_{k} AS MATERIALIZED (
  SELECT r.*, {", ".join(f"z{j}" for j in range(3))}, greatest(z0, z1, z2) AS zm FROM ff_rows r JOIN (
    SELECT doc_id, line_no, {", ".join(f"sum(x * w{j}) AS z{j}" for j in range(3))} FROM ff_x JOIN {px}w_{k} USING (idx) GROUP BY ALL) USING (doc_id, line_no)
),
{px}p_{k} AS MATERIALIZED (
  SELECT *, -a * pow(1 - pt, {s.gamma}) * l AS loss, a * ({s.gamma} * pow(1 - pt, {s.gamma - 1}) * pt * l - pow(1 - pt, {s.gamma})) AS slope,
         CASE WHEN z0 = zm THEN 0 WHEN z1 = zm THEN 1 ELSE 2 END AS pred
  FROM (SELECT *, {_of_label([f"p{j}" for j in range(3)])} AS pt, {_of_label([f"z{j}" for j in range(3)])} - zm - ln(e) AS l, {_of_label(map(float, s.alpha))} AS a
    FROM (SELECT *, {", ".join(f"exp(z{j} - zm) / e AS p{j}" for j in range(3))} FROM (SELECT *, exp(z0 - zm) + exp(z1 - zm) + exp(z2 - zm) AS e FROM {px}z_{k})))
)"""


def step(px: str, k: int, s: FO.Settings) -> str:
    """``{px}w_{k+1}`` from the gradient at ``{px}w_k``."""
    t = k + 1
    grads = ", ".join(f"sum(slope * ((label = {j})::INT - p{j}) * x) AS g{j}" for j in range(3))
    moved = []
    for j in range(3):
        m, v = f"({FO.BETA1} * m{j} + {1 - FO.BETA1} * (g{j} / n))", f"({FO.BETA2} * v{j} + {1 - FO.BETA2} * (g{j} / n) * (g{j} / n))"
        moved += [f"{m} AS m{j}", f"{v} AS v{j}"]
        moved.append(f"w{j} * {1 - s.rate * s.decay} - {s.rate} * (({m} / {1 - FO.BETA1**t}) / (sqrt({v} / {1 - FO.BETA2**t}) + {FO.EPSILON})) AS w{j}")
    return f"""{scores(px, k, s)},
{px}g_{k} AS (SELECT idx, {grads} FROM ff_x JOIN {px}p_{k} USING (doc_id, line_no) WHERE train GROUP BY idx),
{px}w_{t} AS MATERIALIZED (
  SELECT idx, {", ".join(moved)} FROM (SELECT w.*, {", ".join(f"coalesce(g{j}, 0) AS g{j}" for j in range(3))} FROM {px}w_{k} w LEFT JOIN {px}g_{k} USING (idx)), ff_n
)"""


def epochs(px: str, s: FO.Settings) -> tuple[str, ...]:
    return (f"{px}w_0 AS (SELECT * FROM w_0)", *[step(px, k, s) for k in range(FO.EPOCHS)], scores(px, FO.EPOCHS, s))


PREFIX = {run: f"r{i}" for i, run in enumerate(RUNS)}
FIRST = next(iter(RUNS))
BOTH = tuple(c for run, s in RUNS.items() for c in epochs(PREFIX[run], s))
EPOCH_ROWS = "fitted AS (" + " UNION ALL ".join(
    f"""SELECT {q(run)} AS run, {k} AS epoch, avg(loss) FILTER (train) AS train_loss, avg(loss) FILTER (NOT train) AS loss,
  avg((pred = label)::INT) FILTER (NOT train) AS accuracy FROM {PREFIX[run]}p_{k}"""
    for run in RUNS for k in range(1, FO.EPOCHS + 1)
) + ")"

ORACLE["focal_step"] = with_(*BASE, DATA, "r0w_0 AS (SELECT * FROM w_0)", step("r0", 0, RUNS[FIRST])) + "\nUNION ALL ".join(
    f"""SELECT coalesce(term, {q(BIAS)}) AS term, CAST({j} AS BIGINT) AS cls, round(g{j}, 6) AS gradient, round(w{j}, 6) AS weight
FROM r0w_1 JOIN r0g_0 USING (idx) LEFT JOIN pa_vocab USING (idx)""" for j in range(3)
)
ORACLE["focal_runs"] = with_(*BASE, DATA, *BOTH, EPOCH_ROWS) + f"""SELECT run, {_int('epoch')}, round(train_loss, 6) AS train_loss,
  round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM fitted"""
ORACLE["fit_best_run"] = with_(*BASE, DATA, *BOTH, EPOCH_ROWS) + f"""SELECT run, {_int('epoch')}, round(accuracy, 6) AS accuracy,
  round(before, 6) AS best_before, CAST(accuracy > before AS BIGINT) AS improved FROM (
    SELECT *, coalesce(max(accuracy) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fitted)"""
ORACLE["fit_best_epoch"] = with_(*BASE, DATA, *BOTH, EPOCH_ROWS) + f"""SELECT run, {_int('epoch')}, round(accuracy, 6) AS accuracy FROM fitted
WHERE accuracy > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, epoch) = 1"""

LAST = f"""best AS (
  SELECT epoch FROM (SELECT * FROM fitted WHERE run = {q(FIRST)}) ORDER BY accuracy DESC, epoch LIMIT 1
)"""
ONE = epochs(PREFIX[FIRST], RUNS[FIRST])
ONE_ROWS = "fitted AS (" + " UNION ALL ".join(
    f"SELECT {q(FIRST)} AS run, {k} AS epoch, avg((pred = label)::INT) FILTER (NOT train) AS accuracy FROM r0p_{k}" for k in range(1, FO.EPOCHS + 1)
) + ")"
EVERY = "scored AS (" + " UNION ALL ".join(f"SELECT *, {k} AS epoch FROM r0p_{k} WHERE NOT train" for k in range(1, FO.EPOCHS + 1)) + ")"
ORACLE["focal_predict"] = with_(*BASE, DATA, *ONE, ONE_ROWS, LAST, EVERY) + f"""SELECT doc_id, {_int('line_no')}, {_int('label')}, {_int('pred')},
  round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM scored WHERE epoch = (SELECT epoch FROM best)"""

A, B = FUSE_WEIGHTS


def _ce(s: str) -> str:
    top = f"greatest({s}0, {s}1, {s}2)"
    return f"{top} + ln(exp({s}0 - {top}) + exp({s}1 - {top}) + exp({s}2 - {top})) - ({_of_label([f'{s}{j}' for j in range(3)])})"


def _first(s: str) -> str:
    return f"CASE WHEN {s}0 >= {s}1 AND {s}0 >= {s}2 THEN 0 WHEN {s}1 >= {s}2 THEN 1 ELSE 2 END"


COMPARED = (
    nb_proba_fix("bt"),
    f"""nb AS (
  SELECT doc_id, line_no, {", ".join(f"max(score) FILTER (cls = {j}) AS b{j}" for j in range(3))}, {", ".join(f"max(p) FILTER (cls = {j}) AS q{j}" for j in range(3))}
  FROM bt_s JOIN bt_prob USING (doc_id, line_no, cls) GROUP BY doc_id, line_no
)""",
    EVERY,
    f"""fused AS (SELECT *, {", ".join(f"({A} * p{j} + {B} * q{j}) / ({A} * (p0 + p1 + p2) + {B} * (q0 + q1 + q2)) AS f{j}" for j in range(3))} FROM scored JOIN nb USING (doc_id, line_no))""",
)
ORACLE["fit_compare_epochs"] = with_(*BASE, BAYES, TEST_SCORE, DATA, *ONE, *COMPARED) + " UNION ALL ".join(
    f"""SELECT CAST(epoch AS BIGINT) AS epoch, {q(name)} AS model, round(avg(({_first(s)} = label)::INT), 6) AS accuracy, round(avg({_ce(s)}), 6) AS loss
FROM fused GROUP BY epoch""" for name, s in (("a", "z"), ("b", "b"), ("fused", "f"))
)
ORACLE["model_store_predict"] = ORACLE["nb_predict"]

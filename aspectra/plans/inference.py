"""Inference compositions.

infer_aspects (one row per clause with an aspect):
    gate + sequential split -> whole-word lexicon hits -> longest hit ->
    prompt -> model A (prompt model, class probabilities as its scores) and
    model B (Bayes on the clause) -> two-model vote -> title-case label.

infer_all_hits (notebook variant, one row per line and hit):
    every case-sensitive substring hit -> prompt of (hit, whole line) ->
    model A -> argmax -> lower-case label; aspect_map folds them per line.

Either model may be a ``TextBayes`` or the user's own classifier, a ``UserScorer``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.functions import vectors as V
from aspectra.functions.sizes import row_bytes
from aspectra.functions.text import vectorizer_tokens
from aspectra.operators import bayes as B
from aspectra.operators import clauses as C
from aspectra.operators import features as FE
from aspectra.operators import match as M
from aspectra.operators import prepare as P
from aspectra.operators import prompt_hits as PH
from aspectra.plans.training import TextBayes
from aspectra.session import checkpoint

CKEYS = ["doc_id", "line_no", "clause_no"]
# Vote thresholds of the two-model rule.
VOTE_WEIGHT, VOTE_THRESHOLD = 0.6, 0.4


@dataclass
class UserScorer:
    """The user's own classifier. ``score`` turns a text column into ARRAY<DOUBLE> raw scores, one per
    class, for example by ``scoring.batch_score``; the vote holds them against its threshold as they are."""

    classes: Sequence[int]
    score: Callable[[Column], Column]
    text: str = "text"

    def vote_scores(self, scores: Column) -> Column:
        return scores

    def scores(self, rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
        return rows.select(*keys, *carry, self.score(F.col(self.text)).alias("scores"))


Model = TextBayes | UserScorer


def predicted(model: Model, scores: Column) -> Column:
    return V.element(F.array(*[F.lit(c) for c in model.classes]), V.argmax(scores))


def main_aspects(clauses: DataFrame, lexicon: DataFrame, keys: Sequence[str] = CKEYS) -> DataFrame:
    return M.main_word(clauses, "clause", keys, lexicon, carry=["clause"])


def infer_aspects(
    clauses: DataFrame,
    lexicon: DataFrame,
    model_a: Model,
    model_b: Model,
    prompt: str = C.PROMPT,
    keys: Sequence[str] = CKEYS,
) -> DataFrame:
    """keys + (aspect, pred_a, pred_b, final, sentiment) for every clause with an aspect."""
    k = list(keys)
    main = main_aspects(clauses, lexicon, k).withColumn("prompt", C.aspect_prompt(F.col("aspect"), F.col("clause"), prompt))
    if all(isinstance(m, UserScorer) or m.local() for m in (model_a, model_b)):
        # One row for each key: both models score it where it is.
        both = main.select(*k, "aspect", row_scores(model_a, F.col("prompt")).alias("_a"), row_scores(model_b, F.col("clause")).alias("_b"))
        both = both.select(*k, "aspect", model_a.vote_scores(F.col("_a")).alias("own_a"), predicted(model_b, F.col("_b")).alias("pred_b"))
        both = both.withColumn("at_a", V.argmax(F.col("own_a"))).withColumn("pred_a", predicted(model_a, F.col("own_a")))
        return _voted(both, k)
    # Both models read the clause-level aspects: compute them once (checkpoint in
    # the shared folder) instead of matching every clause twice.
    main = checkpoint(main)
    a = model_a.scores(main.select(*k, F.col("prompt").alias(model_a.text), "aspect"), k, carry=["aspect"])
    a = a.select(*k, "aspect", model_a.vote_scores(F.col("scores")).alias("own_a"))
    a = a.withColumn("at_a", V.argmax(F.col("own_a"))).withColumn("pred_a", predicted(model_a, F.col("own_a")))
    b = model_b.scores(main.select(*k, F.col("clause").alias(model_b.text)), k)
    b = b.select(*k, predicted(model_b, F.col("scores")).alias("pred_b"))
    return _voted(a.join(b, k), k)


def row_scores(model: Model, text: Column) -> Column:
    return model.score(text) if isinstance(model, UserScorer) else model.row_scores(text)


def _voted(both: DataFrame, k: list[str]) -> DataFrame:
    final = V.fuse_vote(F.col("pred_a"), F.col("own_a"), F.col("pred_b"), VOTE_WEIGHT, VOTE_THRESHOLD, F.col("at_a"))
    return both.select(*k, "aspect", "pred_a", "pred_b", final.alias("final")).withColumn(
        "sentiment", P.decode_label_title(F.col("final"))
    )


def infer_all_hits(
    lines: DataFrame,
    lexicon_set: DataFrame,
    model_a: Model,
    text: str = "sentence",
    prompt: str = C.PROMPT,
    keys: Sequence[str] = ("doc_id", "line_no"),
) -> DataFrame:
    """keys + (aspect, pred, label): every substring hit scored on its own prompt."""
    k = list(keys)
    pk = [*k, "aspect"]
    held = _hits_in_rows(lines, lexicon_set, model_a, text, prompt, k)
    if held is not None:
        each = held.select(*k, F.inline("hits"))
        return each.select(*pk, V.element(_of_classes(model_a, F.lit), F.col("at")).alias("pred")).withColumn("label", P.decode_label(F.col("pred")))
    if isinstance(model_a, TextBayes) and _shared_text_prompt(model_a, prompt):
        # The prompt is head(aspect) ++ line: a head for each phrase, the line scored once, and each hit puts them together.
        hits = M.match_substring(lines, text, k, lexicon_set).withColumnRenamed("keyword", "aspect")
        heads = lexicon_set.select(F.col("keyword").alias("aspect"), C.aspect_prompt(F.col("keyword"), F.lit(""), prompt).alias("_head"))
        scored = B.joint_log_likelihood_by_head(
            model_a.model, model_a.vocab, hits, heads, "aspect", "_head", lines.select(*k, text), text, k, FE.MAX_FEATURES
        )
    else:
        hits = M.match_substring(lines, text, k, lexicon_set, carry=[text])
        rows = hits.select(
            *k, F.col("keyword").alias("aspect"), C.aspect_prompt(F.col("keyword"), F.col(text), prompt).alias(model_a.text)
        )
        scored = model_a.scores(rows, pk)
    return scored.select(*pk, predicted(model_a, F.col("scores")).alias("pred")).withColumn("label", P.decode_label(F.col("pred")))


def all_hits_maps(
    lines: DataFrame,
    lexicon_set: DataFrame,
    model_a: Model,
    text: str = "sentence",
    prompt: str = C.PROMPT,
    keys: Sequence[str] = ("doc_id", "line_no"),
) -> DataFrame:
    """keys + MAP<aspect, label> of the rows of ``infer_all_hits``."""
    k = list(keys)
    held = _hits_in_rows(lines, lexicon_set, model_a, text, prompt, k)
    if held is None:
        return M.aspect_map(infer_all_hits(lines, lexicon_set, model_a, text, prompt, k), k, "aspect", "label")
    labels = _of_classes(model_a, lambda c: P.decode_label(F.lit(c)))
    entries = F.transform("hits", lambda h: F.struct(h["aspect"].alias("aspect"), V.element(labels, h["at"]).alias("label")))
    return M.aspect_map(held.select(*k, entries.alias("hits")), k, held="hits")


def _hits_in_rows(lines: DataFrame, lexicon_set: DataFrame, model_a: Model, text: str, prompt: str, k: list[str]) -> DataFrame | None:
    """keys + hits ARRAY<STRUCT<aspect, at>>, ``at`` the place of the predicted class, one row for each value of the keys; None
    where the prompt is no head before the text, or lexicon or vocabulary are too large to go to the tasks."""
    if not (isinstance(model_a, TextBayes) and _shared_text_prompt(model_a, prompt) and model_a.local()):
        return None
    phrases = lexicon_set.select("keyword")
    size = phrases.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(phrases)).alias("b")).first()
    if size["n"] > M.BROADCAST_LEXICON_ROWS or (size["b"] or 0) > M.BROADCAST_LEXICON_BYTES:
        return None
    tokens = vectorizer_tokens(C.aspect_prompt(F.col("keyword"), F.lit(""), prompt))
    heads = sorted(((r["keyword"], r["t"]) for r in phrases.select("keyword", tokens.alias("t")).collect()), key=lambda h: h[0].encode())
    terms, idf, logs = model_a.tables()
    return PH.best_class(lines.select(*k, text), text, k, [p for p, _ in heads], [t for _, t in heads], terms, idf, logs, model_a.model.log_priors())


def _of_classes(model: Model, value: Callable[[int], Column]) -> Column:
    return F.array(*[value(c) for c in model.classes])


def _shared_text_prompt(model: TextBayes, prompt: str) -> bool:
    """True when the prompt is a head ending in a non-word character followed by
    the text, and the model uses 1-grams: then prompt counts are head + text."""
    if not (model.lo == model.hi == 1 and prompt.endswith("%s") and prompt.count("%s") == 2):
        return False
    before = prompt[:-2][-1:] if len(prompt) > 2 else ""
    return bool(before) and not (before.isalnum() or before == "_")


def render_map(m: F.Column) -> F.Column:
    """'k=v;k=v' text of a map, in its entry order (for comparison and display)."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")

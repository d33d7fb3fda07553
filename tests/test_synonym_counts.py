"""Adjacent pairs with the totals of their words against counts of every context; replacement without a shuffle of words."""

import random
from collections import Counter

import pytest

from aspectra.operators import balance as BL
from aspectra.operators import row_terms as RT
from aspectra.operators import synonyms as SY
from tests.conftest import rows

SCHEMA = "doc_id long, text string"


def texts():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["\u00c0b", "Ab"]
    found = [" ".join(rnd.choices(words, weights=range(1, len(words) + 1), k=rnd.randint(0, 25))) for _ in range(120)]
    return found + found[:10] + [None, "", "alone", ".,"]


@pytest.mark.parametrize("slice_tokens", [7, 200_000])
def test_weights_of_pairs_equal_those_of_contexts(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(RT, "SLICE_TOKENS", slice_tokens)
    df = spark.createDataFrame(list(enumerate(texts())), SCHEMA).repartition(3)
    want = Counter()
    for t in texts():
        t = ((t or "").lower()).split() if t != ".," else []
        for a, b in zip(t, t[1:]):
            want.update([(b, "l:" + a), (a, "r:" + b)])
    counts = SY.contexts(df, "text")
    assert rows(counts) == sorted((w, f, n) for (w, f), n in want.items())
    for least, pair in ((5, 2), (1, 1), (60, 3)):
        got = rows(SY.pair_weights(SY.adjacent(df, "text", pair), least, pair))
        assert got == rows(SY.weights(counts, least, pair)) and got
    none = spark.createDataFrame([], SCHEMA)
    assert rows(SY.pair_weights(SY.adjacent(none, "text"))) == []


def test_rare_pairs_are_counted_and_dropped(spark):
    df = spark.createDataFrame([(0, "a b a b c")], SCHEMA)
    got = {(r["first"], r["second"]): r["n"] for r in SY.adjacent(df, "text", 2).collect()}
    assert got == {("a", "b"): 2, ("a", None): 2, ("b", None): 2, (None, "a"): 1, (None, "b"): 2, (None, "c"): 1}


def test_replacement_groups_texts_that_share_keys_and_shuffles_no_word(spark):
    sets = spark.createDataFrame([("cheap", 0, "costly")], "word string, set_no int, lemma string")
    df = spark.createDataFrame([(1, "a cheap meal"), (2, ""), (3, None), (1, "b"), (None, "cheap"), (None, " ")], SCHEMA)
    out = BL.synonym_replace(df, "text", ["doc_id"], sets)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Union" not in plan
    got = {r["doc_id"]: r["augmented"] for r in out.collect()}
    assert got == {1: "a b costly meal", 2: "", 3: "", None: "costly"} and out.count() == 4

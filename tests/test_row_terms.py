"""Terms and phrases of single rows against the joins that put rows of the same key together."""

import pytest
from pyspark.sql import functions as F

from aspectra.operators import features as FE
from aspectra.operators import match as M
from aspectra.operators import row_terms as RT
from aspectra.plans import inference as INF
from aspectra.plans import queries_infer as QI
from aspectra.plans import tables as D
from aspectra.plans import training as TR

TEXTS = ["good food good view", "Bad food, bad Bad view", "", None, "x y z", "good food", "view of the good food and the view", "nothing known here"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, 0, t, i % 3) for i, t in enumerate(TEXTS * 5)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, sentence string, sentiment int").repartition(4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("slice_tokens", [3, 200_000])
def test_vocabulary_counts(texts, monkeypatch, slice_tokens):
    monkeypatch.setattr(RT, "SLICE_TOKENS", slice_tokens)
    tf = FE.term_counts(texts, "sentence", TR.KEYS, 1, 4)
    want = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    assert {tuple(r) for r in RT.term_stats(texts, "sentence", 1, 4).collect()} == {tuple(r) for r in want.collect()}


def test_scores_and_weights_of_rows(texts):
    model = TR.TextBayes("sentence", 1, 4, 1.0).fit(texts)
    want = {r["doc_id"]: r["scores"] for r in model.scores(texts).collect()}
    scored = model.scores(texts, single=True, carry=["sentiment"])
    got = {r["doc_id"]: r["scores"] for r in scored.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # Neither n-grams nor texts are shuffled for scores.
    assert "Exchange" not in plan_of(model.scores(texts.sparkSession.createDataFrame(texts.collect(), texts.schema), single=True))
    plain = lambda df: {(r["doc_id"], r["term"]): r["weight"] for r in df.collect()}
    assert plain(model.weights(texts, single=True)) == pytest.approx(plain(model.weights(texts)))


def test_main_word_is_the_longest_hit(spark):
    words = ["food", "good food", "!", "", "a-b", "view of", "x!", "é", "food and the"]
    lex = M.lexicon_ranked(spark.createDataFrame([(w,) for w in words], "value string"))
    rows = [(i // 2, s) for i, s in enumerate([*TEXTS, "wow! x!", "a-b", "caf\u00e9 \u00e9", "!", "a\u0001food\u0001", "goodfood", "..", "x"])]
    df = spark.createDataFrame(rows, "row int, s string")  # two rows share a key
    want = M.main_aspect(M.match_word(df, "s", ["row"], lex), ["row"])
    assert sorted(map(tuple, M.main_word(df, "s", ["row"], lex).collect())) == sorted(map(tuple, want.collect()))
    none = M.lexicon_ranked(spark.createDataFrame([], "value string"))
    assert M.main_word(df, "s", ["row"], none).collect() == []


def test_inference_scores_clauses_without_a_join(spark, texts):
    model = TR.TextBayes("sentence", 1, 1, 1.0).fit(texts)
    lex = M.lexicon_ranked(spark.createDataFrame([("food",), ("view",)], "value string"))
    clauses = D.doc_clauses(texts.select("doc_id", F.col("sentence").alias("text")))
    joined = TR.TextBayes("sentence", 1, 1, 1.0, model.vocab, model.model)
    joined.local = lambda: False
    for a in (model, QI.user_scorer()):
        got = INF.infer_aspects(clauses, lex, a, model, D.PROMPT_EN)
        assert "SortMergeJoin" not in plan_of(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, INF.infer_aspects(clauses, lex, joined if a is model else a, joined, D.PROMPT_EN).collect()))

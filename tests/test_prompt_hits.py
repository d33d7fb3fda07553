"""Hits scored text by text against the joins, also for keys that repeat or are null."""

import pytest
from pyspark.sql import functions as F

from aspectra.operators import match as M
from aspectra.plans import inference as INF
from aspectra.plans import tables as D
from aspectra.plans import training as TR
from tests.conftest import rows

TRAIN = ["good food good view", "bad food, bad view", "plain view about aspect food", "good view", "bad food", "plain room"]
LINES = [(1, 0, "good food and a bad view"), (1, 1, "Good"), (2, 0, "bad bad bad food"), (3, 0, ""), (4, 0, None), (5, 0, "zzz"),
         (6, 0, "plain room, about the view"), (7, 0, "good food"), (None, 0, "bad food bad"), (8, 0, "café \U0001f600 food")]


@pytest.fixture(scope="module")
def model(spark):
    train = spark.createDataFrame([(i, 0, t, "food", i % 3) for i, t in enumerate(TRAIN * 3)], "doc_id long, line_no int, sentence string, aspect string, sentiment int")
    return TR.prompt_model(train)


def by_joins(monkeypatch, infer, *args):
    with monkeypatch.context() as m:
        m.setattr(INF, "_hits_in_rows", lambda *a: None)
        return infer(*args)


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("words", [["food", "good", "oo", "view", "bad food", "café", "\U0001f600", "about"], ["food", "", "d"], []])
def test_hits_equal_the_joins(spark, monkeypatch, model, words, twice):
    lex = M.lexicon_set(spark.createDataFrame([(w,) for w in words], "value string"))
    data = LINES + ([(1, 0, "bad view"), (2, 0, "bad bad bad food")] if twice else [])
    lines = spark.createDataFrame(data, "doc_id long, line_no int, sentence string")
    args = (lines, lex, model, "sentence", D.PROMPT_EN)
    got = INF.infer_all_hits(*args)
    want = by_joins(monkeypatch, INF.infer_all_hits, *args)
    assert got.dtypes == want.dtypes
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_maps_equal_the_joins_and_hits_are_not_shuffled(spark, monkeypatch, model):
    lex = M.lexicon_set(spark.createDataFrame([("food",), ("good",), ("oo",), ("view",), ("\U0001f600",), ("￮",)], "value string"))
    lines = spark.createDataFrame(LINES, "doc_id long, line_no int, sentence string").where("doc_id is not null")
    args = (lines, lex, model, "sentence", D.PROMPT_EN)
    got, want = INF.all_hits_maps(*args), by_joins(monkeypatch, INF.all_hits_maps, *args)
    render = lambda df: rows(df.select("doc_id", "line_no", INF.render_map(F.col("aspect_map")).alias("m")))
    assert render(got) == render(want) and len(render(got)) == 6
    for df in (got, INF.infer_all_hits(*args)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The lines are shuffled once; neither hits nor terms are.
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan

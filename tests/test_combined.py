"""The combined run's parts: models on drawn rows, a saved model that scores, the kept epoch, plan-only spreading."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aspectra.operators import metrics as ME
from aspectra.plans import training as TR
from aspectra.session import scratch_path, spread
from tests.conftest import SF001

DRAWN = [
    # sentiment, slot, copy, sentence; the first two are the same row drawn twice
    (0, 0, 0, "slow dull screen"), (0, 1, 0, "slow dull screen"), (1, 0, 0, "plain case"), (1, 0, 1, "simple case"),
    (1, 1, 0, ""), (2, 0, 0, "great bright screen"), (2, 1, 0, "great sound"),
]


@pytest.fixture(scope="module")
def balanced(spark):
    return spark.createDataFrame(DRAWN, "sentiment int, slot bigint, copy int, sentence string")


def test_a_row_drawn_twice_counts_twice(spark, balanced):
    model = TR.balanced_bayes(balanced)
    df = {r["term"]: (r["total"], r["df"]) for r in model.vocab.collect()}
    assert df["slow"] == (2, 2) and df["screen"] == (3, 3) and df["great"] == (2, 2)
    assert {r["cls"]: r["n"] for r in model.model.prior.collect()} == {0: 2, 1: 3, 2: 2}


def test_loaded_model_scores_like_the_fitted_one(spark, balanced):
    model = TR.balanced_bayes(balanced)
    path = scratch_path(spark, "test-bayes")
    model.save(path)
    loaded = TR.TextBayes.load(spark, path)
    rows = spark.createDataFrame([(1, 0, "great screen"), (2, 0, ""), (3, 1, "unseen words")], "doc_id bigint, line_no int, sentence string")
    want, got = ({r["doc_id"]: r["scores"] for r in m.scores(rows, TR.KEYS).collect()} for m in (model, loaded))
    assert got.keys() == {1, 2, 3}
    for k, scores in want.items():
        assert got[k] == pytest.approx(scores)


def test_best_epoch_is_the_first_highest(spark):
    runs = spark.createDataFrame(
        [("a", 0, 0.5), ("a", 1, 0.7), ("a", 2, 0.7), ("b", 0, 0.0), ("c", 3, 0.1), ("c", 4, None)], "run string, epoch int, accuracy double"
    )
    assert {tuple(r) for r in ME.best_epoch(runs).collect()} == {("a", 1, 0.7), ("c", 3, 0.1)}


def test_spread_runs_nothing(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    joined = docs.join(docs.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread-test", "spread")
    try:
        spread(joined, "doc_id")
        assert not tracker.getJobIdsForGroup("spread-test")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

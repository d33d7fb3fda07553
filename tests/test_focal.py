"""The focal-loss fit against NumPy, its plan, its restart, and the model store."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.operators import focal as FO
from aspectra.sources.model_store import COMMITTED, ModelStore

N, TERMS = 60, 7


def texts():
    rnd = random.Random(4)
    return [(i, rnd.randrange(3), i % 4 > 0, {t: rnd.random() for t in rnd.sample(range(TERMS), rnd.randint(0, 4))}) for i in range(N)]


def table(spark, rows):
    data = [(i, y, train, [(t, x) for t, x in xs.items()] + [(TERMS, 1.0)]) for i, y, train, xs in rows]
    return spark.createDataFrame(data, "row long, label int, train boolean, terms array<struct<idx:int,x:double>>").repartition(4)


def numpy_loss(w, x, y, s):
    z = x @ w
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    pt = p[np.arange(len(y)), y]
    return np.array(s.alpha)[y] * (1 - pt) ** s.gamma * -np.log(pt), z


def numpy_fit(rows, s, epochs):
    """The same fit with slopes by differences of the loss: nothing of the derivative is shared."""
    x = np.zeros((N, TERMS + 1))
    for k, (_, _, _, xs) in enumerate(rows):
        x[k, TERMS] = 1.0
        for t, v in xs.items():
            x[k, t] = v
    y, train = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.zeros((TERMS + 1, 3))
    m, v, history = np.zeros_like(w), np.zeros_like(w), []
    for t in range(1, epochs + 1):
        slope = np.zeros_like(w)
        for i in np.ndindex(*w.shape):
            d = np.zeros_like(w)
            d[i] = 1e-5
            slope[i] = (numpy_loss(w + d, x, y, s)[0][train].mean() - numpy_loss(w - d, x, y, s)[0][train].mean()) / 2e-5
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w * (1 - s.rate * s.decay) - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        loss, z = numpy_loss(w, x, y, s)
        history.append((t, loss[train].mean(), loss[~train].mean(), (z.argmax(1) == y)[~train].mean()))
    return w, history


@pytest.mark.parametrize("gamma", [0.0, 0.5, 2.0, 2.5])
def test_fit_equals_numpy(spark, gamma):
    rows, s = texts(), FO.Settings(gamma=gamma)
    got = FO.fit(table(spark, rows), TERMS, 3, s, 4)
    w, history = numpy_fit(rows, s, 4)
    assert np.abs(got.state.weights - w).max() < 1e-5
    assert np.allclose([(h["epoch"], h["train_loss"], h["loss"], h["accuracy"]) for h in got.state.history], history, atol=1e-6)
    before, best = 0.0, None
    for epoch, _, _, accuracy in history:
        if accuracy > before:
            before, best = accuracy, epoch
    assert got.best_epoch == best
    assert [r["epoch"] for r in got.runs(spark).orderBy("epoch").collect()] == [1, 2, 3, 4]


def test_a_pass_shuffles_gradients_only(spark):
    plan = FO.gradient(table(spark, texts()), np.zeros((TERMS + 1, 3)), FO.Settings())._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(idx")
    assert plan.count("hashpartitioning") == 1 and "partial_sum" in plan[exchange:]  # summed before it is shuffled
    assert plan.count("aggregate(") == 3 and "Join" not in plan and "Window" not in plan


def test_a_fit_goes_on_where_it_was_cut_short(spark, tmp_path, monkeypatch):
    rows = table(spark, texts()).persist()
    whole = FO.fit(rows, TERMS, epochs=5)
    store, passes, one_pass = ModelStore(spark, f"file://{tmp_path}"), [], FO.one_pass

    def failing(*args):
        passes.append(1)
        if len(passes) == 4:
            raise InterruptedError
        return one_pass(*args)

    monkeypatch.setattr(FO, "one_pass", failing)
    with pytest.raises(InterruptedError):
        FO.fit(rows, TERMS, epochs=5, store=store)
    assert store.about(store.latest("focal-state"))["epoch"] == 2
    # A state half written by the lost driver is passed over.
    with pytest.raises(ZeroDivisionError):
        store.publish("focal-state", lambda path: (spark.range(3).write.parquet(f"{path}/state"), 1 / 0))
    again = FO.fit(rows, TERMS, epochs=5, store=store)
    assert np.allclose(again.state.weights, whole.state.weights, atol=1e-12)
    assert [h["epoch"] for h in again.state.history] == [1, 2, 3, 4, 5]
    assert np.allclose([h["loss"] for h in again.state.history], [h["loss"] for h in whole.state.history])
    assert again.best_epoch == whole.best_epoch and np.allclose(again.best, whole.best, atol=1e-12)
    assert [store.about(v)["epoch"] for v in store.versions("focal-state")] == [1, 2, 3, 4, 5]
    accuracy = [h["accuracy"] for h in whole.state.history]
    risen = [k + 1 for k, a in enumerate(accuracy) if a > max(accuracy[:k], default=0.0)]
    assert [store.about(v)["epoch"] for v in store.versions("focal-best")] == risen
    done = len(passes)
    assert FO.fit(rows, TERMS, epochs=5, store=store).best_epoch == whole.best_epoch and len(passes) == done


def test_probabilities_are_those_of_the_weights(spark):
    rows, w = texts(), np.random.default_rng(1).normal(size=(TERMS + 1, 3))
    got = {r["row"]: r for r in FO.probabilities(table(spark, rows), ["row"], w, ["label"]).collect()}
    for i, y, _, xs in rows:
        z = w[TERMS] + sum((x * w[t] for t, x in xs.items()), np.zeros(3))
        assert np.allclose(got[i]["scores"], z) and abs(sum(got[i]["probs"]) - 1) < 1e-12 and got[i]["label"] == y


def test_nothing_to_fit_on_is_said(spark):
    with pytest.raises(ValueError):
        FO.fit(table(spark, texts()).limit(0), TERMS)


def test_store_loads_the_latest_complete_version(spark, tmp_path):
    store = ModelStore(spark, f"file://{tmp_path}/models/")
    assert store.latest("m") is None and store.versions("m") == []
    with pytest.raises(LookupError):
        store.load("m", lambda path: path)
    write = lambda k: lambda path: spark.range(k).write.parquet(f"{path}/t")
    read = lambda path: spark.read.parquet(f"{path}/t").count()
    first = store.publish("m", write(1), {"k": 1, "note": "é"})
    second = store.publish("m", write(2))
    with pytest.raises(ZeroDivisionError):
        store.publish("m", lambda path: (write(3)(path), 1 / 0))
    assert store.load("m", read) == 2 and store.about(first) == {"k": 1, "note": "é"} and store.about(second) == {}
    assert [v.number for v in store.versions("m")] == [1, 2] and [v.number for v in store.versions("m", False)] == [3]
    # The unfinished folder keeps its number; the next version gets one of its own.
    assert store.publish("m", write(4)).number == 4 and store.load("m", read) == 4
    # An older version is as it was.
    assert read(first.path) == 1
    # Two writers that took the same number are both whole; one of them is the latest.
    twin = tmp_path / "models" / "m" / "v00000004-zzzz"
    spark.range(9).write.parquet(f"file://{twin}/t")
    assert store.load("m", read) == 4
    (twin / COMMITTED).write_text("{}")
    assert store.load("m", read) == 9
    assert store.versions("other") == []


def test_pipeline_model_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, a + b AS c FROM __THIS__"), VectorAssembler(inputCols=["a", "c"], outputCol="v")]).fit(df)
    store = ModelStore(spark, f"file://{tmp_path}")
    store.publish_pipeline("pipe", model, {"stages": 2})
    assert store.load_pipeline("pipe").transform(df).select(F.col("v").cast("string")).collect() == model.transform(df).select(F.col("v").cast("string")).collect()

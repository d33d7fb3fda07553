"""Catalogue entries for the focal-loss classifier, its epochs and the model store.

The classifier is fitted on the aspect prompts outside the hold-out and evaluated on the hold-out after every
epoch. Two runs: the exponent of the combined training, and that of the stand-alone one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import vectors as V
from aspectra.operators import bayes as B
from aspectra.operators import focal as FO
from aspectra.operators import metrics as ME
from aspectra.operators import scoring as SC
from aspectra.plans import queries_eval as QE
from aspectra.plans import tables as D
from aspectra.plans import training as TR
from aspectra.plans.catalog import query
from aspectra.session import scratch_path
from aspectra.sources.model_store import ModelStore

RUNS = {"focal_2.0": FO.Settings(gamma=2.0), "focal_2.5": FO.Settings(gamma=2.5)}
BIAS = "(bias)"


@dataclass
class Data:
    train: DataFrame
    test: DataFrame
    vocab: DataFrame
    n_terms: int
    rows: DataFrame  # features of both


def data(spark: SparkSession, sf: str) -> Data:
    prepared = TR.with_prompt(TR.prepared(spark, sf))
    train, test = TR.split(prepared)
    vocab = TR.TextBayes("prompt", 1, 1, 0.1).fit_vocabulary(train).vocab
    n_terms = vocab.count()  # at most the vocabulary's cap
    return Data(train, test, vocab, n_terms, FO.features(prepared, "prompt", TR.KEYS, "sentiment", ~D.is_test(), vocab, n_terms))


def store(spark: SparkSession) -> ModelStore:
    return ModelStore(spark, scratch_path(spark, "models"))


def fits(found: Data, models: ModelStore) -> dict[str, FO.Fit]:
    return {run: FO.fit(found.rows, found.n_terms, 3, s, FO.EPOCHS, models, run) for run, s in RUNS.items()}


@query("focal_step")
def focal_step(spark: SparkSession, sf: str) -> DataFrame:
    """M4: the summed gradient of the weighted focal loss at zero weights, and the weights after one step."""
    found = data(spark, sf)
    state, settings = FO.State.zero(found.n_terms, 3), RUNS["focal_2.0"]
    slope, _ = FO.one_pass(found.rows, state.weights, settings)
    after, n = state.stepped(slope, settings).weights, found.train.count()
    both = FO.weights_table(spark, np.hstack([after, slope * n]))
    named = both.join(F.broadcast(found.vocab.select("idx", "term")), "idx", "left").select("*", F.coalesce("term", F.lit(BIAS)).alias("_t"))
    each = F.inline(F.array(*[F.struct(F.lit(j).alias("cls"), F.col(f"w{j + 3}").alias("gradient"), F.col(f"w{j}").alias("weight")) for j in range(3)]))
    return named.select(F.col("_t").alias("term"), each)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    found = [f.runs(spark) for f in fits(data(spark, sf), store(spark)).values()]
    return found[0].unionByName(found[1])


@query("focal_runs")
def focal_runs(spark: SparkSession, sf: str) -> DataFrame:
    """M4: losses and hold-out accuracy after each epoch of both runs."""
    return runs(spark, sf)


@query("fit_best_run")
def fit_best_run(spark: SparkSession, sf: str) -> DataFrame:
    """M10 on fitted epochs: the best accuracy before an epoch and whether the epoch beats it strictly."""
    return ME.best_run(runs(spark, sf))


@query("fit_best_epoch")
def fit_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """M10 on fitted epochs: the epoch whose model the store has as the run's best."""
    models = store(spark)
    fits(data(spark, sf), models)
    kept = [(run, (about := models.about(models.latest(f"{run}-best")))["epoch"], about["history"][-1]["accuracy"]) for run in RUNS]
    return spark.createDataFrame(kept, "run string, epoch int, accuracy double")


@query("focal_predict")
def focal_predict(spark: SparkSession, sf: str) -> DataFrame:
    """M4: class and probabilities of the hold-out by the best model of the first run, read from the store."""
    found, models, run = data(spark, sf), store(spark), next(iter(RUNS))
    FO.fit(found.rows, found.n_terms, 3, RUNS[run], FO.EPOCHS, models, run)
    best = models.latest(f"{run}-best")
    weights = FO.State.load(spark, best.path, models.about(best)).weights
    out = FO.probabilities(found.rows.where(~F.col("train")), TR.KEYS, weights, ["label"])
    return out.select(*TR.KEYS, "label", V.argmax(F.col("scores")).alias("pred"), *[F.col("probs")[j].alias(f"p{j}") for j in range(3)])


@query("fit_compare_epochs")
def fit_compare_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """E7 on fitted epochs: accuracy and loss of the classifier after each epoch, of the Bayes model, and of their fusion."""
    found, models, run = data(spark, sf), store(spark), next(iter(RUNS))
    FO.fit(found.rows, found.n_terms, 3, RUNS[run], FO.EPOCHS, models, run)
    nb = TR.bayes_model(found.train)
    # A hold-out row has the scores of B before its epochs are laid out: one join, however many epochs there are.
    b = nb.scores(found.test, TR.KEYS, single=True).withColumnRenamed("scores", "logits_b")
    hold_out, out = TR.materialize(found.rows.where(~F.col("train")).join(b, TR.KEYS)), None
    for version in models.versions(f"{run}-state"):
        about = models.about(version)
        a = FO.probabilities(hold_out, TR.KEYS, FO.State.load(spark, version.path, about).weights, ["label", "logits_b"])
        a = a.select(*TR.KEYS, "label", "logits_b", F.lit(about["epoch"]).alias("epoch"), F.col("scores").alias("logits_a"), F.col("probs").alias("_pa"))
        out = a if out is None else out.unionByName(a)
    both = out.withColumn("fused", V.fuse_weighted(F.col("_pa"), V.softmax(F.col("logits_b")), *QE.FUSE_WEIGHTS))
    preds = {"pred_a": "logits_a", "pred_b": "logits_b", "pred": "fused"}
    return QE._compare(both.withColumns({p: V.argmax(F.col(s)) for p, s in preds.items()}), ["epoch"])


@query("model_store_predict")
def model_store_predict(spark: SparkSession, sf: str) -> DataFrame:
    """The Bayes model published twice, a third attempt cut short; the hold-out scored with the latest complete one."""
    train, test = TR.split(TR.prepared(spark, sf))
    nb, models = TR.bayes_model(train), store(spark)
    models.publish("bayes", TR.TextBayes("sentence", 1, 1, 0.1, nb.vocab, nb.model).save, {"alpha": 0.1})
    models.publish("bayes", nb.save, {"alpha": nb.alpha})

    def cut_short(path: str) -> None:
        nb.vocab.limit(1).write.parquet(f"{path}/vocab")
        raise InterruptedError

    try:
        models.publish("bayes", cut_short)
    except InterruptedError:
        pass
    loaded = models.load("bayes", lambda path: TR.TextBayes.load(spark, path))
    scored = loaded.scores(test, carry=["sentiment"], single=True)
    return scored.select(*TR.KEYS, F.col("sentiment").alias("label"), B.predict(loaded.model, scored).alias("pred"))


@query("pipeline_store_score", oracle=False)
def pipeline_store_score(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted ML pipeline published, loaded, and the hold-out scored with the loaded one."""
    train, test = TR.split(TR.prepared(spark, sf))
    models = store(spark)
    models.publish_pipeline("lr", SC.linear_classifier(TR.with_prompt(train), "prompt", "sentiment"))
    scored = models.load_pipeline("lr").transform(SC.features_frame(TR.with_prompt(test), "prompt"))
    return scored.select(*TR.KEYS, F.col("sentiment").alias("label"), F.col("_pred").cast("int").alias("pred"),
                         *[SC.probabilities()[i].alias(f"p{i}") for i in range(3)])

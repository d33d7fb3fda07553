"""A linear text classifier trained on the class-weighted focal loss, as Spark jobs.

Features are one row per text: (keys, label, train, terms), ``terms`` an array of (idx, x), with the bias as one more, whose
index is the number of terms and whose x is 1. A pass over them has the weights (terms x classes, bounded by the
vocabulary) in its plan, scores each text where it lies, and sums the gradient by index; loss and accuracy of the
training and of the other rows come out of the same pass. Only partial gradients are shuffled, and what reaches the driver is
the gradient: a row per term, however many texts there are.

The loss of a row with label y and class probabilities p is ``a_y (1 - p_y)^g (-ln p_y)``, its mean over the training rows is
minimised by Adam with decoupled weight decay, a step per epoch.

``fit`` is resumable: with a store it publishes its state after each epoch and starts from the latest one; a model
is published only for an epoch whose accuracy is strictly above all before it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import vectors as V
from aspectra.operators import features as FE
from aspectra.operators import row_terms as RT
from aspectra.session import checkpoint
from aspectra.sources.model_store import ModelStore

# ---- fixed values -------------------------------------------------------
# Class weights and exponent the second classifier's loss is used with.
ALPHA, GAMMA = (0.5, 2.0, 1.0), 2.0
EPOCHS = 6
# The usual settings of Adam.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
# -------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    alpha: Sequence[float] = ALPHA
    gamma: float = GAMMA
    rate: float = 0.05
    decay: float = 0.01


def features(rows: DataFrame, text: str, keys: Sequence[str], label: str, train: Column, vocab: DataFrame, n_terms: int, lo: int = 1, hi: int = 1) -> DataFrame:
    """TF-IDF of all labelled rows, with the bias, laid out by ``keys`` (a checkpoint in the shared folder)."""
    rows = rows.where(F.col(label).isNotNull()).withColumn("train", train)
    table = vocab.select("term", "idx", "idf").collect()  # at most the vocabulary's cap
    terms = RT.weights(F.col(text), [r["term"] for r in table], [r["idx"] for r in table], [r["idf"] for r in table], lo, hi)
    bias = F.array(F.struct(F.lit(n_terms).alias("idx"), F.lit(1.0).alias("x")))
    each = rows.repartition(FE.work_partitions(rows), *keys).select(*keys, F.col(label).alias("label"), "train", terms.alias("terms"))
    found = each.withColumn("terms", F.concat(F.col("terms").cast("array<struct<idx:int,x:double>>"), bias))
    return checkpoint(found)


def _literal(values: np.ndarray) -> Column:
    """An array in the plan itself; the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps(values.tolist())), "array<double>")


def scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Feature rows with their scores z0, z1, ..."""

    def score(w: Column) -> Column:
        return F.aggregate("terms", F.lit(0.0), lambda z, t: z + t["x"] * F.get(w, t["idx"]))

    return rows.withColumns({f"z{j}": score(_literal(weights[:, j])) for j in range(weights.shape[1])})


def _pick(values: Sequence[Column], label: Column) -> Column:
    """The value at the place of the label."""
    return reduce(lambda out, jv: F.when(label == jv[0], jv[1]).otherwise(out), list(enumerate(values))[1:], values[0])


def with_gradient(rows: DataFrame, n_classes: int, settings: Settings) -> DataFrame:
    """Scored rows with ``loss``, ``hit`` and g0, g1, ...: the derivatives of the loss by the scores."""
    z = [F.col(f"z{j}") for j in range(n_classes)]
    at = F.col("label")
    out = rows.withColumn("_m", F.greatest(*z))
    out = out.withColumns({f"_e{j}": F.exp(z[j] - F.col("_m")) for j in range(n_classes)})
    out = out.withColumn("_s", sum((F.col(f"_e{j}") for j in range(1, n_classes)), F.col("_e0")))
    out = out.withColumns({f"_p{j}": F.col(f"_e{j}") / F.col("_s") for j in range(n_classes)})
    # The logarithm from the scores: exact also where the probability is next to 0.
    out = out.withColumns({"_ln": _pick(z, at) - F.col("_m") - F.log("_s"), "_pt": _pick([F.col(f"_p{j}") for j in range(n_classes)], at)})
    a = _pick([F.lit(float(x)) for x in settings.alpha], at)
    gamma, miss = F.lit(float(settings.gamma)), F.lit(1.0) - F.col("_pt")
    # (1 - pt)^(gamma - 1) (gamma pt ln pt - (1 - pt)), without a power of 0 below 0
    slope = a * (gamma * F.pow(miss, gamma - 1) * F.col("_pt") * F.col("_ln") - F.pow(miss, gamma)) if settings.gamma >= 1 else a * (
        F.when(miss > 0, gamma * F.pow(miss, gamma - 1) * F.col("_pt") * F.col("_ln")).otherwise(0.0) - F.pow(miss, gamma)
    )
    out = out.withColumns({"loss": -a * F.pow(miss, gamma) * F.col("_ln"), "_slope": slope})
    first = F.array_position(F.array(*z), F.col("_m")) - 1
    hit = (first == at).cast("double")
    own = [F.when(at == j, F.lit(1.0)).otherwise(F.lit(0.0)) for j in range(n_classes)]
    grads = [(F.col("_slope") * (own[j] - F.col(f"_p{j}"))).alias(f"g{j}") for j in range(n_classes)]
    return out.select(*[c for c in rows.columns], "loss", hit.alias("hit"), *grads)


def gradient(rows: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame:
    """(idx, d0, d1, ..., and for the bias n, loss, hits, n_other, loss_other, hits_other): sums over all rows."""
    n_terms, n_classes = weights.shape[0] - 1, weights.shape[1]
    each = with_gradient(scored(rows, weights), n_classes, settings)
    each = each.select("train", "loss", "hit", *[f"g{j}" for j in range(n_classes)], F.inline("terms"))
    once, train = F.col("idx") == n_terms, F.col("train")
    sums = [F.sum(F.when(train, F.col(f"g{j}") * F.col("x")).otherwise(0.0)).alias(f"d{j}") for j in range(n_classes)]
    for end, which in (("", train), ("_other", ~train)):
        sums.append(F.count_if(once & which).alias(f"n{end}"))
        sums += [F.sum(F.when(once & which, F.col(c)).otherwise(0.0)).alias(f"{name}{end}") for c, name in (("loss", "loss"), ("hit", "hits"))]
    return each.groupBy("idx").agg(*sums)


def weights_table(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """(idx, w0, w1, ...): a row per term and the bias."""
    columns = {f"w{j}": pa.array(weights[:, j]) for j in range(weights.shape[1])}
    return spark.createDataFrame(pa.table({"idx": pa.array(np.arange(len(weights), dtype=np.int32)), **columns}))


@dataclass
class State:
    """What a fit goes on from: weights after ``epoch`` steps, moments, and the evaluated epochs so far."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    epoch: int = 0
    history: list[dict] = field(default_factory=list)

    @classmethod
    def zero(cls, n_terms: int, n_classes: int) -> "State":
        shape = (n_terms + 1, n_classes)
        return cls(np.zeros(shape), np.zeros(shape), np.zeros(shape))

    def stepped(self, slope: np.ndarray, settings: Settings) -> "State":
        """One step of Adam with decoupled weight decay along the mean gradient."""
        t = self.epoch + 1
        mean = BETA1 * self.mean + (1 - BETA1) * slope
        square = BETA2 * self.square + (1 - BETA2) * slope * slope
        step = (mean / (1 - BETA1**t)) / (np.sqrt(square / (1 - BETA2**t)) + EPSILON)
        weights = self.weights * (1 - settings.rate * settings.decay) - settings.rate * step
        return replace(self, weights=weights, mean=mean, square=square, epoch=t)

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {"weights": self.weights, "mean": self.mean, "square": self.square}
        columns = {name: pa.array(list(x), pa.list_(pa.float64())) for name, x in arrays.items()}
        table = pa.table({"idx": pa.array(np.arange(len(self.weights), dtype=np.int32)), **columns})
        spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, about: dict) -> "State":
        """A row per term and the bias comes to the driver, as in every step."""
        rows = spark.read.parquet(f"{path}/state").orderBy("idx").collect()
        arrays = [np.array([r[c] for r in rows]) for c in ("weights", "mean", "square")]
        return cls(*arrays, about["epoch"], about["history"])


@dataclass
class Fit:
    state: State
    best: np.ndarray | None  # weights of the epoch that is kept
    best_epoch: int | None
    run: str

    def runs(self, spark: SparkSession) -> DataFrame:
        """(run, epoch, train_loss, loss, accuracy): a row per epoch."""
        rows = [(self.run, h["epoch"], h["train_loss"], h["loss"], h["accuracy"]) for h in self.state.history]
        return spark.createDataFrame(rows, "run string, epoch int, train_loss double, loss double, accuracy double")


def one_pass(rows: DataFrame, weights: np.ndarray, settings: Settings) -> tuple[np.ndarray, dict]:
    """(mean gradient, losses and accuracy) at some weights."""
    n_terms, n_classes = weights.shape[0] - 1, weights.shape[1]
    total, told = np.zeros_like(weights), None
    for r in gradient(rows, weights, settings).collect():  # at most a row per term and the bias
        total[r["idx"]] = [r[f"d{j}"] for j in range(n_classes)]
        told = r if r["idx"] == n_terms else told
    if told is None:
        raise ValueError("no rows to fit on")
    share = lambda a, b: a / b if b else float("nan")
    about = {"train_loss": share(told["loss"], told["n"]), "loss": share(told["loss_other"], told["n_other"]), "accuracy": share(told["hits_other"], told["n_other"])}
    return total / max(told["n"], 1), about


def fit(
    rows: DataFrame, n_terms: int, n_classes: int = 3, settings: Settings = Settings(), epochs: int = EPOCHS,
    store: ModelStore | None = None, run: str = "focal",
) -> Fit:
    """Train for ``epochs`` steps. After each the other rows (``train`` false) are scored; the weights of the first epoch with the
    highest accuracy are kept. With a store, kinds ``<run>-state`` and ``<run>-best`` are published there, and a
    fit that was cut short goes on after its last complete epoch, with the same result."""
    spark = rows.sparkSession
    state, best, best_epoch = State.zero(n_terms, n_classes), None, None
    if store and (kept := store.latest(f"{run}-state")):
        state = State.load(spark, kept.path, store.about(kept))
        if good := store.latest(f"{run}-best"):
            best, best_epoch = State.load(spark, good.path, store.about(good)).weights, store.about(good)["epoch"]
    while True:
        if state.epoch >= epochs and len(state.history) >= epochs:
            return Fit(state, best, best_epoch, run)
        slope, about = one_pass(rows, state.weights, settings)
        if state.epoch > len(state.history):
            # A state may be published before its best model is, so both are judged by the history alone.
            before = max((h["accuracy"] for h in state.history), default=0.0)
            state = replace(state, history=[*state.history, {"epoch": state.epoch, **about}])
            said = {"epoch": state.epoch, "history": state.history}
            if about["accuracy"] > before:
                best, best_epoch = state.weights, state.epoch
                if store:
                    store.publish(f"{run}-best", lambda path, s=state: s.save(spark, path), said)
            if store:
                store.publish(f"{run}-state", lambda path, s=state: s.save(spark, path), said)
        if state.epoch < epochs:
            state = state.stepped(slope, settings)


def probabilities(rows: DataFrame, keys: Sequence[str], weights: np.ndarray, carry: Sequence[str] = ()) -> DataFrame:
    """keys + carry + ``scores`` and ``probs`` (arrays by class) of feature rows."""
    scores = F.array(*[F.col(f"z{j}") for j in range(weights.shape[1])])
    return scored(rows, weights).select(*keys, *carry, scores.alias("scores")).withColumn("probs", V.softmax(F.col("scores")))

"""Evaluation as aggregations: accuracy, classification report, confusion
matrix, losses, batch-mean loss, best run and side-by-side comparison.

The prediction table is reduced once to at most classes x classes cells (a
partial + final hash aggregate); everything after that works on that tiny table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions import vectors as V
from aspectra.operators.prepare import LABELS_LOWER

CLASSES = (0, 1, 2)


def _classes(df: DataFrame, classes: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Dimension table (cls, name) of the fixed class list."""
    spark = df.sparkSession
    cls = F.array(*[F.lit(c) for c in classes])
    nm = F.array(*[F.lit(n) for n in names])
    return spark.range(len(classes)).select(
        F.element_at(cls, (F.col("id") + 1).cast("int")).alias("cls"),
        F.element_at(nm, (F.col("id") + 1).cast("int")).alias("name"),
    )


def cells(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.agg(
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", pred: str = "pred", classes: Sequence[int] = CLASSES
) -> DataFrame:
    """Rows = true class, columns c0..c(k-1) = predicted class; every class has a row."""
    c = cells(df, label, pred)
    wide = c.groupBy("label").pivot("pred", list(classes)).agg(F.sum("n"))
    for k in classes:
        wide = wide.withColumnRenamed(str(k), f"c{k}")
    dims = _classes(df, classes, [str(k) for k in classes]).select(F.col("cls").alias("label"))
    out = dims.join(wide, "label", "left")
    return out.select("label", *[F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("bigint").alias(f"c{k}") for k in classes])


def class_report(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    classes: Sequence[int] = CLASSES,
    names: Sequence[str] = LABELS_LOWER,
) -> DataFrame:
    """Per-class precision, recall, F1 and support (0 where undefined), then the
    accuracy row (F1 column, total support), macro and support-weighted averages."""
    c = cells(df, label, pred)
    sup = c.groupBy(F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))).alias("tp")
    )
    prd = c.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = _classes(df, classes, names).join(sup, "cls", "left").join(prd, "cls", "left")
    per = per.select(
        "cls",
        "name",
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"),
    )
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.select("cls", "name", "support", "tp", p.alias("precision"), r.alias("recall"))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    per = per.withColumn("f1", f1)
    total = F.sum("support")
    summary = per.agg(
        (F.sum("tp") / total).alias("acc"),
        F.avg("precision").alias("mp"),
        F.avg("recall").alias("mr"),
        F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("wf"),
        total.alias("support"),
    )
    rows = summary.select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), "support"),
                F.struct(F.lit("macro avg").alias("name"), F.col("mp").alias("precision"),
                         F.col("mr").alias("recall"), F.col("mf").alias("f1"), "support"),
                F.struct(F.lit("weighted avg").alias("name"), F.col("wp").alias("precision"),
                         F.col("wr").alias("recall"), F.col("wf").alias("f1"), "support"),
            )
        )
    )
    return per.select("name", "precision", "recall", "f1", "support").unionByName(rows)


def batch_mean(df: DataFrame, value: str, index: str, batch_size: int = 16) -> DataFrame:
    """Mean of per-batch means, batches of ``batch_size`` consecutive indices
    (0-based ``index``); a short last batch weighs as much as a full one."""
    b = df.groupBy((F.col(index) / batch_size).cast("bigint").alias("batch_id")).agg(F.avg(value).alias("m"))
    return b.agg(F.avg("m").alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))


def best_run(runs: DataFrame, run: str = "run", epoch: str = "epoch", acc: str = "accuracy") -> DataFrame:
    """Per epoch: the best accuracy before it and whether it improves on it
    strictly (the checkpoint rule). Runs are tiny: one row per run and epoch."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.max(acc).over(before), F.lit(0.0))
    return runs.select(run, epoch, acc, prev.alias("best_before"), (F.col(acc) > prev).alias("improved"))


def best_epoch(runs: DataFrame, run: str = "run", epoch: str = "epoch", acc: str = "accuracy") -> DataFrame:
    """Per run, the epoch whose model is kept: the first one with the highest
    accuracy. A run that never gets above 0 keeps none."""
    best = F.max_by(F.struct(epoch, acc), F.struct(F.col(acc), -F.col(epoch))).alias("_best")
    return runs.where(F.col(acc) > 0).groupBy(run).agg(best).select(run, f"_best.{epoch}", f"_best.{acc}")

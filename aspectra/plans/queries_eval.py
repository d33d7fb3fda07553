"""Catalogue entries for scoring, fusion, evaluation, runs and balancing.

Scores over the driver's ``embeddings`` table: model A scores class j with the
sum of the components at positions i = j (mod 3); model B with minus the sum
at positions i = j + 1 (mod 3). The true class is ``label % 3``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import vectors as V
from aspectra.operators import balance as BL
from aspectra.operators import metrics as ME
from aspectra.operators import scoring as SC
from aspectra.operators import synonyms as SY
from aspectra.plans import tables as D
from aspectra.plans import training as TR
from aspectra.plans.catalog import query
from aspectra.session import spread

DIM = 64
FUSE_WEIGHTS = (0.8, 0.2)
VOTE = (0.6, 0.4)
FOCAL_ALPHA = (0.5, 2.0, 1.0)
FOCAL_GAMMA = 2.0
BATCH = 16


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return spread(D.table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")


def _model_a(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb(spark, sf)
    return e.select("vec_id", (F.col("label") % 3).alias("label"),
                    SC.batch_score("embedding", SC.residue_scorer(3, 0, 1.0, DIM), DIM).alias("logits_a"))


def _model_b(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb(spark, sf)
    return e.select("vec_id", SC.batch_score("embedding", SC.residue_scorer(3, 1, -1.0, DIM), DIM).alias("logits_b"))


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Both models' outputs paired by row key (not by position)."""
    return _model_a(spark, sf).join(_model_b(spark, sf), "vec_id")


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    a = _aligned(spark, sf)
    pa, pb = V.softmax(F.col("logits_a")), V.softmax(F.col("logits_b"))
    fused = V.fuse_weighted(pa, pb, *FUSE_WEIGHTS)
    return a.select(
        "vec_id", "label", "logits_a", "logits_b", fused.alias("fused"),
        V.argmax(F.col("logits_a")).alias("pred_a"), V.argmax(F.col("logits_b")).alias("pred_b"),
        V.argmax(fused).alias("pred"),
    )


def _arr3(col: str, prefix: str):
    return [F.col(col)[i].alias(f"{prefix}{i}") for i in range(3)]


@query("batch_score")
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """M5: external model over Arrow batches (predict_batch_udf)."""
    return _model_a(spark, sf).select("vec_id", "label", *_arr3("logits_a", "a"))


@query("softmax")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    """M6."""
    a = _model_a(spark, sf)
    return a.select("vec_id", V.softmax(F.col("logits_a")).alias("p")).select("vec_id", *_arr3("p", "p"))


@query("argmax")
def argmax(spark: SparkSession, sf: str) -> DataFrame:
    """M7: first index on ties."""
    return _model_a(spark, sf).select("vec_id", V.argmax(F.col("logits_a")).alias("pred_a"))


@query("align_scores")
def align_scores(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    a = _aligned(spark, sf)
    return a.select("vec_id", "label", V.argmax(F.col("logits_a")).alias("pred_a"),
                    V.argmax(F.col("logits_b")).alias("pred_b"))


@query("fuse_weighted")
def fuse_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """M8: 0.8 * softmax(A) + 0.2 * softmax(B), renormalised, argmax."""
    return _fused(spark, sf).select("vec_id", *_arr3("fused", "f"), "pred")


@query("fuse_vote")
def fuse_vote(spark: SparkSession, sf: str) -> DataFrame:
    """M9: agree -> class; else A's class if its raw logit * 0.6 > 0.4, else B's."""
    f = _fused(spark, sf)
    final = V.fuse_vote(F.col("pred_a"), F.col("logits_a"), F.col("pred_b"), *VOTE)
    return f.select("vec_id", "pred_a", "pred_b", final.alias("final"))


@query("cross_entropy")
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cross-entropy of A's and B's logits and of the fused probabilities
    (the latter taken as scores, i.e. softmaxed a second time)."""
    f = _fused(spark, sf)
    rows = f.select(
        F.inline(F.array(
            F.struct(F.lit("a").alias("model"), V.cross_entropy(F.col("logits_a"), F.col("label")).alias("ce")),
            F.struct(F.lit("b").alias("model"), V.cross_entropy(F.col("logits_b"), F.col("label")).alias("ce")),
            F.struct(F.lit("fused").alias("model"), V.cross_entropy(F.col("fused"), F.col("label")).alias("ce")),
        ))
    )
    return rows.groupBy("model").agg(F.avg("ce").alias("loss"))


@query("focal_loss")
def focal_loss(spark: SparkSession, sf: str) -> DataFrame:
    """E5: focal loss of A's logits, alpha [0.5, 2.0, 1.0], gamma 2.0; mean and sum."""
    a = _model_a(spark, sf)
    fl = V.focal_loss(V.cross_entropy(F.col("logits_a"), F.col("label")), F.col("label"), FOCAL_ALPHA, FOCAL_GAMMA)
    per = a.select(fl.alias("fl"))
    return per.agg(F.avg("fl").alias("mean"), F.sum("fl").alias("sum")).select(
        F.inline(F.array(
            F.struct(F.lit("mean").alias("reduction"), F.col("mean").alias("loss")),
            F.struct(F.lit("sum").alias("reduction"), F.col("sum").alias("loss")),
        ))
    )


@query("batch_mean_loss")
def batch_mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Fused cross-entropy averaged per batch of 16 rows (vec_id order), then over batches."""
    f = _fused(spark, sf).select("vec_id", V.cross_entropy(F.col("fused"), F.col("label")).alias("ce"))
    lo, hi = D.table(spark, sf, "embeddings").agg(F.min("vec_id"), F.max("vec_id")).first()
    bucket = BL.range_bucket(F.col("vec_id"), lo or 0, hi or 0)
    idx = BL.ordered_index(f, [], bucket, [F.col("vec_id")], "pos", BL.N_BUCKETS)
    return ME.batch_mean(idx, "ce", "pos", BATCH)


@query("accuracy")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """E1 on the fused predictions."""
    return ME.accuracy(_fused(spark, sf))


@query("class_report")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    """E2 on the fused predictions."""
    return ME.class_report(_fused(spark, sf))


@query("confusion_matrix")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """E3 on the fused predictions."""
    return ME.confusion_matrix(_fused(spark, sf))


@query("model_compare")
def model_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and mean loss of A, B and the fusion side by side."""
    return _compare(_fused(spark, sf))


@query("model_compare_epochs")
def model_compare_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The same comparison for every epoch of a run."""
    return _compare(_fused(spark, sf).withColumn("epoch", F.col("vec_id") % 6), ["epoch"])


def _compare(f: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    long = f.select(
        *by,
        "label",
        F.inline(F.array(
            F.struct(F.lit("a").alias("model"), F.col("pred_a").alias("pred"),
                     V.cross_entropy(F.col("logits_a"), F.col("label")).alias("ce")),
            F.struct(F.lit("b").alias("model"), F.col("pred_b").alias("pred"),
                     V.cross_entropy(F.col("logits_b"), F.col("label")).alias("ce")),
            F.struct(F.lit("fused").alias("model"), F.col("pred").alias("pred"),
                     V.cross_entropy(F.col("fused"), F.col("label")).alias("ce")),
        )),
    )
    return long.groupBy(*by, "model").agg(
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.avg("ce").alias("loss")
    )


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    ev = D.table(spark, sf, "events")
    return ev.groupBy(F.col("event_type").alias("run"), (F.col("event_id") % 6).alias("epoch")).agg(
        (F.avg("value") / 100.0).alias("accuracy")
    )


@query("best_run")
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    """Per run and epoch, the best earlier accuracy and whether this epoch beats it strictly."""
    return ME.best_run(_runs(spark, sf))


@query("best_epoch")
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """The epoch whose model each run keeps."""
    return ME.best_epoch(_runs(spark, sf))


# ---------------------------------------------------------------- balancing
def _train(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = TR.split(TR.prepared(spark, sf))
    return train


@query("class_counts")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return BL.class_counts(_train(spark, sf), "sentiment")


def _boot(spark: SparkSession, sf: str, train: DataFrame | None = None) -> DataFrame:
    rows = train if train is not None else _train(spark, sf)
    return TR.materialize(BL.bootstrap(rows, "sentiment", TR.KEYS))


@query("bootstrap_balance")
def bootstrap_balance(spark: SparkSession, sf: str) -> DataFrame:
    """A3: every class drawn with replacement to the largest class size."""
    return _boot(spark, sf).select("sentiment", "slot", "doc_id", "line_no")


@query("synonym_augment")
def synonym_augment(spark: SparkSession, sf: str) -> DataFrame:
    """A2 on every training sentence."""
    return BL.synonym_replace(_train(spark, sf), "sentence", TR.KEYS, D.synonyms(spark, sf))


@query("synonym_learned_sets")
def synonym_learned_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The synonym sets that A2 takes, learned from all lines: words of the same contexts, several lemmas a set."""
    return SY.learn_synonyms(D.lines(spark, sf), "sentence")


@query("synonym_augment_learned")
def synonym_augment_learned(spark: SparkSession, sf: str) -> DataFrame:
    """A2 on every training sentence with the learned sets."""
    # Learned once: the sets are measured before the join.
    first = TR.materialize(SY.first_lemmas(SY.learn_synonyms(D.lines(spark, sf), "sentence")))
    return BL.synonym_replace(_train(spark, sf), "sentence", TR.KEYS, first)


def _neutral(boot: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    neutral = boot.where(F.col("sentiment") == 1)
    aug = BL.synonym_replace(neutral, "sentence", ["slot", "doc_id", "line_no"], D.synonyms(spark, sf), out="sentence")
    orig = neutral.select("slot", F.lit(0).alias("copy"), "doc_id", "line_no", "sentence")
    copies = aug.select("slot", F.lit(1).alias("copy"), "doc_id", "line_no", "sentence")
    return orig.unionByName(copies)


@query("augment_neutral")
def augment_neutral(spark: SparkSession, sf: str) -> DataFrame:
    """A4: resampled neutral rows plus their synonym-replaced copy."""
    return _neutral(_boot(spark, sf), spark, sf)


def _balanced(spark: SparkSession, sf: str, train: DataFrame | None = None) -> DataFrame:
    boot = _boot(spark, sf, train)
    others = boot.where(F.col("sentiment") != 1).select(
        "sentiment", "slot", F.lit(0).alias("copy"), "doc_id", "line_no", "sentence"
    )
    neutral = _neutral(boot, spark, sf).select(F.lit(1).alias("sentiment"), "slot", "copy", "doc_id", "line_no", "sentence")
    return others.unionByName(neutral)


@query("balanced_union")
def balanced_union(spark: SparkSession, sf: str) -> DataFrame:
    """A5: union of the balanced classes, duplicates kept."""
    return _balanced(spark, sf)


@query("shuffle_rows")
def shuffle_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded shuffle with a dense row index."""
    b = _balanced(spark, sf).select("sentiment", "slot", "copy")
    return BL.shuffle_index(b, ["sentiment", "slot", "copy"])


# ---------------------------------------------------------------- combined run
def _combined(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out rows with both models' scores, classes and their fusion: A is the
    prompt model, B the Bayes fitted on the balanced rows."""
    train, test = TR.split(TR.prepared(spark, sf))
    a = TR.prompt_model(train)
    b = TR.balanced_bayes(_balanced(spark, sf, train))
    if a.model.classes != b.model.classes:
        raise ValueError("both models must know the same classes")
    sa = a.scores(TR.with_prompt(test), carry=["sentiment"], single=True)
    sa = sa.select(*TR.KEYS, F.col("sentiment").alias("label"), F.col("scores").alias("logits_a"))
    both = sa.join(b.scores(test, TR.KEYS, single=True).withColumnRenamed("scores", "logits_b"), TR.KEYS)
    fused = V.fuse_weighted(V.softmax(F.col("logits_a")), V.softmax(F.col("logits_b")), *FUSE_WEIGHTS)
    both = both.withColumn("fused", fused)
    classes = F.array(*[F.lit(c) for c in a.model.classes])
    preds = {"pred_a": "logits_a", "pred_b": "logits_b", "pred": "fused"}
    return TR.materialize(both.withColumns({p: V.element(classes, V.argmax(F.col(s))) for p, s in preds.items()}))


@query("combined_scores")
def combined_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M8 on the trained models: fused class probabilities and classes of every hold-out row."""
    return _combined(spark, sf).select(*TR.KEYS, "label", "pred_a", "pred_b", "pred", *_arr3("fused", "f"))


@query("combined_eval")
def combined_eval(spark: SparkSession, sf: str) -> DataFrame:
    """E7 on the trained models: accuracy and mean loss of A, B and their fusion."""
    return _compare(_combined(spark, sf))


@query("combined_report")
def combined_report(spark: SparkSession, sf: str) -> DataFrame:
    """E2 on the fused classes of the trained models."""
    return ME.class_report(_combined(spark, sf))


@query("combined_confusion")
def combined_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """E3 on the fused classes of the trained models."""
    return ME.confusion_matrix(_combined(spark, sf))


@query("lr_train_score", oracle=False)
def lr_train_score(spark: SparkSession, sf: str) -> DataFrame:
    """M4: class-weighted multinomial logistic regression on the aspect prompt
    (CountVectorizer -> IDF -> LogisticRegression): class and class probabilities of the hold-out."""
    train, test = TR.split(TR.prepared(spark, sf))
    model = SC.linear_classifier(TR.with_prompt(train), "prompt", "sentiment")
    scored = model.transform(SC.features_frame(TR.with_prompt(test), "prompt"))
    return scored.select(*TR.KEYS, F.col("sentiment").alias("label"), F.col("_pred").cast("int").alias("pred"),
                         *[SC.probabilities()[i].alias(f"p{i}") for i in range(3)])

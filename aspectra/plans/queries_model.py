"""Catalogue entries for features and the Naive Bayes slice (train on the
prepared triples outside the hold-out, score the hold-out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions.text import vectorizer_tokens
from aspectra.operators import bayes as B
from aspectra.operators import features as FE
from aspectra.operators import metrics as ME
from aspectra.plans import training as TR
from aspectra.plans.catalog import query
from aspectra.session import scratch_path

KEYS = TR.KEYS


def _fitted(spark: SparkSession, sf: str):
    train, test = TR.split(TR.prepared(spark, sf))
    return train, test, TR.bayes_model(train)


def _vocab(spark: SparkSession, sf: str):
    train, test = TR.split(TR.prepared(spark, sf))
    return train, test, TR.bayes_vocabulary(train)


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    _, test, nb = _fitted(spark, sf)
    scored = nb.scores(test, carry=["sentiment"], single=True)
    return scored.select(*KEYS, F.col("sentiment").alias("label"), B.predict(nb.model, scored).alias("pred"), "scores")


@query("tokenize")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """vectoriser tokens of every prepared sentence."""
    tri = TR.prepared(spark, sf)
    t = vectorizer_tokens(F.col("sentence"))
    return tri.select(*KEYS, F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("ngrams")
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """1-4-gram counts per training sentence."""
    train, _ = TR.split(TR.prepared(spark, sf))
    return FE.term_counts(train, "sentence", KEYS, 1, 4)


@query("vocabulary")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """top 5000 1-4-grams by total count, alphabetical index."""
    _, _, nb = _vocab(spark, sf)
    return nb.vocab.select("term", "idx", "total", "df")


@query("idf")
def idf(spark: SparkSession, sf: str) -> DataFrame:
    """smoothed idf of the vocabulary."""
    _, _, nb = _vocab(spark, sf)
    return nb.vocab.select("term", "idf")


@query("tfidf")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """L2-normalised TF-IDF of the hold-out sentences."""
    _, test, nb = _vocab(spark, sf)
    return nb.weights(test, single=True).select(*KEYS, "term", "weight")


@query("nb_fit_prior")
def nb_fit_prior(spark: SparkSession, sf: str) -> DataFrame:
    """M1: class counts and unsmoothed log prior."""
    _, _, nb = _fitted(spark, sf)
    return nb.model.prior


@query("nb_fit_terms")
def nb_fit_terms(spark: SparkSession, sf: str) -> DataFrame:
    """M1: smoothed term log-probabilities per class (alpha 1.0)."""
    _, _, nb = _fitted(spark, sf)
    return nb.model.term_lp


@query("model_roundtrip")
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Model tables written as Parquet and read back."""
    _, _, nb = _fitted(spark, sf)
    path = scratch_path(spark, "nb-model")
    nb.model.save(path)
    return B.NBModel.load(spark, path).term_lp


@query("model_load_predict")
def model_load_predict(spark: SparkSession, sf: str) -> DataFrame:
    """S8 + M2: the whole model saved, loaded, and the hold-out scored with the loaded one."""
    _, test, nb = _fitted(spark, sf)
    path = scratch_path(spark, "text-bayes")
    nb.save(path)
    loaded = TR.TextBayes.load(spark, path)
    scored = loaded.scores(test, carry=["sentiment"], single=True)
    return scored.select(*KEYS, F.col("sentiment").alias("label"), B.predict(loaded.model, scored).alias("pred"))


@query("nb_predict")
def nb_predict(spark: SparkSession, sf: str) -> DataFrame:
    """M2: predicted class of every hold-out sentence."""
    return _predictions(spark, sf).drop("scores")


@query("nb_proba")
def nb_proba(spark: SparkSession, sf: str) -> DataFrame:
    """M3: class probabilities (softmax of the joint log-likelihood)."""
    scored = _predictions(spark, sf)
    p = B.predict_proba(scored)
    return scored.select(*KEYS, *[p[i].alias(f"p{i}") for i in range(3)])


@query("nb_accuracy")
def nb_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """E1 on the Bayes hold-out predictions."""
    return ME.accuracy(_predictions(spark, sf))


@query("nb_report")
def nb_report(spark: SparkSession, sf: str) -> DataFrame:
    """E2 on the Bayes hold-out predictions."""
    return ME.class_report(_predictions(spark, sf))


@query("nb_confusion")
def nb_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """E3 on the Bayes hold-out predictions."""
    return ME.confusion_matrix(_predictions(spark, sf))


@query("concat_pad")
def concat_pad(spark: SparkSession, sf: str) -> DataFrame:
    """joint log-likelihoods || TF-IDF of the hold-out, forced to 4526 positions (sparse)."""
    _, test, nb = _fitted(spark, sf)
    scored = nb.scores(test, single=True).select(*KEYS, F.col("scores").alias("logits"))
    return FE.concat_pad(scored, nb.weights(test, single=True), KEYS)


@query("encode_pairs")
def encode_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(sentence, aspect) -> fixed-length ids and mask, vocabulary of all words."""
    tri = TR.prepared(spark, sf)
    vocab = FE.encode_vocabulary(tri, ["sentence", "aspect"])
    enc = FE.encode_pairs(tri, "sentence", "aspect", KEYS, vocab)
    return enc.select(
        *KEYS,
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"),
    )

"""Scoring with external and Spark ML models.

* ``batch_score`` runs a user model over Arrow batches with
  ``predict_batch_udf``: the model is built once per Python worker and gets
  whole NumPy batches, never single rows.
* ``linear_classifier`` is the class-weighted multinomial logistic regression
  that stands in for the fine-tuned transformer: an ML Pipeline of
  CountVectorizer -> IDF -> LogisticRegression over the vectoriser n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.text import ngrams, vectorizer_tokens

# Class weights the second classifier's loss used (negative, neutral, positive).
CLASS_WEIGHTS = (0.5, 2.0, 1.0)


def batch_score(
    col: str | Column, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], dim: int, batch_size: int = 4096
) -> Column:
    """ARRAY<DOUBLE> scores of an ARRAY<numeric> column of width ``dim``."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[dim]],
    )
    return udf(F.col(col) if isinstance(col, str) else col)


def residue_scorer(n_classes: int = 3, shift: int = 0, sign: float = 1.0, dim: int = 64):
    """Factory for a fixed linear model: score_j = sign * sum of the inputs whose
    position i satisfies (i - shift) mod n_classes == j. Built once per worker."""

    def make():
        w = np.zeros((dim, n_classes))
        for i in range(dim):
            w[i, (i - shift) % n_classes] = sign

        def predict(x: np.ndarray) -> np.ndarray:
            return np.asarray(x, dtype=np.float64).reshape(-1, dim) @ w

        return predict

    return make


def linear_classifier(
    train: DataFrame,
    text: str,
    label: str,
    lo: int = 1,
    hi: int = 1,
    vocab_size: int = 5000,
    class_weights: Sequence[float] = CLASS_WEIGHTS,
    max_iter: int = 50,
):
    """Fit the class-weighted multinomial logistic regression; returns the fitted
    PipelineModel. Input columns are built with native expressions."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer

    prepared = features_frame(train, text, lo, hi).withColumn(
        "class_weight", F.element_at(F.array(*[F.lit(float(w)) for w in class_weights]), (F.col(label) + 1).cast("int"))
    )
    pipe = Pipeline(
        stages=[
            CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=vocab_size),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features",
                labelCol=label,
                weightCol="class_weight",
                family="multinomial",
                maxIter=max_iter,
                probabilityCol="_proba",
                rawPredictionCol="_raw",
                predictionCol="_pred",
            ),
        ]
    )
    return pipe.fit(prepared.withColumn(label, F.col(label).cast("double")))


def probabilities(col: str = "_proba") -> Column:
    """Class probabilities of the classifier as ARRAY<DOUBLE>, ready for fusion, vote and loss."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))


def features_frame(df: DataFrame, text: str, lo: int = 1, hi: int = 1) -> DataFrame:
    return df.withColumn("_grams", ngrams(vectorizer_tokens(F.col(text)), lo, hi))

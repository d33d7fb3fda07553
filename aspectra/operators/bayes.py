"""Multinomial Naive Bayes on TF-IDF weights, fitted and applied as Spark jobs.

Model tables (all bounded by classes x vocabulary):
    prior      (cls, n, log_prior)            log_prior = ln(n_c / N), not smoothed
    term_lp    (term, cls, log_prob)          ln((W_ct + a) / (sum_t W_ct + a * V))

ML's NaiveBayes also smooths the prior (ln(n_c + a) - ln(N + a * C)), so it is
not used here; the formulas above are the ones the reference pipeline relies on.
"""

from __future__ import annotations

from collections.abc import Sequence
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions import vectors as V
from aspectra.functions.sizes import row_bytes
from aspectra.operators.match import sized_broadcast
from aspectra.session import checkpoint

# Largest term table broadcast for scoring (vocabulary x classes rows).
BROADCAST_TERM_ROWS = 5_000_000
# Largest table of prompt heads, in measured bytes, that is broadcast to the pairs.
BROADCAST_HEAD_BYTES = 64 << 20


@dataclass
class NBModel:
    classes: list[int]
    prior: DataFrame  # cls, n, log_prior
    term_lp: DataFrame  # term, cls, log_prob
    n_terms: int | None = None  # vocabulary size when known
    priors: list[float] | None = None  # log priors in class order, when known

    def log_priors(self) -> list[float]:
        if self.priors is None:
            # At most a handful of rows (one per class).
            self.priors = [float(r["log_prior"]) for r in self.prior.orderBy("cls").select("log_prior").collect()]
        return self.priors

    def term_vectors(self) -> DataFrame:
        """(term, lp ARRAY<DOUBLE>) with one element per class, in class order."""
        arr = F.array_sort(F.collect_list(F.struct("cls", "log_prob")))
        return self.term_lp.groupBy("term").agg(F.transform(arr, lambda e: e["log_prob"]).alias("lp"))

    def save(self, path: str) -> None:
        self.prior.write.mode("overwrite").parquet(f"{path}/prior")
        self.term_lp.write.mode("overwrite").parquet(f"{path}/term_lp")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "NBModel":
        prior = spark.read.parquet(f"{path}/prior")
        term_lp = spark.read.parquet(f"{path}/term_lp")
        classes = sorted(r["cls"] for r in prior.select("cls").collect())
        return cls(classes, prior, term_lp)


def fit(
    rows: DataFrame,
    weights: DataFrame,
    vocab: DataFrame,
    label: str = "label",
    alpha: float = 0.1,
    vocab_bound: int | None = None,
) -> NBModel:
    """rows: one row per training document with ``label``; weights: TF-IDF rows
    (term, weight) carrying the same ``label``; vocab: (term, ...)."""
    # One row per class: the class sizes are collected once and the prior table is
    # built from them (no further job to compute or materialise it).
    sizes = sorted(
        (r["cls"], r["n"])
        for r in rows.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("cls"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    classes = [c for c, _ in sizes]
    n_total = sum(n for _, n in sizes)
    priors = [math.log(n / n_total) for _, n in sizes]
    schema = T.StructType(
        [
            T.StructField("cls", rows.schema[label].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("log_prior", T.DoubleType()),
        ]
    )
    prior = rows.sparkSession.createDataFrame([(c, n, p) for (c, n), p in zip(sizes, priors)], schema)

    fc = weights.groupBy(F.col(label).alias("cls"), "term").agg(F.sum("weight").alias("fc"))
    totals = fc.groupBy("cls").agg(F.sum("fc").alias("fc_total"))
    n_terms = vocab.select(F.count(F.lit(1))).scalar()
    grid = vocab.select("term", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls"))
    totals_b, _ = sized_broadcast(totals, 10_000, bound=len(classes))
    term_lp = (
        grid.join(fc, ["cls", "term"], "left")
        .join(totals_b, "cls", "left")
        .select(
            "term",
            "cls",
            (
                F.log(F.coalesce("fc", F.lit(0.0)) + F.lit(alpha))
                - F.log(F.coalesce("fc_total", F.lit(0.0)) + F.lit(alpha) * n_terms)
            ).alias("log_prob"),
        )
    )
    # The model tables are small (classes x vocabulary); materialise them once so
    # that scoring, however often it runs, never recomputes the fit.
    return NBModel(classes, prior, checkpoint(term_lp), vocab_bound, priors)


def joint_log_likelihood(
    model: NBModel, rows: DataFrame, weights: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """keys + carry + scores ARRAY<DOUBLE>: log prior + sum_t weight_t * log_prob_ct,
    one element per class. Rows without any vocabulary term score the prior."""
    k = len(model.classes)
    tv, _ = sized_broadcast(model.term_vectors(), BROADCAST_TERM_ROWS, model.n_terms)
    # Every row enters the aggregate through one marker row (no term), also rows
    # without vocabulary terms; the marker also carries the pass-through columns,
    # so no join back to the rows is needed.
    marker = rows.select(*keys, *carry, F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight"))
    nulls = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carry]
    stream = weights.select(*keys, *nulls, "term", "weight").unionByName(marker)
    dots = (
        stream.join(tv, "term", "left")
        .groupBy(*keys)
        .agg(
            *[F.sum(F.col("weight") * F.coalesce(F.col("lp")[i], F.lit(0.0))).alias(f"_d{i}") for i in range(k)],
            *[F.max(c).alias(c) for c in carry],
        )
    )
    priors = model.log_priors()
    scores = F.array(*[F.lit(priors[i]) + F.col(f"_d{i}") for i in range(k)])
    return dots.select(*keys, *carry, scores.alias("scores"))


def joint_log_likelihood_shared(
    model: NBModel,
    vocab: DataFrame,
    heads: DataFrame,
    head: str,
    head_keys: Sequence[str],
    texts: DataFrame,
    text: str,
    text_keys: Sequence[str],
    vocab_bound: int | None = None,
) -> DataFrame:
    """Scores of documents ``head ++ text`` where many heads share one text
    (e.g. one prompt per lexicon hit of a line), for 1-gram features.

    Term counts add up, tf(h ++ s) = tf(h) + tf(s), so with w = tf * idf:
        |w|^2   = S2(s) + sum_{t in h} idf_t^2 (2 tf_s,t tf_h,t + tf_h,t^2)
        w . lp  = D(s) + sum_{t in h} tf_h,t idf_t lp_t
    S2 and D are computed once per text, the corrections once per head: the
    work grows with text length plus hits, not with their product.
    ``head_keys`` must contain ``text_keys``; head and text must meet at a
    non-word character so that no token spans them.
    Output: head_keys + scores ARRAY<DOUBLE>, equal to joint_log_likelihood of
    the concatenated documents.
    """
    from aspectra.operators import features as FE

    k = len(model.classes)
    tk, hk = list(text_keys), list(head_keys)
    tv, _ = sized_broadcast(model.term_vectors(), BROADCAST_TERM_ROWS, model.n_terms)
    v, _ = sized_broadcast(vocab.select("term", "idf"), BROADCAST_TERM_ROWS, vocab_bound)
    ts = FE.term_counts(texts, text, tk, 1, 1).join(v, "term")
    lp = [F.coalesce(F.col("lp")[i], F.lit(0.0)) for i in range(k)]
    per_text = (
        ts.join(tv, "term", "left")
        .groupBy(*tk)
        .agg(
            F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("_s2"),
            *[F.sum(F.col("tf") * F.col("idf") * lp[i]).alias(f"_d{i}") for i in range(k)],
        )
    )
    # Heads are read once: explode_outer keeps a head without tokens (term null),
    # so the per-head aggregate already has one row for every head.
    ht = heads.select(*hk, F.explode_outer(FE.vectorizer_tokens(F.col(head))).alias("term"))
    th = ht.groupBy(*hk, "term").agg(F.count(F.lit(1)).alias("tf_h")).join(v, "term", "left")
    th = th.join(ts.select(*tk, "term", F.col("tf").alias("tf_s")), [*tk, "term"], "left").join(tv, "term", "left")
    tf_s = F.coalesce(F.col("tf_s"), F.lit(0))
    idf = F.coalesce(F.col("idf"), F.lit(0.0))  # terms outside the vocabulary add nothing
    per_head = th.groupBy(*hk).agg(
        F.sum(F.pow(idf, 2) * (2 * tf_s * F.col("tf_h") + F.pow(F.col("tf_h"), 2))).alias("_c2"),
        *[F.sum(F.col("tf_h") * idf * lp[i]).alias(f"_e{i}") for i in range(k)],
    )
    out = per_head.join(per_text, tk, "left")
    norm = F.sqrt(F.coalesce(F.col("_s2"), F.lit(0.0)) + F.coalesce(F.col("_c2"), F.lit(0.0)))
    priors = model.log_priors()
    dots = [
        F.when(norm > 0, (F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) + F.coalesce(F.col(f"_e{i}"), F.lit(0.0))) / norm)
        .otherwise(F.lit(0.0))
        for i in range(k)
    ]
    return out.select(*hk, F.array(*[F.lit(priors[i]) + dots[i] for i in range(k)]).alias("scores"))


def joint_log_likelihood_by_head(
    model: NBModel,
    vocab: DataFrame,
    pairs: DataFrame,
    heads: DataFrame,
    head_key: str,
    head: str,
    texts: DataFrame,
    text: str,
    text_keys: Sequence[str],
    vocab_bound: int | None = None,
) -> DataFrame:
    """Scores of documents ``head ++ text`` for ``pairs`` (text_keys + head_key) where few distinct heads (head_key, head)
    meet many texts, for 1-gram features.

    With w = tf * idf, for a head h and a text s:
        |w|^2   = S2(s) + C(h) + sum_{t in h} 2 idf_t^2 tf_h,t tf_s,t
        w . lp  = D(s) + E(h)
    C, E and the factors of tf_s,t are a head's own: one row per head, broadcast if its measured bytes allow. S2, D and the
    text's term numbers with their counts are one row per text, so that a pair needs no term rows: it looks up the
    few terms of its head among the text's. Head and text must meet at a non-word character.
    Output: text_keys + head_key + scores ARRAY<DOUBLE>, equal to joint_log_likelihood of the concatenated documents.
    """
    from aspectra.operators import features as FE

    k, tk = len(model.classes), list(text_keys)
    table = vocab.select("term", "idx", "idf").join(model.term_vectors(), "term", "left")
    known, _ = sized_broadcast(table, BROADCAST_TERM_ROWS, vocab_bound)
    lp = [F.coalesce(F.col("lp")[i], F.lit(0.0)) for i in range(k)]
    per_text = (
        FE.term_counts(texts, text, tk, 1, 1)
        .join(known, "term")
        .groupBy(*tk)
        .agg(
            F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("_s2"),
            *[F.sum(F.col("tf") * F.col("idf") * lp[i]).alias(f"_d{i}") for i in range(k)],
            F.collect_list(F.struct("idx", "tf")).alias("_terms"),
        )
    )
    counted = heads.select(head_key, F.explode_outer(FE.vectorizer_tokens(F.col(head))).alias("term"))
    counted = counted.groupBy(head_key, "term").agg(F.count(F.lit(1)).alias("tf_h")).join(known, "term", "left")
    idf = F.coalesce(F.col("idf"), F.lit(0.0))  # terms outside the vocabulary add nothing
    factor = F.struct("idx", (2 * F.pow(idf, 2) * F.col("tf_h")).alias("w"))
    per_head = counted.groupBy(head_key).agg(
        F.sum(F.pow(idf * F.col("tf_h"), 2)).alias("_c2"),
        *[F.sum(F.col("tf_h") * idf * lp[i]).alias(f"_e{i}") for i in range(k)],
        F.collect_list(F.when(F.col("idx").isNotNull(), factor)).alias("_factors"),
    )
    per_head = checkpoint(per_head)
    size = per_head.agg(F.sum(row_bytes(per_head))).first()[0] or 0
    # The pairs are shuffled to their texts before they get anything of their heads.
    met = pairs.join(per_text, tk, "left").join(F.broadcast(per_head) if size <= BROADCAST_HEAD_BYTES else per_head, head_key)
    ids, tfs = F.col("_terms")["idx"], F.col("_terms")["tf"]
    count = lambda i: F.coalesce(F.get(tfs, (F.array_position(ids, i) - 1).cast("int")), F.lit(0))
    shared = F.aggregate("_factors", F.lit(0.0), lambda s, f: s + f["w"] * count(f["idx"]))
    norm = F.sqrt(F.coalesce(F.col("_s2"), F.lit(0.0)) + F.col("_c2") + F.col("_shared"))
    priors = model.log_priors()
    dots = [F.when(F.col("_norm") > 0, (F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) + F.col(f"_e{i}")) / F.col("_norm")).otherwise(F.lit(0.0)) for i in range(k)]
    out = met.withColumn("_shared", shared).withColumn("_norm", norm)
    return out.select(*tk, head_key, F.array(*[F.lit(priors[i]) + dots[i] for i in range(k)]).alias("scores"))


def predict(model: NBModel, scored: DataFrame, scores: str = "scores") -> F.Column:
    """Predicted class (lowest class on ties)."""
    idx = V.argmax(F.col(scores))
    cls = F.array(*[F.lit(c) for c in model.classes])
    return V.element(cls, idx)


def predict_proba(scored: DataFrame, scores: str = "scores") -> F.Column:
    return V.softmax(F.col(scores))

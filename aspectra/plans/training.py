"""Training-side compositions over the driver tables: prepared triples, the
train/test split, and the two Naive Bayes models used by inference.

* bayes   1-4-grams of the sentence, alpha 1.0 (the stand-alone Bayes script)
* prompt  1-grams of the aspect prompt, alpha 0.1, stands in for the second
          classifier (its class probabilities play the role of its scores)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import vectors as V
from aspectra.operators import bayes as B
from aspectra.operators import clauses as C
from aspectra.operators import features as FE
from aspectra.operators import prepare as P
from aspectra.operators import row_terms as RT
from aspectra.plans import tables as D
from aspectra.session import checkpoint

KEYS = ["doc_id", "line_no"]
# Largest vocabulary that goes to the tasks as a table; larger ones are joined.
MOST_LOCAL_TERMS = 100_000


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared checkpoint folder."""
    return checkpoint(df)


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(P.prepare_triples(D.raw_triples(spark, sf), keys=KEYS))


def split(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    return triples.where(~D.is_test()), triples.where(D.is_test())


@dataclass
class TextBayes:
    text: str
    lo: int
    hi: int
    alpha: float
    vocab: DataFrame | None = None
    model: B.NBModel | None = None
    keys: Sequence[str] = tuple(KEYS)  # identify a training row; also the default of the rows scored
    _table: list | None = field(default=None, repr=False)  # the vocabulary, once it was collected

    @property
    def classes(self) -> Sequence[int]:
        return self.model.classes

    def vote_scores(self, scores: Column) -> Column:
        """Log-likelihoods are no scores to hold against a threshold; their class probabilities are."""
        return V.softmax(scores)

    def counts(self, rows: DataFrame, keys: Sequence[str] | None = None, carry=()) -> DataFrame:
        return FE.term_counts(rows, self.text, keys or self.keys, self.lo, self.hi, carry=carry)

    def fit_vocabulary(self, train: DataFrame) -> "TextBayes":
        """Vocabulary and idf only (what a TF-IDF transform needs)."""
        n_docs = train.select(F.count(F.lit(1))).scalar()
        self.vocab = checkpoint(FE.top_terms(RT.term_stats(train, self.text, self.lo, self.hi), n_docs, FE.MAX_FEATURES))
        self._table = None
        return self

    def fit(self, train: DataFrame, label: str = "sentiment") -> "TextBayes":
        # The texts are read twice, once for the vocabulary and once for the class sums: no n-gram is kept.
        self.fit_vocabulary(train)
        each = train.select(label, F.inline(self.row_weights(F.col(self.text))))
        sums = each.groupBy(label, "idx").agg(F.sum("weight").alias("weight"))
        weights = sums.join(F.broadcast(self.vocab.select("idx", "term")), "idx")
        self.model = B.fit(train, weights, self.vocab, label=label, alpha=self.alpha, vocab_bound=FE.MAX_FEATURES)
        return self

    def local(self) -> bool:
        """Whether the vocabulary is small enough to go to the tasks: one that was fitted here is."""
        return self._table is not None or len(self.vocab.select("idx").take(MOST_LOCAL_TERMS + 1)) <= MOST_LOCAL_TERMS

    def _terms(self) -> list:
        if self._table is None:
            self._table = self.vocab.select("term", "idx", "idf").orderBy("idx").collect()
        return self._table

    def row_weights(self, text: Column) -> Column:
        """ARRAY<STRUCT<idx, weight>> of a text: its TF-IDF over the vocabulary."""
        table = self._terms()
        return RT.weights(text, [r["term"] for r in table], [r["idx"] for r in table], [r["idf"] for r in table], self.lo, self.hi)

    def tables(self) -> tuple[list[str], list[float], list[list[float]]]:
        """(terms, their idf, by class their log-probabilities), for the tasks."""
        table = self._terms()
        logs = {r["term"]: r["lp"] for r in self.model.term_vectors().join(F.broadcast(self.vocab.select("term")), "term", "left_semi").collect()}
        by_class = [[(logs.get(r["term"]) or none)[j] for r in table] for none in [[0.0] * len(self.classes)] for j in range(len(self.classes))]
        return [r["term"] for r in table], [r["idf"] for r in table], by_class

    def row_scores(self, text: Column) -> Column:
        """ARRAY<DOUBLE> joint log-likelihood of a text, one element per class."""
        terms, idf, by_class = self.tables()
        return RT.scores(text, terms, idf, by_class, self.model.log_priors(), self.lo, self.hi)

    def weights(self, rows: DataFrame, keys: Sequence[str] | None = None, single: bool = False) -> DataFrame:
        """keys + (term, idx, weight). ``single``: no two rows share a key; then each row is weighed by itself.
        Otherwise the texts of rows that share a key count as one."""
        if single and self.local():
            each = rows.select(*(keys or self.keys), F.inline(self.row_weights(F.col(self.text))))
            return each.join(F.broadcast(self.vocab.select("idx", "term")), "idx").select(*(keys or self.keys), "term", "idx", "weight")
        return FE.tfidf(self.counts(rows, keys), self.vocab, keys or self.keys)

    def scores(self, rows: DataFrame, keys: Sequence[str] | None = None, carry=(), single: bool = False) -> DataFrame:
        """keys + carry + scores; ``single`` as in ``weights``."""
        if single and self.local():
            return rows.select(*(keys or self.keys), *carry, self.row_scores(F.col(self.text)).alias("scores"))
        return B.joint_log_likelihood(self.model, rows, self.weights(rows, keys), keys or self.keys, carry)

    def save(self, path: str) -> None:
        """Everything scoring needs, as Parquet: settings, vocabulary with idf, prior, term log-probabilities."""
        spark = self.vocab.sparkSession
        settings = spark.createDataFrame([(self.text, self.lo, self.hi, self.alpha)], "text string, lo int, hi int, alpha double")
        settings.write.mode("overwrite").parquet(f"{path}/settings")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.model.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, keys: Sequence[str] = tuple(KEYS)) -> "TextBayes":
        s = spark.read.parquet(f"{path}/settings").first()
        vocab = spark.read.parquet(f"{path}/vocab")
        return cls(s["text"], s["lo"], s["hi"], s["alpha"], vocab, B.NBModel.load(spark, path), keys)


def with_prompt(df: DataFrame, aspect: str = "aspect", text: str = "sentence") -> DataFrame:
    return df.withColumn("prompt", C.aspect_prompt(F.col(aspect), F.col(text), D.PROMPT_EN))


def bayes_model(train: DataFrame) -> TextBayes:
    return TextBayes("sentence", 1, 4, 1.0).fit(train)


def bayes_vocabulary(train: DataFrame) -> TextBayes:
    return TextBayes("sentence", 1, 4, 1.0).fit_vocabulary(train)


def balanced_bayes(balanced: DataFrame) -> TextBayes:
    """The combined run's Bayes: 1-grams, alpha 0.1, on balanced rows. A row drawn several times is several rows."""
    rows = materialize(balanced.withColumn("drawn", F.col("sentiment")))
    return TextBayes("sentence", 1, 1, 0.1, keys=("drawn", "slot", "copy")).fit(rows)


def prompt_model(train: DataFrame) -> TextBayes:
    return TextBayes("prompt", 1, 1, 0.1).fit(with_prompt(train))

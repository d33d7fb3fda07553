"""Catalogue entries for inference (batch and stream) and the aspect map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.operators import features as FE
from aspectra.operators import match as M
from aspectra.operators.scoring import batch_score, residue_scorer
from aspectra.plans import inference as INF
from aspectra.plans import row_local as RL
from aspectra.plans import tables as D
from aspectra.plans import training as TR
from aspectra.plans.catalog import query
from aspectra.session import scratch_path
from aspectra.streaming.append import append_available
from aspectra.streaming.infer_stream import run_available


# Letters counted by the external model's features, and what each count is reduced by.
USER_LETTERS, USER_MODULI = ("e", "a", " ", "o", "t"), (7, 5, 4, 6, 3, 5)


def _models(spark: SparkSession, sf: str):
    train, _ = TR.split(TR.prepared(spark, sf))
    return TR.prompt_model(train), TR.bayes_model(train)


@query("infer_aspects")
def infer_aspects(spark: SparkSession, sf: str) -> DataFrame:
    """Every clause of every document line -> aspect -> two models -> vote -> label."""
    a, b = _models(spark, sf)
    return INF.infer_aspects(D.clauses(spark, sf), D.ranked_lexicon(spark, sf), a, b, D.PROMPT_EN)


def text_features(text: Column) -> Column:
    """A few counts of a text, as the input of a fixed linear scorer."""
    n = F.char_length(text)
    count = [n, *[n - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in USER_LETTERS]]
    return F.array(*[(c % m - 2).cast("double") for c, m in zip(count, USER_MODULI)])


def user_scorer() -> INF.UserScorer:
    dim = len(USER_MODULI)
    predict = residue_scorer(3, 0, 1.0, dim)
    return INF.UserScorer((0, 1, 2), lambda text: batch_score(text_features(text), predict, dim))


@query("infer_user_scorer")
def infer_user_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """M11 with the user's own classifier as model A: raw scores of an external model go into the vote."""
    train, _ = TR.split(TR.prepared(spark, sf))
    b = TR.bayes_model(train)
    return INF.infer_aspects(D.clauses(spark, sf), D.ranked_lexicon(spark, sf), user_scorer(), b, D.PROMPT_EN)


def _local_models(spark: SparkSession, sf: str) -> tuple[RL.LocalLexicon, RL.LocalBayes, RL.LocalBayes]:
    a, b = _models(spark, sf)
    ranked = TR.materialize(M.with_rank(D.ranked_lexicon(spark, sf)))
    return RL.LocalLexicon.of(ranked), RL.LocalBayes.of(a), RL.LocalBayes.of(b)


def _arriving(spark: SparkSession, sf: str) -> dict[str, str | None]:
    """The documents as a stream's source: the folder itself, or the one file of that name."""
    path = f"{sf.rstrip('/')}/documents.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return {"source_path": path, "glob": None} if folder else {"source_path": sf, "glob": "documents.parquet"}


def _spread(docs: DataFrame) -> DataFrame:
    """The documents over all tasks before their texts are split: files have as many partitions as they have splits, down to one."""
    return docs.select("doc_id", "text").repartition(FE.work_partitions(docs), "doc_id")


@query("stream_infer")
def stream_infer(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: the same inference over the documents arriving as a file stream: a row-local plan in append mode into a
    file sink with its commit log, no batch function, aggregate or state, no shuffle after the documents are spread."""
    lexicon, a, b = _local_models(spark, sf)

    def transform(docs: DataFrame) -> DataFrame:
        return RL.infer_rows(D.doc_clauses(_spread(docs)), lexicon, a, b, D.PROMPT_EN)

    root = scratch_path(spark, "stream")
    schema = D.table(spark, sf, "documents").schema
    return append_available(spark, schema=schema, transform=transform, sink_path=f"{root}/sink", checkpoint_path=f"{root}/checkpoint", **_arriving(spark, sf))


@query("infer_row_local")
def infer_row_local(spark: SparkSession, sf: str) -> DataFrame:
    """M11 with the row-local plan in a batch: one projection after another, no shuffle after the documents are spread."""
    lexicon, a, b = _local_models(spark, sf)
    return RL.infer_rows(D.doc_clauses(_spread(D.table(spark, sf, "documents"))), lexicon, a, b, D.PROMPT_EN)


@query("stream_infer_batches")
def stream_infer_batches(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 by micro-batch functions, for a lexicon or model beyond the literals' bound: joins and aggregates in each
    micro-batch, an idempotent sink."""
    a, b = _models(spark, sf)
    lexicon = TR.materialize(D.ranked_lexicon(spark, sf))
    schema = D.table(spark, sf, "documents").schema

    def transform(batch: DataFrame) -> DataFrame:
        return INF.infer_aspects(D.doc_clauses(_spread(batch)), lexicon, a, b, D.PROMPT_EN)

    root = scratch_path(spark, "stream")
    return run_available(spark, schema=schema, transform=transform, sink_path=f"{root}/sink", checkpoint_path=f"{root}/checkpoint", **_arriving(spark, sf))


def _all_hits(spark: SparkSession, sf: str, infer=INF.infer_all_hits) -> DataFrame:
    train, _ = TR.split(TR.prepared(spark, sf))
    a = TR.prompt_model(train)
    return infer(D.lines(spark, sf), M.lexicon_set(D.lexicon_lines(spark, sf)), a, "sentence", D.PROMPT_EN)


@query("infer_all_hits")
def infer_all_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every substring hit of every line, scored on its own prompt, lower-case label."""
    return _all_hits(spark, sf)


@query("aspect_map")
def aspect_map(spark: SparkSession, sf: str) -> DataFrame:
    """Per line, the map aspect -> label of all hits (rendered 'k=v;...')."""
    m = _all_hits(spark, sf, INF.all_hits_maps)
    return m.select(
        "doc_id", "line_no", F.size("aspect_map").alias("n_aspects"), INF.render_map(F.col("aspect_map")).alias("aspect_map")
    )

"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; ``run`` writes
every stage's result as Parquet in the shared folder and reads it again as the next one's ``docs``.
The language models are fitted on the labelled rows of the stage's own input. All stages but the last
return the columns of ``docs``; ``n_chars``, where there is one, follows the text.

Tables without rows go through all stages. A row with a null ``doc_id`` is handled as each operator states;
SimHash keeps such rows, as they have no component. Where rows repeat a ``doc_id``, SimHash keeps exactly one
row of each component: that of the smallest id, then fingerprint, then text. Rows of that id in other
components are judged by their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm import language_id, line_dedup, packing, simhash
from aspectra.llm.common import read_table, stash
from aspectra.llm.queries import WORD_VOCABULARY, mix_documents
from aspectra.llm.tokens import vocabulary_path

MIN_SCORE = 0.5  # posterior probability of the predicted language


def with_text_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter, or between languages, go."""
    out = language_id.identify(docs)
    sure = (F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_SCORE)
    return out.where(sure).select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that 3 documents share stay in the last of them only."""
    return with_text_length(line_dedup.dedup_lines(docs).select(*docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component of near-equal fingerprints, and rows without an id."""
    rows, _ = stash(simhash.near_duplicates(docs).where("id is not null"), "pipeline-groups")
    ids = rows.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.max("first").alias("_any"))
    repeated = ids.where("_any and _n > 1")
    # Where no id is repeated, an id stands for its row.
    if repeated.isEmpty():
        return docs.join(ids.where("not _any"), docs["doc_id"] == F.col("_id"), "left_anti")
    single = docs.join(ids.where("not _any or _n > 1"), docs["doc_id"] == F.col("_id"), "left_anti")
    some = docs.join(repeated, docs["doc_id"] == F.col("_id"), "left_semi").select(F.struct(*docs.columns).alias("_row"), "text")
    some = simhash.fingerprints(some, "_row").select("id.*", F.col("fp").alias("_fp"))
    firsts = rows.where("first").select(F.col("id").alias("_id"), F.col("fp").alias("_first")).distinct()
    some = some.join(firsts, (F.col("doc_id") == F.col("_id")) & (F.col("_fp") == F.col("_first")))
    # Of rows with the same id and fingerprint, the first by text, then by all columns.
    row = F.struct(*docs.columns)
    least = F.min_by(row, F.struct("text", F.to_json(row)))
    return single.unionByName(some.groupBy("doc_id", "_fp").agg(least.alias("_row")).select("_row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    return mix_documents(docs).where("kept").select("doc.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    pieces = packing.pack(docs, vocabulary_path(WORD_VOCABULARY), window=2048, end_id=1, pieces="words", with_ids=False, special_as_text=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# Language ID and the tokenizer can't be expressed in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

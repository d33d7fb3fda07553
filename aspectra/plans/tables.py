"""Inputs for the query catalogue, derived from the driver's tables.

The review files and the aspect lexicon of the original pipeline are not among
the driver's tables, so they are derived from them by fixed rules:

* lines    documents.text split on newlines, with position, non-blank.
* lexicon  every token and every adjacent token pair of lower-cased
           benchmark.text: the whole table, no cap and no length filter.
* triples  labelled lines with their main aspect; code -1 if toxic, 0 if low
           quality, else 1; raw sentence = lower-cased line with the aspect
           replaced by the placeholder. Hold-out rows: doc_id % 5 = 0.
* synonyms every distinct benchmark token -> the next token in sorted order
           (set 0) and, for every third token, the one after that (set 1);
           sorted within groups of the same first two characters.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.functions.text import strip_ws, word_runs
from aspectra.operators import clauses as C
from aspectra.operators import match as M
from aspectra.session import spread

# ---- fixed values for the driver's (English, French, German, Spanish) prose ----
CONNECTOR_GATE = (" and ", " that ", " with ", ",", ";")
CONNECTOR_SPLIT = (" and ", " that ", " with ", ",", ";", ".")
PROMPT_EN = "About aspect %s, %s"
TEST_FOLD = 5
SEED = 42
# ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, sentence): non-blank lines of every document."""
    return doc_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def doc_lines(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    out = docs.select("doc_id", *carry, F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "sentence"))
    return out.where(strip_ws(F.col("sentence")) != "")


def doc_clauses(docs: DataFrame) -> DataFrame:
    return C.explode_clauses(doc_lines(docs), "sentence", ["doc_id", "line_no"], CONNECTOR_GATE, CONNECTOR_SPLIT)


def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lexicon as a one-column text table (``value``), like a lexicon file."""
    bench = table(spark, sf_dir, "benchmark").select(word_runs(F.lower("text")).alias("t"))
    n = F.size("t")
    pairs = F.zip_with(
        F.slice("t", 1, F.greatest(n - 1, F.lit(0))),
        F.slice("t", 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return bench.select(F.explode(F.concat("t", pairs)).alias("value")).distinct()


def ranked_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lexicon_ranked(lexicon_lines(spark, sf_dir))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, clause_no, clause) with the driver-table connectors."""
    return C.explode_clauses(
        lines(spark, sf_dir), "sentence", ["doc_id", "line_no"], CONNECTOR_GATE, CONNECTOR_SPLIT
    )


def sentiment_code() -> F.Column:
    return (
        F.when(F.col("toxic") == 1, F.lit(-1)).when(F.col("quality") == 0, F.lit(0)).otherwise(F.lit(1))
    )


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, sentence with placeholder, aspect, sentiment code as text)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # Labels first, then lines: unlabelled documents are never split.
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(labels, "doc_id")
    labelled = doc_lines(docs, ["quality", "toxic"])
    carry = ["sentence", "quality", "toxic"]
    rows = M.main_word(labelled, "sentence", ["doc_id", "line_no"], ranked_lexicon(spark, sf_dir), carry=carry)
    return rows.select(
        "doc_id",
        "line_no",
        F.replace(F.lower("sentence"), F.col("aspect"), F.lit("$T$")).alias("sentence"),
        "aspect",
        sentiment_code().cast("string").alias("sentiment"),
    )


def is_test(col: str = "doc_id") -> F.Column:
    return F.col(col) % TEST_FOLD == 0


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, set_no, lemma) from benchmark tokens; see module doc."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(word_runs(F.lower("text"))).alias("word"))
    words = words.distinct().withColumn("grp", F.substring("word", 1, 2))
    w = Window.partitionBy("grp").orderBy("word")
    ranked = words.select(
        "word",
        F.row_number().over(w).alias("rn"),
        F.lead("word", 1).over(w).alias("next1"),
        F.lead("word", 2).over(w).alias("next2"),
    )
    set0 = ranked.where(F.col("next1").isNotNull()).select("word", F.lit(0).alias("set_no"), F.col("next1").alias("lemma"))
    set1 = ranked.where(F.col("next2").isNotNull() & (F.col("rn") % 3 == 1)).select(
        "word", F.lit(1).alias("set_no"), F.col("next2").alias("lemma")
    )
    return set0.unionByName(set1)

"""Catalogue entries for quoted TSV with rejects, the lexicon from a file, and the other two encodings of a text.

The files are written from the driver's tables inside each query: fields get tabs, quotes and line ends of
their own, and some records are spoilt in known ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.operators import features as FE
from aspectra.operators import match as M
from aspectra.plans import tables as D
from aspectra.plans import training as TR
from aspectra.plans.catalog import query
from aspectra.session import scratch_path
from aspectra.sources import files as S
from aspectra.sources.quoted import read_quoted

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("aspect", T.StringType()),
        T.StructField("sentiment", T.IntegerType()),
    ]
)


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's lines as one record whose fields need quotes."""
    docs = D.table(spark, sf, "documents").where("text is not null")
    text = F.replace(F.replace("text", F.lit(", "), F.lit("\t")), F.lit(". "), F.lit(' "." '))
    return docs.select(
        "doc_id",
        F.btrim(text, F.lit("\r\n")).alias("sentence"),
        F.concat(F.lit('the "'), F.coalesce("lang", F.lit("NA")), F.lit('"')).alias("aspect"),
        (F.col("doc_id") % 3 - 1).cast("int").alias("sentiment"),
    )


@query("read_tsv_quoted")
def read_tsv_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """Written and read with quotes: tabs, quotes and line ends inside fields come back."""
    path = scratch_path(spark, "tsv-quoted")
    S.write_tsv(_fields(spark, sf), path, quote=True)
    rows, _ = read_quoted(spark, path, SCHEMA)
    return rows


def _spoilt(spark: SparkSession, sf: str) -> str:
    """Records as text: by id a field too few, one too many, a sentiment that is no number, or as they should be."""
    path = scratch_path(spark, "tsv-spoilt")
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    f = _fields(spark, sf)
    number, sentence, aspect, code = (F.col("doc_id").cast("string"), q(F.col("sentence")), q(F.col("aspect")), F.col("sentiment").cast("string"))
    tab = F.lit("\t")
    whole = F.concat(number, tab, sentence, tab, aspect, tab)
    record = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(number, tab, q(F.concat(F.lit("short\t"), number)), tab, aspect))
        .when(F.col("doc_id") % 5 == 1, F.concat(number, tab, q(F.concat(F.lit("long\t"), number)), tab, aspect, tab, code, tab, F.lit("more")))
        .when(F.col("doc_id") % 5 == 2, F.concat(whole, F.lit("x"), code))
        .when(F.col("doc_id") % 5 == 3, F.concat(whole, F.lit("NA")))
        .otherwise(F.concat(whole, code))
    )
    f.select(record.alias("value")).write.text(path)
    return path


@query("tsv_quoted_kept")
def tsv_quoted_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The records of a partly spoilt file that fit the schema."""
    return read_quoted(spark, _spoilt(spark, sf), SCHEMA)[0]


@query("tsv_quoted_rejects")
def tsv_quoted_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The others, with the reason and what is wrong."""
    return read_quoted(spark, _spoilt(spark, sf), SCHEMA)[1].select("reason", "column", "value", "record")


def _file_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """The lexicon from a file of one phrase per line, with integer ranks; a table in the shared folder."""
    path = scratch_path(spark, "lexicon")
    D.lexicon_lines(spark, sf).write.text(path)
    return TR.materialize(M.with_rank(M.lexicon_ranked(S.read_lexicon(spark, path))))


@query("lexicon_from_file")
def lexicon_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """S6 from a file: phrases with their rank, longest first."""
    return _file_lexicon(spark, sf).select("keyword", "kw_len", (F.col("kw_rank") + 1).alias("rank_no"))


@query("main_aspect_ranked")
def main_aspect_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """J3 with a lexicon from a file: the smallest integer rank of a clause's hits, then its phrase."""
    lexicon = _file_lexicon(spark, sf)
    keys = ["doc_id", "line_no", "clause_no"]
    main = M.main_phrase(M.match_word(D.clauses(spark, sf), "clause", keys, lexicon), keys)
    return main.join(lexicon.select("kw_rank", F.col("keyword").alias("aspect")), "kw_rank").select(*keys, "aspect")


def _encoded(df: DataFrame) -> DataFrame:
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return df.select(*TR.KEYS, F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), attended.alias("n_attended"))


SHORT = 16  # a length that cuts many of the pairs


@query("encode_first")
def encode_first(spark: SparkSession, sf: str) -> DataFrame:
    """T17, only-first cut: what is too long is taken from the sentence."""
    tri = TR.prepared(spark, sf)
    vocab = FE.encode_vocabulary(tri, ["sentence", "aspect"])
    return _encoded(FE.encode_pairs(tri, "sentence", "aspect", TR.KEYS, vocab, SHORT, cut="first"))


@query("encode_single")
def encode_single(spark: SparkSession, sf: str) -> DataFrame:
    """T17, single text: the aspect prompt alone."""
    tri = TR.with_prompt(TR.prepared(spark, sf))
    return _encoded(FE.encode_texts(tri, "prompt", TR.KEYS, FE.encode_vocabulary(tri, ["prompt"])))

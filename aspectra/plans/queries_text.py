"""Catalogue entries for sources, row transforms, clauses and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions.text import strip_ws
from aspectra.operators import balance as BL
from aspectra.operators import clauses as C
from aspectra.operators import features as FE
from aspectra.operators import match as M
from aspectra.operators import prepare as P
from aspectra.plans import tables as D
from aspectra.plans.catalog import query
from aspectra.session import scratch_path
from aspectra.sources import files as S

KEYS = ["doc_id", "line_no"]
CKEYS = ["doc_id", "line_no", "clause_no"]


# ---------------------------------------------------------------- sources
@query("lexicon_set")
def lexicon_set(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicon phrases, case kept, distinct."""
    return M.lexicon_set(D.lexicon_lines(spark, sf))


@query("lexicon_ranked")
def lexicon_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-cased distinct lexicon, longest first (rank over a bounded table)."""
    lex = D.ranked_lexicon(spark, sf).select("keyword", "kw_len", "kw_first")
    # Rank without a single-task window: buckets follow the order (longest first,
    # then by the first characters), ranks inside buckets plus earlier bucket sizes.
    bucket = F.struct(-F.col("kw_len"), F.substring("keyword", 1, 2))
    ranked = BL.ordered_index(lex, [], bucket, [F.col("kw_len").desc(), F.col("keyword")], "rank0")
    return ranked.select("keyword", "kw_len", "kw_first", (F.col("rank0") + 1).alias("rank_no"))


@query("valid_triples")
def valid_triples(spark: SparkSession, sf: str) -> DataFrame:
    """S3: lines with ', ' turned into tabs; keep those with exactly three fields."""
    src = D.lines(spark, sf).select(*KEYS, F.replace("sentence", F.lit(", "), F.lit("\t")).alias("value"))
    return S.valid_triples(src, "value", KEYS)


@query("read_tsv")
def read_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + S2: write the valid triples as headerless TSV, read back with NA strings as null."""
    from pyspark.sql import types as T

    src = D.lines(spark, sf).select(*KEYS, F.replace("sentence", F.lit(", "), F.lit("\t")).alias("value"))
    rows = S.valid_triples(src, "value", KEYS)
    path = scratch_path(spark, "tsv")
    S.write_tsv(rows, path)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("line_no", T.LongType())] + list(S.TRIPLE_SCHEMA.fields)
    )
    return S.read_tsv(spark, path, schema)


FILE_DOCS = 100


def _raw_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as raw text files, one per ``FILE_DOCS`` ids in id order, then
    read back as numbered lines with the file's number taken from its path."""
    docs = D.table(spark, sf, "documents").select((F.col("doc_id") / FILE_DOCS).cast("bigint").alias("file_no"), "doc_id", "text")
    path = scratch_path(spark, "raw")
    sorted_docs = docs.repartition("file_no").sortWithinPartitions("file_no", "doc_id").select("file_no", "text")
    sorted_docs.write.mode("overwrite").partitionBy("file_no").text(path)
    lines = S.numbered_lines(spark, path)
    return lines.withColumn("file_no", F.regexp_extract("file", r"file_no=(\d+)", 1).cast("bigint"))


@query("read_three_line")
def read_three_line(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files read back as three-line records."""
    records, _ = S.three_line_records(_raw_files(spark, sf), ["file_no"])
    return records


@query("three_line_rejects")
def three_line_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """S1 rejects: trailing groups with fewer than three lines."""
    _, rejects = S.three_line_records(_raw_files(spark, sf), ["file_no"])
    return rejects.select("file_no", "rec_no", "n_lines", "sentence")


# ---------------------------------------------------------------- transforms
@query("mark_aspect")
def mark_aspect(spark: SparkSession, sf: str) -> DataFrame:
    """T1."""
    raw = D.raw_triples(spark, sf)
    return raw.select(*KEYS, P.mark_aspect(F.col("sentence"), F.col("aspect")).alias("marked"))


@query("format_triple")
def format_triple(spark: SparkSession, sf: str) -> DataFrame:
    """T2."""
    raw = D.raw_triples(spark, sf)
    return raw.select(*KEYS, P.format_triple(F.col("sentence"), F.col("aspect"), F.col("sentiment")).alias("line"))


@query("clean_text")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """T3 over document lines."""
    return D.lines(spark, sf).select(*KEYS, P.clean_text(F.col("sentence")).alias("cleaned"))


@query("clean_pages")
def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """T3 over page URLs and raw HTML (the only text with 'http')."""
    pages = D.table(spark, sf, "pages")
    return pages.select(
        "page_id", P.clean_text(F.col("url")).alias("url_clean"), P.clean_text(F.col("html")).alias("html_clean")
    )


@query("aspect_no_period")
def aspect_no_period(spark: SparkSession, sf: str) -> DataFrame:
    """T4 (applied to every line, the aspects having no periods)."""
    return D.lines(spark, sf).select(*KEYS, P.remove_periods(F.col("sentence")).alias("no_period"))


def _coded_labels(spark: SparkSession, sf: str) -> DataFrame:
    lab = D.table(spark, sf, "labels")
    return lab.select("doc_id", (F.col("quality") * 2 + F.col("toxic") - 1).alias("code"), "quality", "toxic")


@query("remap_label")
def remap_label(spark: SparkSession, sf: str) -> DataFrame:
    """T5: codes -1..2 from labels; 2 is out of range and maps to null."""
    lab = _coded_labels(spark, sf)
    return lab.select("doc_id", "code", P.remap_label(F.col("code")).alias("sentiment"))


@query("decode_label")
def decode_label(spark: SparkSession, sf: str) -> DataFrame:
    """Class 0..3 -> lower-case label (3 falls into the catch-all)."""
    lab = _coded_labels(spark, sf)
    cls = F.col("code") + 1
    return lab.select("doc_id", cls.alias("cls"), P.decode_label(cls).alias("label"))


@query("decode_label_title")
def decode_label_title(spark: SparkSession, sf: str) -> DataFrame:
    """Class 0..3 -> title-case label, other catch-all than T6."""
    lab = _coded_labels(spark, sf)
    cls = F.col("code") + 1
    return lab.select("doc_id", cls.alias("cls"), P.decode_label_title(cls).alias("label"))


def _nullable_labels(spark: SparkSession, sf: str) -> DataFrame:
    lab = _coded_labels(spark, sf)
    return lab.select(
        "doc_id",
        P.remap_label(F.col("code")).alias("sentiment"),
        F.nullif(F.col("quality"), F.lit(0)).alias("quality"),
        "toxic",
    )


@query("null_profile")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Null count per column in one pass."""
    return P.null_profile(_nullable_labels(spark, sf))


@query("drop_nulls")
def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """T9."""
    return P.drop_nulls(_nullable_labels(spark, sf))


@query("strip_ws")
def strip_ws_q(spark: SparkSession, sf: str) -> DataFrame:
    """T10 on every raw line (blank ones included)."""
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return raw.select(*KEYS, strip_ws(F.col("line")).alias("stripped"))


@query("prepare_triples")
def prepare_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Entry 1 end to end: raw triples -> final (sentence, aspect, sentiment)."""
    return P.prepare_triples(D.raw_triples(spark, sf), keys=KEYS)


# ---------------------------------------------------------------- clauses
@query("clause_gate")
def clause_gate(spark: SparkSession, sf: str) -> DataFrame:
    """T12."""
    return D.lines(spark, sf).select(*KEYS, C.clause_gate(F.col("sentence"), D.CONNECTOR_GATE).alias("gate"))


@query("split_clauses")
def split_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """T13 on every line (no gate): sequential split, strip, no blanks."""
    parts = C.split_clauses(F.col("sentence"), D.CONNECTOR_SPLIT)
    return D.lines(spark, sf).select(*KEYS, F.posexplode(parts).alias("clause_no", "clause"))


def _main_aspects(spark: SparkSession, sf: str) -> DataFrame:
    cl = D.clauses(spark, sf)
    hits = M.match_word(cl, "clause", CKEYS, D.ranked_lexicon(spark, sf), carry=["clause"])
    return M.main_aspect(hits, CKEYS, carry=["clause"])


@query("aspect_prompt")
def aspect_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """T14 on every clause with a main aspect."""
    main = _main_aspects(spark, sf)
    return main.select(*CKEYS, C.aspect_prompt(F.col("aspect"), F.col("clause"), D.PROMPT_EN).alias("prompt"))


# ---------------------------------------------------------------- matching
@query("match_substring")
def match_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Every lexicon phrase contained in the line, case-sensitive."""
    return M.match_substring(D.lines(spark, sf), "sentence", KEYS, M.lexicon_set(D.lexicon_lines(spark, sf)))


@query("match_word")
def match_word(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole-word hit in the lower-cased line."""
    hits = M.match_word(D.lines(spark, sf), "sentence", KEYS, D.ranked_lexicon(spark, sf))
    return hits.select(*KEYS, "keyword")


@query("main_aspect")
def main_aspect(spark: SparkSession, sf: str) -> DataFrame:
    """Longest whole-word hit per clause."""
    return _main_aspects(spark, sf).select(*CKEYS, "aspect")


@query("clauses_without_aspect")
def clauses_without_aspect(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses that found no aspect."""
    return M.without_aspect(D.clauses(spark, sf), _main_aspects(spark, sf), CKEYS)


@query("aspect_counts")
def aspect_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: which aspects people write about, per clause."""
    # Only the aspect is needed: no clause text is carried through the per-clause aggregate.
    hits = M.match_word(D.clauses(spark, sf), "clause", CKEYS, D.ranked_lexicon(spark, sf))
    main = M.main_aspect(hits, CKEYS)
    return main.groupBy("aspect").agg(
        F.count(F.lit(1)).alias("n_clauses"), F.count_distinct("doc_id").alias("n_docs")
    )

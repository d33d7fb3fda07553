"""Preparation of annotated triples: mark-up, cleaning, label codes, nulls.

Every step is a column expression or a one-pass aggregate; chained steps
collapse into one projection under whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import WORD_CLASS, WS_CLASS, strip_ws

# ---- fixed values -------------------------------------------------------
# Placeholder for the aspect in raw review sentences and the mark-up put in its place.
PLACEHOLDER = "$T$"
ASPECT_OPEN = "<aspect> "
ASPECT_CLOSE = " </aspect>"
# Punctuation kept by the cleaner besides word characters and whitespace.
KEEP_PUNCT = ",.!?:;<>/"
# Raw sentiment code -> model class.
RAW_TO_CLASS = {-1: 0, 0: 1, 1: 2}
# Class -> label, lower case (anything but 0 and 1 is positive).
LABELS_LOWER = ("negative", "neutral", "positive")
# Class -> label, title case (anything but 2 and 1 is Negative).
LABELS_TITLE = ("Negative", "Neutral", "Positive")
# Strings the pandas CSV reader turns into NaN by default.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# -------------------------------------------------------------------------


def mark_aspect(sentence: Column, aspect: Column) -> Column:
    """Every literal placeholder -> '<aspect> A </aspect>' (literal, not regex)."""
    return F.replace(sentence, F.lit(PLACEHOLDER), F.concat(F.lit(ASPECT_OPEN), aspect, F.lit(ASPECT_CLOSE)))


def format_triple(*cols: Column) -> Column:
    """Tab-joined line."""
    return F.concat_ws("\t", *cols)


def clean_text(col: Column) -> Column:
    """Drop runs of '*', '#'-words, 'http'-words, then every character that is
    not a word character, whitespace or one of KEEP_PUNCT (in that order)."""
    out = F.regexp_replace(col, r"\*+", "")
    out = F.regexp_replace(out, f"#[^{WS_CLASS}]+", "")
    out = F.regexp_replace(out, f"http[^{WS_CLASS}]+", "")
    return F.regexp_replace(out, f"[^{WORD_CLASS}{WS_CLASS}{KEEP_PUNCT}]", "")


def remove_periods(col: Column) -> Column:
    return F.replace(col, F.lit("."), F.lit(""))


def remap_label(code: Column) -> Column:
    """-1 -> 0, 0 -> 1, 1 -> 2, anything else -> null."""
    out = None
    for raw, cls in RAW_TO_CLASS.items():
        out = (F.when(code == raw, F.lit(cls)) if out is None else out.when(code == raw, F.lit(cls)))
    return out.cast("int")


def decode_label(cls: Column) -> Column:
    return F.when(cls == 0, LABELS_LOWER[0]).when(cls == 1, LABELS_LOWER[1]).otherwise(LABELS_LOWER[2])


def decode_label_title(cls: Column) -> Column:
    return F.when(cls == 2, LABELS_TITLE[2]).when(cls == 1, LABELS_TITLE[1]).otherwise(LABELS_TITLE[0])


def na_to_null(col: Column, na_strings: Sequence[str] = NA_STRINGS) -> Column:
    return F.when(col.isin(list(na_strings)), F.lit(None)).otherwise(col)


def three_fields(line: Column) -> Column:
    """Fields of ``line.strip().split('\\t')`` when there are exactly three, else null."""
    parts = F.split(strip_ws(line), "\t")
    return F.when(F.size(parts) == 3, parts)


def once(df: DataFrame, keys: Sequence[str], *cols: Column) -> DataFrame:
    """keys + cols, each expression evaluated exactly once per row.

    A later filter on a plain projection is pushed below it with the column's
    whole expression substituted, so an expensive expression (regex cleaning)
    would run again inside every filter. Columns produced by a generator
    (``inline`` of a one-element array) cannot be substituted that way.
    """
    return df.select(*keys, F.inline(F.array(F.struct(*cols))))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count per column in one pass: rows (column_name, null_count)."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def prepare_triples(
    raw: DataFrame,
    sentence: str = "sentence",
    aspect: str = "aspect",
    sentiment: str = "sentiment",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Whole preparation chain on raw (sentence with placeholder, aspect, code) rows.

    mark-up -> tab line -> 3-field check -> clean both texts -> tab line ->
    3-field check -> periods out of the aspect -> NA strings -> code remap ->
    drop rows with any null. Output: keys + (sentence, aspect, sentiment INT).
    """
    k = [F.col(c) for c in keys]
    line1 = format_triple(mark_aspect(F.col(sentence), F.col(aspect)), F.col(aspect), F.col(sentiment))
    step = once(raw, keys, F.split(strip_ws(line1), "\t").alias("f")).where(F.size("f") == 3)
    line2 = format_triple(clean_text(F.col("f")[0]), clean_text(F.col("f")[1]), F.col("f")[2])
    step = once(step, keys, F.split(strip_ws(line2), "\t").alias("f")).where(F.size("f") == 3)
    typed = step.select(
        *k,
        na_to_null(F.col("f")[0]).alias("sentence"),
        na_to_null(remove_periods(F.col("f")[1])).alias("aspect"),
        remap_label(F.col("f")[2].try_cast("int")).alias("sentiment"),
    )
    return drop_nulls(typed, ["sentence", "aspect", "sentiment"])

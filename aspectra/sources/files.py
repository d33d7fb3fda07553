"""File sources and sinks: three-line annotation files, headerless TSV, lexicon
files, and numbered text lines.

Line numbers of text files are computed without a single-task window: each
line gets its offset inside its file split (monotonic id minus the split's
smallest id) plus the number of lines in earlier splits of the same file,
taken from a table with one row per split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.text import strip_ws
from aspectra.operators.match import sized_broadcast
from aspectra.operators.prepare import NA_STRINGS, na_to_null, three_fields

TRIPLE_SCHEMA = T.StructType(
    [
        T.StructField("sentence", T.StringType()),
        T.StructField("aspect", T.StringType()),
        T.StructField("sentiment", T.StringType()),
    ]
)
# Largest split table (rows = file splits) broadcast back to the lines.
BROADCAST_SPLIT_ROWS = 1_000_000


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line_no, value) for every line of the text files, line_no from 0."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_mid"),
        "value",
    )
    splits = raw.groupBy("file", "block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    splits, _ = sized_broadcast(splits, BROADCAST_SPLIT_ROWS)
    out = raw.join(splits, ["file", "block"])
    return out.select("file", (F.col("_offset") + F.col("_mid") - F.col("_first")).alias("line_no"), "value")


def three_line_records(lines: DataFrame, group_cols: Sequence[str] = ("file",)) -> tuple[DataFrame, DataFrame]:
    """Group numbered lines (line_no from 0) into (sentence, aspect, sentiment)
    records of three consecutive stripped lines.

    Returns (records, rejects); a trailing group with fewer than three lines is a reject.
    """
    g = list(group_cols)
    rec = lines.select(
        *g, (F.col("line_no") / 3).cast("bigint").alias("rec_no"), (F.col("line_no") % 3).alias("k"), "value"
    )
    agg = rec.groupBy(*g, "rec_no").agg(
        F.max(F.when(F.col("k") == 0, strip_ws(F.col("value")))).alias("sentence"),
        F.max(F.when(F.col("k") == 1, strip_ws(F.col("value")))).alias("aspect"),
        F.max(F.when(F.col("k") == 2, strip_ws(F.col("value")))).alias("sentiment"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    records = agg.where(F.col("n_lines") == 3).drop("n_lines")
    rejects = agg.where(F.col("n_lines") < 3)
    return records, rejects


def read_three_line(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return three_line_records(numbered_lines(spark, path), ["file"])


def valid_triples(lines: DataFrame, col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines that split into exactly three tab-separated fields after stripping."""
    f = three_fields(F.col(col))
    out = lines.select(*keep, f.alias("_f")).where(F.col("_f").isNotNull())
    return out.select(
        *keep, F.col("_f")[0].alias("sentence"), F.col("_f")[1].alias("aspect"), F.col("_f")[2].alias("sentiment")
    )


def write_tsv(df: DataFrame, path: str, quote: bool = False) -> None:
    """Headerless TSV. ``quote=False`` writes fields as they are, joined by tabs;
    ``quote=True`` quotes where needed and doubles quotes inside, as data-frame
    libraries do, so tabs, quotes and line ends in a field survive."""
    if not quote:
        fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
        df.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)
        return
    w = df.write.mode("overwrite").option("sep", "\t").option("header", "false").option("escape", '"')
    w = w.option("emptyValue", "").option("nullValue", "").option("lineSep", "\n")
    w.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def read_tsv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = TRIPLE_SCHEMA,
    quote: bool = False,
    na_strings: Sequence[str] = NA_STRINGS,
) -> DataFrame:
    """Headerless TSV with an explicit schema; NA strings become null in string columns."""
    r = spark.read.schema(schema).option("sep", "\t").option("header", "false").option("mode", "PERMISSIVE")
    r = r.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("lineSep", "\n")
    r = r.option("escape", '"').option("multiLine", "true") if quote else r.option("quote", "")
    df = r.csv(path)
    cols = [
        na_to_null(F.col(f.name), na_strings).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in schema.fields
    ]
    return df.select(*cols)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon file, one phrase per line, as a text table (``value``)."""
    return spark.read.text(path)

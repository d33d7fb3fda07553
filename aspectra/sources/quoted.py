"""Headerless TSV with quoted fields, as data-frame libraries write it: fields may hold tabs, doubled quotes and line ends.

Every record goes one of two ways: into the table, typed, or to the rejects, with its file, its text as read and
the reason. A reject is a record with another number of fields than the schema, or with a value that is not of its
column's type. Strings that stand for a missing value become null first, in columns of all types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.operators.prepare import NA_STRINGS, na_to_null

RAW = "_record"
FIELDS = "fields"


def _records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """All records as text fields; ``_record`` is the text of one whose fields don't fit, null otherwise."""
    fields = [T.StructField(f.name, T.StringType()) for f in schema.fields]
    reader = spark.read.schema(T.StructType([*fields, T.StructField(RAW, T.StringType())]))
    options = {
        "sep": "\t", "header": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW, "quote": '"', "escape": '"', "multiLine": "true",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n", "maxCharsPerColumn": "-1",
        # Fields that a query doesn't need have to be read too, or a wrong number of them would go unnoticed.
        "columnPruning": "false",
    }
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file"))


def read_quoted(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, na_strings: Sequence[str] = NA_STRINGS
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): typed rows of ``schema``, and (file, reason, column, value, record) of the others. ``reason`` is
    ``fields`` for a wrong number of them (``record`` is the text), else the type that ``value`` in ``column`` isn't of."""
    records = _records(spark, path, schema)
    present = {f.name: na_to_null(F.col(f"`{f.name}`"), na_strings) for f in schema.fields}
    typed = {f.name: present[f.name].try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else present[f.name] for f in schema.fields}
    other = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    wrong = F.lit(None).cast("struct<reason:string,column:string,value:string>")
    for f in reversed(other):
        fails = present[f.name].isNotNull() & typed[f.name].isNull()
        told = F.struct(F.lit(f.dataType.simpleString()).alias("reason"), F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("value"))
        wrong = F.when(fails, told).otherwise(wrong)
    none = F.lit(None).cast("string")
    fault = F.when(F.col(RAW).isNotNull(), F.struct(F.lit(FIELDS).alias("reason"), none.alias("column"), none.alias("value"))).otherwise(wrong)
    judged = records.withColumn("_fault", fault)
    rows = judged.where("_fault is null").select(*[c.alias(name) for name, c in typed.items()])
    rejects = judged.where("_fault is not null").select(F.col("_file").alias("file"), "_fault.*", F.rtrim(F.col(RAW), F.lit("\r\n")).alias("record"))
    return rows, rejects

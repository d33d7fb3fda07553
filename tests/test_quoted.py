"""Quoted TSV with rejects, and the encodings of pairs and single texts."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import types as T

from aspectra.operators import features as FE
from aspectra.sources import files as S
from aspectra.sources.quoted import read_quoted

SCHEMA = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType())])


def found(spark, path):
    rows, rejects = read_quoted(spark, str(path), SCHEMA)
    return sorted(map(tuple, rows.collect()), key=repr), sorted(map(tuple, rejects.drop("file").collect()), key=repr)


def test_every_record_is_a_row_or_a_reject(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_bytes(
        b'plain\t1\t0.5\n'
        b'"tab\there"\t2\t1\n'
        b'"line\nend"\t3\t1e3\n'
        b'"say ""hi"""\t4\t-1\n'
        b'\t5\t\n'
        b'NA\tnull\tnan\n'
        b'two\t6\n'
        b'four\t7\t1\tmore\n'
        b'"quoted\ttwo\nlines"\t8\n'
        b'word\tseven\t1\n'
        b'word\t9.5\t1\n'
        b'word\t10\tone\n'
        b'both\tx\ty\n'
        b'  spaces  \t11\t1\n'
    )
    rows, rejects = found(spark, p)
    assert rows == sorted([
        ("plain", 1, 0.5), ("tab\there", 2, 1.0), ("line\nend", 3, 1000.0), ('say "hi"', 4, -1.0), (None, 5, None), (None, None, None), ("  spaces  ", 11, 1.0),
    ], key=repr)
    assert rejects == sorted([
        ("fields", None, None, "two\t6"), ("fields", None, None, "four\t7\t1\tmore"), ("fields", None, None, '"quoted\ttwo\nlines"\t8'),
        ("int", "n", "seven", None), ("int", "n", "9.5", None), ("double", "x", "one", None), ("int", "n", "x", None),
    ], key=repr)


def test_what_a_query_selects_does_not_change_the_rejects(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("a\t1\t2\nb\t1\nc\t2\t3\t4\n")
    rows, rejects = read_quoted(spark, str(p), SCHEMA)
    assert rows.select("s").collect() == [("a",)] and rows.count() == 1
    assert rejects.count() == 2 and {r[0] for r in rejects.select("reason").collect()} == {"fields"}
    assert rejects.first()["file"].endswith("a.tsv")


def test_empty_files_and_folders_of_several(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.tsv").write_text("")
    assert found(spark, tmp_path / "f") == ([], [])
    (tmp_path / "f" / "2.tsv").write_text("a\t1\t2\n")
    (tmp_path / "f" / "3.tsv").write_text('"b\n"\t1\t2')
    assert found(spark, tmp_path / "f") == ([("a", 1, 2.0), ("b\n", 1, 2.0)], [])


def test_files_of_data_frame_libraries_and_our_own(spark, tmp_path):
    values = [("a\tb", 1, 0.5), ('"', 2, 1.0), ("x\ny\n\nz", 3, -2.5), ("é " * 50_000, 4, 1.0)]
    theirs, ours = tmp_path / "theirs.tsv", str(tmp_path / "ours")
    pd.DataFrame(values).to_csv(theirs, sep="\t", header=False, index=False)
    S.write_tsv(spark.createDataFrame(values, SCHEMA), ours, quote=True)
    for p in (theirs, ours):
        assert found(spark, p) == (sorted(values, key=repr), [])


WORDS = "a b c d e f g h"


@pytest.mark.parametrize("first,second,want", [
    ("a b", "c", [0, 4, 5, 2, 2, 6, 2, 1, 1, 1]), (WORDS, "c", [0, 4, 5, 6, 7, 8, 2, 2, 6, 2]), (WORDS, "a b c d e", [0, 4, 2, 2, 4, 5, 6, 7, 8, 2]),
    ("a b c", WORDS, [0, 2, 2, 4, 5, 6, 7, 8, 9, 2]), ("", "", [0, 2, 2, 2, 1, 1, 1, 1, 1, 1]), (None, "a", [0, 2, 2, 4, 2, 1, 1, 1, 1, 1]),
])
def test_only_first_cut(spark, first, second, want):
    vocab = spark.createDataFrame([(w, 4 + i) for i, w in enumerate(WORDS.split())], "word string, token_id int")
    df = spark.createDataFrame([(1, first, second)], "row long, a string, b string")
    got = FE.encode_pairs(df, "a", "b", ["row"], vocab, 10, cut="first").first()
    assert got["input_ids"] == want and sum(got["attention_mask"]) == sum(i != 1 for i in want)


def test_single_texts(spark):
    vocab = spark.createDataFrame([(w, 4 + i) for i, w in enumerate(WORDS.split())], "word string, token_id int")
    df = spark.createDataFrame([(1, "a zz b"), (2, WORDS), (3, None), (4, " ")], "row long, t string")
    got = {r["row"]: r["input_ids"] for r in FE.encode_texts(df, "t", ["row"], vocab, 6).collect()}
    assert got == {1: [0, 4, 3, 5, 2, 1], 2: [0, 4, 5, 6, 7, 2], 3: [0, 2, 1, 1, 1, 1], 4: [0, 2, 1, 1, 1, 1]}

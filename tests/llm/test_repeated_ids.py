"""The pipeline's SimHash stage where rows share an id."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.conftest import SF001


def test_one_row_of_each_component_stays(spark):
    rnd = random.Random(5)
    a, b, c, d = (" ".join(rnd.choices(["red", "blue", "stone", "river", "cloud", "seven", "lamp", "green"], k=60)) for _ in range(4))
    rows = [
        (1, a, "x"), (1, a, "y"), (1, a, "x"),  # the smallest id, three times
        (2, a, "x"), (2, b, "x"),  # a copy of 1, and a text of its own
        (3, b, "x"),
        (1, c, "x"), (4, c, "x"),  # id 1 in another component
        (5, d, "x"), (None, d, "x"), (None, d, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, SF001)
    assert out.columns == docs.columns
    want = [(1, a, "x"), (1, c, "x"), (2, b, "x"), (5, d, "x"), (None, d, "x"), (None, d, "x")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_column_names_that_need_quotes_and_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 1), (1, "a b c d e", 2), (2, "v w x y z", 3)], "doc_id long, text string, `_row <id>` int")
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, SF001)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a b c d e", 1), (2, "v w x y z", 3)]

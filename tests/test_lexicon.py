"""The derived lexicon against plain Python over the whole benchmark table."""

from __future__ import annotations

import re

from aspectra.plans import tables as D
from tests.conftest import SF001


def test_lexicon_has_every_token_and_pair(spark):
    want = set()
    for r in D.table(spark, SF001, "benchmark").collect():
        t = re.findall(r"\w+", r["text"].lower())
        want.update(t)
        want.update(f"{a} {b}" for a, b in zip(t, t[1:]))
    got = [r["value"] for r in D.lexicon_lines(spark, SF001).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_word_inside_an_item_is_an_aspect(spark, tmp_path):
    spark.createDataFrame([(1, "the new battery")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a battery\nof the day")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import __spark_entry__ as E

    hits = E.queries()["match_word"](spark, str(tmp_path)).collect()
    assert {(r["line_no"], r["keyword"]) for r in hits} == {(0, "battery"), (1, "the")}

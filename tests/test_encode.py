"""Pair encoding: ids of a vocabulary ranked in ranges, one look-up for both texts."""

import pytest

from aspectra.operators import features as FE
from tests.conftest import rows

SCHEMA = "id long, part int, a string, b string"
DATA = [(1, 0, "x y z", "y"), (1, 1, "", "w x"), (2, 0, None, None), (2, 0, "z z", "q"), (None, 0, "x", "y"), (3, 0, "unseen words x", "")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_vocabulary_of_one_count_is_ranked_in_ranges(spark, partitions):
    words = [f"w{i:04d}" for i in range(900)]
    df = spark.createDataFrame([(" ".join(words[i::9]), "often often w0007") for i in range(9)], "a string, b string").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        vocab = FE.encode_vocabulary(df, ["a", "b"])
        got = {r["word"]: r["token_id"] for r in vocab.collect()}
        few = {r["word"]: r["token_id"] for r in FE.encode_vocabulary(df, ["a", "b"], 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    ranked = ["often", "w0007", *[w for w in words if w != "w0007"]]
    assert got == {w: i + FE.UNK_ID + 1 for i, w in enumerate(ranked)}
    assert few == {w: i + FE.UNK_ID + 1 for i, w in enumerate(ranked[:5])}
    # No window over the words of a count: they would be one task's.
    assert "partitionBy" not in plan_of(vocab) and "row_number" not in plan_of(vocab)


def test_rows_that_share_keys_or_have_none(spark):
    """Every row gets the ids of all rows with its keys, by position; a null key has none."""
    df = spark.createDataFrame(DATA, SCHEMA)
    vocab = spark.createDataFrame([("x", 4), ("y", 5), ("z", 6), ("w", 7), ("q", 8)], "word string, token_id int")
    got = FE.encode_pairs(df, "a", "b", ["id", "part"], vocab, 9)
    ids = sorted(((r["id"] is not None, r["id"], r["part"], list(r["input_ids"])) for r in got.collect()))
    two = [0, 6, 6, 2, 2, 8, 2, 1, 1]
    assert ids == [
        (False, None, 0, [0, 2, 2, 2, 1, 1, 1, 1, 1]),
        (True, 1, 0, [0, 4, 5, 6, 2, 2, 5, 2, 1]), (True, 1, 1, [0, 2, 2, 7, 4, 2, 1, 1, 1]),
        (True, 2, 0, two), (True, 2, 0, two), (True, 3, 0, [0, 3, 3, 4, 2, 2, 2, 1, 1]),
    ]
    assert rows(FE.encode_texts(df.where("id = 3"), "a", ["id"], vocab, 4), "input_ids") == [([0, 3, 3, 2],)]


def test_words_are_looked_up_once_and_not_shuffled(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    plan = plan_of(FE.encode_pairs(df, "a", "b", ["id"], FE.encode_vocabulary(df, ["a", "b"])))
    assert plan.count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(word" not in plan and plan.count("Generate posexplode") == 1

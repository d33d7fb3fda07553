"""Text semantics on the JVM against plain Python str / re."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from aspectra.functions import text as TX
from aspectra.operators import clauses as C
from aspectra.operators import prepare as P

SAMPLES = [
    "  Sản phẩm tốt  ",
    "\tgiao hàng\r\n",
    "***wow*** #tag # lone http://x.y/z h$ttp (paren) 😀 ok!",
    unicodedata.normalize("NFD", "Sản phẩm chính hãng"),
    unicodedata.normalize("NFC", "Sản phẩm chính hãng"),
    "a song nhưng b",
    "",
    "   ",
    "x y　z",
    "tab\tinside, comma; semi. dot",
]


def _df(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s string")


def test_strip_and_split_match_python(spark):
    df = _df(spark, SAMPLES)
    got = {r["id"]: (r["st"], list(r["ws"])) for r in df.select("id", TX.strip_ws(F.col("s")).alias("st"), TX.split_ws(F.col("s")).alias("ws")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == (s.strip(), s.split()), s


CLEANED = [
    ("**bold** and *", "bold and "),
    ("see #tag, # alone", "see   alone"),
    ("go http://x.y/z now", "go  now"),
    ("h$ttp (a) [b]", "http a b"),
    ("50% off! ok? a/b <c> d:e;f", "50 off! ok? a/b <c> d:e;f"),
    ("tốt 😀 quá", "tốt  quá"),
    ("", ""),
]


def test_clean_text(spark):
    got = {r["id"]: r["c"] for r in _df(spark, [a for a, _ in CLEANED]).select("id", P.clean_text(F.col("s")).alias("c")).collect()}
    assert [got[i] for i in range(len(CLEANED))] == [b for _, b in CLEANED]


SPLIT = [
    ("a song nhưng b", ["a song", "b"]),  # each delimiter is literal, with its blanks
    ("x, y; z", ["x", "y", "z"]),
    ("x nhưng y song z", ["x", "y", "z"]),
    (" , ; ", []),
    ("xnhưngy", ["xnhưngy"]),
    ("một. hai. ba", ["một", "hai", "ba"]),
    ("", []),
]


def test_sequential_split(spark):
    got = {r["id"]: list(r["p"]) for r in _df(spark, [a for a, _ in SPLIT]).select("id", C.split_clauses(F.col("s")).alias("p")).collect()}
    assert [got[i] for i in range(len(SPLIT))] == [b for _, b in SPLIT]


def test_gate_excludes_period(spark):
    df = _df(spark, ["Chỉ có. dấu chấm.", "a, b", "x NHƯNG y"])
    got = dict(df.select("id", C.clause_gate(F.col("s")).alias("g")).collect())
    assert got == {0: False, 1: True, 2: True}
    clauses = C.explode_clauses(df, "s", ["id"]).where("id = 0").collect()
    assert [r["clause"] for r in clauses] == ["chỉ có. dấu chấm."]


def test_token_marking_equals_word_boundary_search(spark):
    rng = random.Random(3)
    words = ["giá", "đánh", "giao", "hàng", "gia", "tốt", "a_b", "x1", "sản", "phẩm"]
    seps = [" ", ", ", "-", ".", "  "]
    sentences = [
        "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 6))).strip() for _ in range(200)
    ]
    keywords = ["giá", "đánh giá", "gia", "giao hàng", "hàng", "sản phẩm", "a_b"]
    df = _df(spark, sentences)
    kw = spark.createDataFrame([(k,) for k in keywords], "k string")
    pairs = df.crossJoin(kw).select(
        "id", "k", F.contains(TX.mark_tokens(F.col("s")), TX.mark_tokens(F.col("k"))).alias("hit")
    )
    got = {(r["id"], r["k"]): r["hit"] for r in pairs.collect()}
    for i, s in enumerate(sentences):
        for k in keywords:
            assert got[(i, k)] == bool(re.search(rf"\b{k}\b", s)), (s, k)


def test_vectorizer_tokens_and_ngrams(spark):
    s = "Hello, World! a bb ccc_1 Đánh giá"
    df = _df(spark, [s])
    r = df.select(TX.vectorizer_tokens(F.col("s")).alias("t")).select("t", TX.ngrams(F.col("t"), 1, 3).alias("g")).first()
    tokens = re.findall(r"(?u)\b\w\w+\b", s.lower())
    assert list(r["t"]) == tokens
    expected = []
    for n in (1, 2, 3):
        expected += [" ".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]
    assert list(r["g"]) == expected


def test_broadcasts_are_decided_on_measured_bytes(spark):
    from aspectra.operators.match import SURE_ROWS, sized_broadcast

    terms = spark.range(100).selectExpr("repeat(cast(id as string), 500) as term", "array(0.5D, null) as lp")
    assert sized_broadcast(terms, 1000)[1] and sized_broadcast(terms, 1000, bound=100, max_bytes=10)[1]
    assert not sized_broadcast(terms, 99)[1]
    # A bound beyond the sure one doesn't stand for the bytes.
    assert not sized_broadcast(terms, 10 * SURE_ROWS, bound=2 * SURE_ROWS, max_bytes=50_000)[1]
    assert sized_broadcast(terms.limit(0), 10)[1]

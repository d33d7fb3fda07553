"""Clauses and aspects of made-up sentences, expected rows worked out by hand, with
the default (Vietnamese) connectors."""

from __future__ import annotations

from aspectra.operators import clauses as C
from aspectra.operators import match as M

SENTENCES = [
    "Màn hình đẹp nhưng pin yếu song giá rẻ",  # two connectors
    "Loa hay, vỏ xấu, pin khỏe",  # the middle clause has no aspect
    "Pin tốt. Loa tốt.",  # a period alone doesn't split
    "Loa đỏ và pin đỏ",  # two hits of equal length: the smaller one
    "Thời lượng pin ổn",  # a keyword inside another
    "nhưng máy êm, ",  # connectors at both ends, blank parts
]
LEXICON = ["Màn hình", "pin", "PIN", "loa", "giá", "thời lượng pin", "máy", "áy ê"]
EXPECTED = [
    (0, 0, "màn hình đẹp", "màn hình"),
    (0, 1, "pin yếu", "pin"),
    (0, 2, "giá rẻ", "giá"),
    (1, 0, "loa hay", "loa"),
    (1, 2, "pin khỏe", "pin"),
    (2, 0, "pin tốt. loa tốt.", "loa"),
    (3, 0, "loa đỏ và pin đỏ", "loa"),
    (4, 0, "thời lượng pin ổn", "thời lượng pin"),
]


def table(spark, values, name="s"):
    return spark.createDataFrame(list(enumerate(values)), f"row bigint, {name} string")


def lexicon(spark, words):
    return spark.createDataFrame([(w,) for w in words], "value string")


def test_golden_clauses_and_aspects(spark):
    clauses = C.explode_clauses(table(spark, SENTENCES), "s", ["row"])
    hits = M.match_word(clauses, "clause", ["row", "clause_no"], M.lexicon_ranked(lexicon(spark, LEXICON)), carry=["clause"])
    main = M.main_aspect(hits, ["row", "clause_no"], carry=["clause"])
    got = sorted((r["row"], r["clause_no"], r["clause"], r["aspect"]) for r in main.collect())
    assert [g for g in got if g[0] < 5] == EXPECTED
    assert [g[3] for g in got if g[0] == 5] == ["máy"]
    dropped = M.without_aspect(clauses, main, ["row", "clause_no"]).collect()
    assert [(r["row"], r["clause"]) for r in dropped] == [(1, "vỏ xấu")]


EDGES = ["a c++ b", "c++b", "x+y + z", "+", "", "++", "ab c", "日本語 c+"]
EDGE_WORDS = ["", "c++", "+", "b", "日本", "ab c", "語", "c+", " "]


def test_substring_hits_are_the_same_on_both_paths(spark):
    df, lex = table(spark, EDGES), M.lexicon_set(lexicon(spark, EDGE_WORDS))
    want = sorted((i, k) for i, s in enumerate(EDGES) for k in EDGE_WORDS if k in s)
    for bound in (1000, 1):
        assert sorted(map(tuple, M.match_substring(df, "s", ["row"], lex, bound).collect())) == want
    plan = M.match_substring(df, "s", ["row"], lex)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def test_substring_hits_with_null_texts_other_columns_and_no_lexicon(spark):
    df = spark.createDataFrame([(1, "a\0b", [1], "x"), (2, None, None, "y"), (None, "ab" * 5000, [], None)], "row long, s string, keyword_ids array<int>, _x string")
    lex = M.lexicon_set(lexicon(spark, ["\0b", "ab", "a", "", "a" * 300]))
    for bound in (1000, 1):
        got = M.match_substring(df.where("row is not null"), "s", ["row"], lex, bound, carry=["keyword_ids", "_x"]).collect()
        assert sorted((r["row"], r["keyword"], r["keyword_ids"], r["_x"]) for r in got) == [(1, "", [1], "x"), (1, "\0b", [1], "x"), (1, "a", [1], "x")]
    assert sorted(r["keyword"] for r in M.match_substring(df.where("row is null"), "s", ["row"], lex).collect()) == ["", "a", "ab"]
    assert M.match_substring(df, "s", ["row"], lex.limit(0)).collect() == []


def test_word_hits_of_keywords_with_punctuation_are_those_of_a_boundary_search(spark):
    import re

    df, lex = table(spark, EDGES), M.lexicon_ranked(lexicon(spark, EDGE_WORDS))
    # Boundaries of the library's word class agree with Python's on these texts.
    want = sorted((i, k, len(k)) for i, s in enumerate(EDGES) for k in EDGE_WORDS if re.search(r"\b" + re.escape(k) + r"\b", s))
    for bound in (1000, 1):
        assert sorted(map(tuple, M.match_word(df, "s", ["row"], lex, bound).collect())) == want


def test_aspect_map_is_sorted_per_row(spark):
    df = spark.createDataFrame([(0, "b", "neutral"), (0, "a", "positive"), (1, "c", "negative")], "row int, aspect string, label string")
    m = {r["row"]: dict(r["aspect_map"]) for r in M.aspect_map(df, ["row"]).collect()}
    assert m == {0: {"a": "positive", "b": "neutral"}, 1: {"c": "negative"}}
    assert list(M.aspect_map(df, ["row"]).where("row = 0").first()["aspect_map"].keys()) == ["a", "b"]

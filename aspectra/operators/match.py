"""Lexicon matching: substring hits, whole-word hits, the main aspect, coverage
and the per-sentence aspect map.

The lexicon side is broadcast only after its rows (and, for whole words, its bytes)
are checked against a bound; beyond the bound the same candidates come from a shuffled equi-join,
so no path depends on the lexicon being small.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.sizes import row_bytes
from aspectra.functions.text import MARK, WORD_CLASS, mark_tokens, word_runs
from aspectra.functions.vectors import bind
from aspectra.operators.row_terms import first_phrase

# Largest lexicon, in rows and in measured bytes, that is broadcast to every task.
BROADCAST_LEXICON_ROWS = 200_000
BROADCAST_LEXICON_BYTES = 64 << 20


# A table that is proven to have so few rows is broadcast without a job to measure it.
SURE_ROWS = 100_000


def sized_broadcast(df: DataFrame, max_rows: int, bound: int | None = None, max_bytes: int = BROADCAST_LEXICON_BYTES) -> tuple[DataFrame, bool]:
    """``broadcast(df)`` when it has at most ``max_rows`` rows of ``max_bytes`` together, else ``df`` unchanged.

    ``bound`` is a row bound the caller can prove by construction (a vocabulary
    capped at max_features, a class list); up to ``SURE_ROWS`` nothing is run. Otherwise
    rows and bytes are measured by one aggregate, so the table should be written or cheap.
    """
    if bound is not None and bound <= min(max_rows, SURE_ROWS):
        return F.broadcast(df), True
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes:
        return F.broadcast(df), True
    return df, False


# Salts for shuffled lexicon joins (large-lexicon paths): a hot token or prefix
# is spread over this many tasks; the lexicon side is replicated as many times.
JOIN_SALTS = 16


def salted_join(rows: DataFrame, lexicon: DataFrame, on: str, salt_cols: Sequence[str], salts: int = JOIN_SALTS) -> DataFrame:
    """Shuffled equi-join on ``on`` with the row side salted by a hash of
    ``salt_cols`` and the lexicon side replicated over all salts, so one hot key
    value (a very common first token) does not end up in a single task."""
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts)))
    salted_lex = lexicon.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_rows.join(salted_lex, [on, "_salt"]).drop("_salt")


def lexicon_set(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lexicon as loaded for substring matching: distinct phrases, case kept."""
    return lines.select(F.col(col).alias("keyword")).where(F.col("keyword").isNotNull()).distinct()


def lexicon_ranked(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lexicon as loaded for whole-word matching: lower-cased, distinct, with the
    columns used for matching and for the longest-first order.

    Token marks stand exactly at word boundaries, so a keyword with a mark at
    either end is found where a boundary search finds it, also if the keyword
    begins or ends with punctuation; an empty keyword is found at any boundary.
    ``kw_first`` is the first word run, empty if there is none; ``kw_key`` the marked keyword without the
    outer marks, ``kw_parts`` the parts that marks divide it into, ``kw_begins`` whether a word run is its first.
    """
    kw = lines.select(F.lower(F.col(col)).alias("keyword")).where(F.col("keyword").isNotNull()).distinct()
    marked = mark_tokens(F.col("keyword"))
    begun = F.when(F.startswith(marked, F.lit(MARK)), marked).otherwise(F.concat(F.lit(MARK), marked))
    ended = F.when(F.endswith(begun, F.lit(MARK)), begun).otherwise(F.concat(begun, F.lit(MARK)))
    inside = F.when(ended == MARK, F.lit("")).otherwise(F.substr(ended, F.lit(2), F.char_length(ended) - 2))
    out = kw.select(
        "keyword",
        F.char_length("keyword").alias("kw_len"),
        ended.alias("kw_marked"),
        F.coalesce(F.try_element_at(word_runs(F.col("keyword")), F.lit(1)), F.lit("")).alias("kw_first"),
        inside.alias("kw_key"),
    )
    parts = F.when(F.col("kw_marked") == MARK, F.lit(0)).otherwise(F.size(F.split("kw_key", MARK)))
    return out.withColumns({"kw_parts": parts, "kw_begins": F.rlike("kw_key", F.lit(f"^[{WORD_CLASS}]"))})


def with_rank(lexicon: DataFrame) -> DataFrame:
    """The ranked lexicon with ``kw_rank``: 0, 1, ... longest first, then by keyword. A phrase's rank takes the place of the
    phrase in joins and in the choice of the longest hit.

    Ranked within each length and moved behind all longer phrases: one row per length, however large the lexicon.
    """
    within = F.row_number().over(Window.partitionBy("kw_len").orderBy("keyword"))
    longer = F.sum("_n").over(Window.orderBy(F.col("kw_len").desc()).rowsBetween(Window.unboundedPreceding, -1))
    sizes = lexicon.groupBy("kw_len").agg(F.count(F.lit(1)).alias("_n")).select("kw_len", F.coalesce(longer, F.lit(0)).alias("_before"))
    placed = lexicon.withColumn("_rank", within).join(sizes, "kw_len")
    return placed.select(*lexicon.columns, (F.col("_before") + F.col("_rank") - 1).cast("int").alias("kw_rank"))


def phrase_shapes(lexicon: DataFrame) -> tuple[list[tuple[bool, int]], int, int]:
    """((begins with a word run, parts) of the phrases, rows, bytes), in one pass: at most two shapes for each
    number of parts, so the list is bounded by the longest phrase."""
    found = lexicon.agg(
        F.array_sort(F.collect_set(F.struct("kw_begins", "kw_parts"))).alias("s"), F.count(F.lit(1)).alias("n"), F.sum(row_bytes(lexicon)).alias("b")
    ).first()
    return [(r["kw_begins"], r["kw_parts"]) for r in found["s"]], found["n"], found["b"] or 0


def phrase_keys(text: Column, shapes: Sequence[tuple[bool, int]]) -> Column:
    """Distinct places of a (lower-cased) text where phrases of some shapes may stand, written like ``kw_key``.

    The marked text is divided at its marks; word runs and what stands between them take turns. A phrase stands wherever
    as many parts as it has, with a mark on both sides, are its own. In time linear in the text for each shape.
    """

    def of_shape(parts: Column, loose: Column, begins: bool, n: int) -> Column:
        if n == 0:
            return F.when(F.size(parts) > 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        # A mark that the text has itself breaks the turns: then every part may be the first.
        first, last = F.when(loose, F.lit(1)).otherwise(F.lit(1 if begins else 2)), F.size(parts) - 1 - n
        step = F.when(loose, F.lit(1)).otherwise(F.lit(2))
        key = (lambda s: F.get(parts, s)) if n == 1 else (lambda s: F.array_join(F.slice(parts, s + 1, n), MARK))
        return F.when(last >= first, F.transform(F.sequence(first, last, step), key)).otherwise(F.array().cast("array<string>"))

    if not shapes:
        return F.array().cast("array<string>")
    loose = F.contains(text, F.lit(MARK))
    every = lambda parts: F.array_distinct(F.concat(*[of_shape(parts, loose, *shape) for shape in shapes]))
    return bind(F.split(mark_tokens(text), MARK), every)


PREFIX = 3  # characters of a keyword that candidates are found by


def match_substring(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    lexicon: DataFrame,
    max_broadcast_rows: int = BROADCAST_LEXICON_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """All (row, keyword) pairs where the keyword occurs as a substring of the
    text, case-sensitive. Output: keys + carry + keyword.

    A lexicon within the bounds goes to the tasks as one automaton, which walks each text once, in Arrow batches:
    the work is the text's length and its hits. Beyond them, candidates come from a shuffled equi-join of the text's distinct
    grams of 0 to ``PREFIX`` characters with the keyword's first characters (all of them, if it
    has fewer; the empty keyword is in every text), followed by the exact test; only (keys, gram) of each row
    go through the shuffle, and the text is joined to the candidates afterwards.
    """
    lexicon = lexicon.select("keyword")
    size = lexicon.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(lexicon)).alias("b")).first()
    if size["n"] <= max_broadcast_rows and (size["b"] or 0) <= BROADCAST_LEXICON_BYTES:
        return _walk(df, text, keys, carry, [r["keyword"] for r in lexicon.collect()])
    grams = F.explode(_prefix_grams(F.col(text))).alias("_gram")
    rows = df.select(*keys, *carry, F.col(text).alias("_text"))
    lex = lexicon.select("keyword", F.substring("keyword", 1, PREFIX).alias("_gram"))
    found = salted_join(df.select(*keys, grams), lex, "_gram", keys).drop("_gram").join(rows, list(keys))
    return found.where(F.contains(F.col("_text"), F.col("keyword"))).select(*keys, *carry, "keyword")


WALK_ROWS = 2048  # rows whose hits are in memory at a time


def _walk(df: DataFrame, text: str, keys: Sequence[str], carry: Sequence[str], phrases: list[str]) -> DataFrame:
    """Hits by an automaton of the phrases, built in every task."""
    names = [*keys, *carry]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("keyword", T.StringType())])

    def run(batches):
        automaton, anywhere = ahocorasick.Automaton(), []
        for k, phrase in enumerate(phrases):
            if phrase:
                automaton.add_word(phrase, k)
            else:
                anywhere.append(k)  # the empty phrase
        automaton.make_automaton()
        walk = automaton.iter if len(automaton) else lambda _: ()
        words = pa.array(phrases, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, WALK_ROWS):
                part = batch.slice(at, WALK_ROWS)
                row, hit = [], []
                for i, s in enumerate(part.column(len(names)).to_pylist()):
                    if s is not None:
                        found = {k for _, k in walk(s)}
                        hit += found
                        hit += anywhere
                        row += [i] * (len(found) + len(anywhere))
                rows = pa.array(row, pa.int64())
                columns = [part.column(c).take(rows) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, words.take(pa.array(hit, pa.int64()))], [*names, "keyword"])

    return df.select(*names, F.col(text).alias("_text")).mapInArrow(run, schema)


def _prefix_grams(text: Column) -> Column:
    """Distinct substrings of 0 to ``PREFIX`` characters, in time linear in the text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    grams = [F.array(F.lit("")), chars]
    for k in range(2, PREFIX + 1):
        shifted = [F.slice(chars, i + 1, F.greatest(F.size(chars) - (k - 1), F.lit(0))) for i in range(k)]
        joined = shifted[0]
        for nxt in shifted[1:]:
            joined = F.zip_with(joined, nxt, lambda a, b: F.concat(a, b))
        grams.append(joined)
    return F.array_distinct(F.concat(*grams))


def match_word(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    lexicon: DataFrame,
    max_broadcast_rows: int = BROADCAST_LEXICON_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """All whole-word hits of the ranked lexicon in the lower-cased text.

    An equi-join on the whole phrase: every place of the text that has the shape of a phrase is looked
    up, so the work is the text's tokens and the hits, and no text is searched for a phrase.
    Output: keys + carry + keyword, kw_len, and ``kw_rank`` if the lexicon has it.
    """
    named = ["keyword", "kw_len"] + (["kw_rank"] if "kw_rank" in lexicon.columns else [])
    shapes, n, size = phrase_shapes(lexicon)
    lex = lexicon.select(*named, F.col("kw_key").alias("_key"))
    rows = df.select(*keys, *carry, F.explode(phrase_keys(F.lower(F.col(text)), shapes)).alias("_key"))
    # Otherwise a shuffled join whose hot words are salted.
    small = n <= max_broadcast_rows and size <= BROADCAST_LEXICON_BYTES
    joined = rows.join(F.broadcast(lex), "_key") if small else salted_join(rows, lex, "_key", keys)
    return joined.select(*keys, *carry, *named)


def main_phrase(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys + ``kw_rank`` of the longest hit: integers only, so the aggregate hashes and spills little."""
    return hits.groupBy(*keys).agg(F.min("kw_rank").alias("kw_rank"))


def main_aspect(hits: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Longest hit per row (keyword ascending among equal lengths); rows without
    a hit produce no row. Output: keys + carry + aspect."""
    order = F.struct(-F.col("kw_len"), F.col("keyword"))
    aggs = [F.min_by("keyword", order).alias("aspect")] + [F.any_value(c).alias(c) for c in carry]
    return hits.groupBy(*keys).agg(*aggs).select(*keys, *carry, "aspect")


def phrase_parts(key: str, n: int) -> list[str]:
    """The parts of a ``kw_key``."""
    return key.split(MARK) if n else []


def main_word(df: DataFrame, text: str, keys: Sequence[str], lexicon: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``main_aspect`` of ``match_word``: keys + carry + aspect.

    A lexicon within the bounds goes to the tasks as a table of ranks: a row looks up its own places, so what is
    grouped is a rank per row and not a row per hit. Rows that share a key are one, with the longest hit of all.
    """
    _, n, size = phrase_shapes(lexicon)
    if n > BROADCAST_LEXICON_ROWS or size > BROADCAST_LEXICON_BYTES:
        return main_aspect(match_word(df, text, keys, lexicon, carry=carry), keys, carry=carry)
    ranked = sorted(lexicon.select("keyword", "kw_len", "kw_key", "kw_parts").collect(), key=lambda r: (-r["kw_len"], r["keyword"].encode()))
    phrases = [phrase_parts(r["kw_key"], r["kw_parts"]) for r in ranked]
    names = F.broadcast(df.sparkSession.createDataFrame([(k, r["keyword"]) for k, r in enumerate(ranked)], "_rank int, aspect string"))
    found = df.select(*keys, *carry, first_phrase(F.lower(F.col(text)), phrases).alias("_rank")).where("_rank is not null")
    main = found.groupBy(*keys).agg(F.min("_rank").alias("_rank"), *[F.any_value(c).alias(c) for c in carry])
    return main.join(names, "_rank").select(*keys, *carry, "aspect")


def without_aspect(rows: DataFrame, with_aspect: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that found no aspect (the anti side of the semi-join)."""
    return rows.join(with_aspect.select(*keys), list(keys), "left_anti")


def aspect_map(df: DataFrame, keys: Sequence[str], aspect: str = "aspect", label: str = "label", held: str | None = None) -> DataFrame:
    """keys + MAP<aspect, label> per row, entries in aspect order. A row has at
    most one entry per lexicon phrase, so the collected group is bounded.
    ``held``: an array of (aspect, label) in that order, for rows that have all entries of their keys already."""
    if held is not None:
        return df.where(F.size(held) > 0).select(*keys, F.map_from_entries(held).alias("aspect_map"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(aspect), F.col(label))))
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias("aspect_map"))

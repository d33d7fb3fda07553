"""Synonym sets learned from a corpus: words that stand in the same contexts.

1. Contexts. Each word occurrence has its left and its right neighbour in the text as features. Two words side by side give a
   feature to either, so pairs of adjacent words are counted, in slices of a batch first; and words as their first and second.
2. Weights. A pair weighs its positive pointwise mutual information, discounted by n / (n + 1) for rare pairs, in thousandths
   as an integer: sums and ranks don't depend on the order of rows.
3. Candidates. A feature keeps the ``per_feature`` words that it is most telling for, so it gives at most
   ``per_feature`` ** 2 / 2 pairs, however common it is.
4. Similarity. Shared weight / (all weight of either word - shared weight), which is a weighted Jaccard coefficient; a word keeps its
   ``neighbours`` best partners with at least ``shared`` common features and ``least`` similarity.
5. Sets. Every neighbour v of a word w is the seed of a set: v and the neighbours that w and v have in common, so each set
   is one sense. Sets of w with equal members are one, that of the nearest seed.

Ranks are row_number limits, which Spark applies before it shuffles, so neither a common feature nor a common word collects its
rows in one task.

Defined cases: null and empty texts and texts of one word give no contexts; words with fewer than ``min_count`` contexts have no
sets and are no lemmas; ties go to the smaller word; without contexts the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.sizes import row_bytes
from aspectra.functions.text import word_runs
from aspectra.operators.row_terms import slices
from aspectra.session import checkpoint

MIN_COUNT = 5
MIN_PAIR = 2
PER_FEATURE = 40
NEIGHBOURS = 6
SHARED = 2
LEAST = 0.02
BROADCAST_BYTES = 64 << 20


def adjacent(texts: DataFrame, text: str, min_pair: int = 1) -> DataFrame:
    """(first, second, n): how often two words are next to each other in the lower-cased texts, where that is at least ``min_pair``
    times; with ``second`` null how often a word is the first of two, with ``first`` null the second.

    Counted in each slice of a batch first: what is shuffled is a slice's distinct pairs and words.
    """

    def run(batches):
        for batch in batches:
            for part, lengths in slices(batch.column(0)):
                coded, owner = part.flatten().dictionary_encode(), np.repeat(np.arange(len(lengths)), lengths)
                codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())
                within = owner[1:] == owner[:-1]
                a, b = codes[:-1][within], codes[1:][within]
                pairs, n = np.unique(a * max(len(words), 1) + b, return_counts=True)
                first, second = np.divmod(pairs, max(len(words), 1))
                firsts, seconds = np.bincount(a, minlength=len(words)), np.bincount(b, minlength=len(words))
                none = pa.nulls(len(words), pa.string())
                for x, y, k in ((words.take(pa.array(first)), words.take(pa.array(second)), n), (words, none, firsts), (none, words, seconds)):
                    yield pa.RecordBatch.from_arrays([x, y, pa.array(k, pa.int64())], ["first", "second", "n"])

    counted = texts.select(word_runs(F.lower(F.col(text))).alias("t")).mapInArrow(run, "first string, second string, n long")
    found = counted.where("n > 0").groupBy("first", "second").agg(F.sum("n").alias("n"))
    return found if min_pair <= 1 else found.where((F.col("n") >= min_pair) | F.col("first").isNull() | F.col("second").isNull())


def _sides(pairs: DataFrame, left: list, right: list) -> DataFrame:
    """Rows of both words of a pair, with the other one as feature; ``left`` has what goes to the second word's row."""
    a, b = F.col("first"), F.col("second")
    left = F.struct(b.alias("word"), F.concat(F.lit("l:"), a).alias("feature"), "n", *left)
    right = F.struct(a.alias("word"), F.concat(F.lit("r:"), b).alias("feature"), "n", *right)
    return pairs.select(F.inline(F.array(left, right)))


def contexts(texts: DataFrame, text: str) -> DataFrame:
    """(word, feature, n): how often a word has that left or right neighbour in the lower-cased texts."""
    return _sides(adjacent(texts, text).where("first is not null and second is not null"), [], [])


def _weighed(pairs: DataFrame, total: float) -> DataFrame:
    """(word, feature, weight) from n and the totals of word and feature."""
    n, nw, nf = (F.col(c).cast("double") for c in ("n", "nw", "nf"))
    weight = F.floor(F.lit(1000.0) * F.log(n * F.lit(total) / (nw * nf)) * (n / (n + F.lit(1.0))))
    return pairs.select("word", "feature", weight.cast("long").alias("weight")).where("weight > 0")


def pair_weights(counts: DataFrame, min_count: int = MIN_COUNT, min_pair: int = MIN_PAIR) -> DataFrame:
    """``weights`` of ``contexts``, from the counts of ``adjacent``: a feature's total is how often its word is the first or the
    second of two, a word's total both, so rare pairs are not read for the totals."""
    once = counts.where("first is null or second is null")
    words = once.groupBy(F.coalesce("first", "second").alias("word")).agg(
        F.sum(F.when(F.col("second").isNull(), F.col("n")).otherwise(0)).alias("firsts"),
        F.sum(F.when(F.col("first").isNull(), F.col("n")).otherwise(0)).alias("seconds"),
    )
    # Other words are in no pair that counts.
    words = words.where((F.col("firsts") >= min_pair) | (F.col("seconds") >= min_pair)).withColumn("both", F.col("firsts") + F.col("seconds"))
    total = float(once.agg(F.sum("n")).first()[0] or 0)
    pairs = counts.where(F.col("first").isNotNull() & F.col("second").isNotNull() & (F.col("n") >= min_pair))
    pairs = pairs.join(words.select(F.col("word").alias("first"), F.col("both").alias("_a"), F.col("firsts").alias("_l")), "first")
    pairs = pairs.join(words.select(F.col("word").alias("second"), F.col("both").alias("_b"), F.col("seconds").alias("_r")), "second")
    sides = _sides(pairs, [F.col("_b").alias("nw"), F.col("_l").alias("nf")], [F.col("_a").alias("nw"), F.col("_r").alias("nf")])
    return _weighed(sides.where(F.col("nw") >= min_count), total)


def weights(counts: DataFrame, min_count: int = MIN_COUNT, min_pair: int = MIN_PAIR) -> DataFrame:
    """(word, feature, weight) of the pairs that occur together more often than by chance."""
    per_word = counts.groupBy("word").agg(F.sum("n").alias("nw"))
    per_feature = counts.groupBy("feature").agg(F.sum("n").alias("nf"))
    total = float(counts.agg(F.sum("n")).first()[0] or 0)
    pairs = counts.where(F.col("n") >= min_pair).join(per_word.where(F.col("nw") >= min_count), "word").join(per_feature, "feature")
    return _weighed(pairs, total)


def _first(df: DataFrame, by: str, order: list, most: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= most)


def neighbours(
    weighed: DataFrame, per_feature: int = PER_FEATURE, most: int = NEIGHBOURS, shared: int = SHARED, least: float = LEAST
) -> DataFrame:
    """(word, rank, lemma, similarity): each word's most similar words."""
    own = weighed.groupBy("word").agg(F.sum("weight").alias("own"))
    kept = _first(weighed, "feature", [F.col("weight").desc(), F.col("word")], per_feature, "_r").drop("_r")
    a = kept.select("feature", F.col("word").alias("a"), F.col("weight").alias("wa"))
    b = kept.select("feature", F.col("word").alias("b"), F.col("weight").alias("wb"))
    pairs = a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("s"), F.count(F.lit(1)).alias("k"))
    pairs = pairs.where(F.col("k") >= shared)
    pairs = pairs.join(own.select(F.col("word").alias("a"), F.col("own").alias("oa")), "a")
    pairs = pairs.join(own.select(F.col("word").alias("b"), F.col("own").alias("ob")), "b")
    similarity = F.col("s").cast("double") / (F.col("oa") + F.col("ob") - F.col("s")).cast("double")
    pairs = pairs.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("lemma")), F.struct(F.col("b").alias("word"), F.col("a").alias("lemma")))
    both = pairs.select(F.explode(ends).alias("e"), "similarity").select("e.word", "e.lemma", "similarity")
    return _first(both, "word", [F.col("similarity").desc(), F.col("lemma")], most, "rank").select("word", "rank", "lemma", "similarity")


def senses(near: DataFrame) -> DataFrame:
    """(word, set_no, lemma_no, lemma): the sets of every word, the seed first, then by similarity."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "lemma")))  # a word has a bounded number of neighbours
    lists = near.groupBy("word").agg(F.transform(ranked, lambda e: e["lemma"]).alias("lemmas"))
    seeds = lists.select("word", "lemmas", F.posexplode("lemmas").alias("seed_no", "seed"))
    of_seed = lists.select(F.col("word").alias("seed"), F.col("lemmas").alias("theirs"))
    j = seeds.join(of_seed, "seed", "left")
    common = F.array_intersect("lemmas", F.coalesce("theirs", F.array().cast("array<string>")))
    members = F.concat(F.array("seed"), F.array_remove(common, F.col("seed")))
    sets = j.select("word", "seed_no", members.alias("members"))
    sets = sets.groupBy("word", F.array_sort("members").alias("_same")).agg(F.min_by("members", "seed_no").alias("members"), F.min("seed_no").alias("seed_no"))
    number = F.row_number().over(Window.partitionBy("word").orderBy("seed_no")) - 1
    return sets.withColumn("set_no", number).select("word", "set_no", F.posexplode("members").alias("lemma_no", "lemma"))


def learn_synonyms(texts: DataFrame, text: str, min_count: int = MIN_COUNT, per_feature: int = PER_FEATURE, most: int = NEIGHBOURS) -> DataFrame:
    """(word, set_no, lemma_no, lemma) from the texts of a corpus. The texts are read once: counts, weights and neighbours, which
    several steps read, are checkpointed."""
    counts = checkpoint(adjacent(texts, text, MIN_PAIR))
    weighed = checkpoint(pair_weights(counts, min_count))
    return senses(checkpoint(neighbours(weighed, per_feature, most)))


def first_lemmas(sets: DataFrame) -> DataFrame:
    """(word, set_no, lemma): the first lemma of each set, the input of synonym replacement."""
    return sets.where("lemma_no = 0").select("word", "set_no", "lemma")


def broadcast_by_bytes(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` where its measured rows take at most ``most`` bytes, else ``df``."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most else df

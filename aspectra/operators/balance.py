"""Class balancing: class sizes, exact bootstrap to the largest class, synonym
augmentation, union and a seeded shuffle with a dense row index.

No step uses a window over a whole class or the whole table (three classes
would mean three tasks, the whole table one). Dense indexes come from
``ordered_index``: rows are ranked inside hash buckets (many parallel tasks),
and each bucket adds the size of the buckets before it, taken from a table of
one row per (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.hashing import hash_bucket, portable_hash
from aspectra.functions.sizes import row_bytes
from aspectra.functions.text import split_ws
from aspectra.functions.vectors import element
from aspectra.operators.features import work_partitions
from aspectra.operators.match import sized_broadcast
from aspectra.operators.prepare import once
from aspectra.operators.synonyms import broadcast_by_bytes

SEED = 42
# Buckets of a dense index: enough tasks for any table, few enough for a table of bucket sizes.
N_BUCKETS = 1 << 16
BROADCAST_OFFSET_ROWS = 1_000_000
# Draws per task when generating bootstrap slots.
SLOTS_PER_TASK = 1_000_000
# The smallest classes, up to this many bytes together, are joined to their draws by broadcast (no hot keys).
BROADCAST_CLASS_BYTES = 64 << 20


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, max_n): class sizes and the largest (window over <= classes rows)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.select(label, "n", F.max("n").over(Window.partitionBy()).alias("max_n"))


def range_bucket(col: Column, lo: int, hi: int, n_buckets: int = N_BUCKETS) -> Column:
    """At most ``n_buckets`` equal ranges of integers from ``lo`` to ``hi``, however many there are."""
    return F.floor((col - F.lit(lo)) / F.lit((hi - lo) // n_buckets + 1))


def ordered_index(
    df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "idx", bound: int | None = None
) -> DataFrame:
    """Add a dense 0-based index per group following ``order``.

    ``bucket`` must be non-decreasing in ``order`` (e.g. the top bits of a hash
    that leads the order): rank inside (group, bucket), then add the sizes of
    the earlier buckets of the group. ``bound``: how many (group, bucket) there are
    at most, where that is known; then nothing is counted beforehand.
    """
    g = list(groups)
    b = df.withColumn("_bucket", bucket)
    ranked = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*g, "_bucket").orderBy(*order)))
    sizes = b.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*g, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    offsets, _ = sized_broadcast(offsets, BROADCAST_OFFSET_ROWS, bound)
    out = ranked.join(offsets, [*g, "_bucket"])
    return out.withColumn(name, F.col("_off") + F.col("_rn") - 1).drop("_bucket", "_rn", "_off")


def bootstrap(
    df: DataFrame, label: str, keys: Sequence[str], seed: int = SEED, n_buckets: int = N_BUCKETS,
    broadcast_bytes: int = BROADCAST_CLASS_BYTES,
) -> DataFrame:
    """Every class drawn with replacement to exactly the largest class size.

    Slot s of class c takes the row whose in-class index is
    hash(seed, c, s) mod n_c (index order: hash(row, seed, keys), keys). Output:
    the input columns + ``slot``. Deterministic and exact; ``sample`` is neither.
    """
    spark = df.sparkSession
    df = df.where(F.col(label).isNotNull())  # a row without a class belongs to none
    h = portable_hash("row", seed, *[F.col(k) for k in keys])
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("bytes")).collect()
    sizes = sorted((r[label], r["n"]) for r in found)
    bucket = hash_bucket(n_buckets, "row", seed, *[F.col(k) for k in keys])
    indexed = ordered_index(df, [label], bucket, [h, *keys], bound=len(sizes) * n_buckets)
    if not sizes:
        return indexed.drop("idx").withColumn("slot", F.lit(None).cast("bigint")).limit(0)
    m = max(n for _, n in sizes)
    classes = F.array(*[F.lit(c) for c, _ in sizes])
    counts = F.array(*[F.lit(n) for _, n in sizes])
    total = len(sizes) * m
    parts = max(spark.sparkContext.defaultParallelism, total // SLOTS_PER_TASK + 1)
    ci = (F.col("id") / F.lit(m)).cast("int")
    draws = spark.range(0, total, 1, parts).select(
        element(classes, ci).alias("_cls"),
        (F.col("id") % F.lit(m)).alias("slot"),
        element(counts, ci).alias("_n"),
    )
    draws = draws.select("_cls", "slot", (portable_hash(seed, F.col("_cls"), F.col("slot")) % F.col("_n")).alias("_pick"))
    cond = (F.col("_cls") == F.col(label)) & (F.col("_pick") == F.col("idx"))
    # A small class is drawn many times per row: its (class, index) keys would be
    # hot in a shuffled join. The smallest classes are broadcast instead, as far as
    # their measured bytes allow; larger ones keep the shuffled join, where each index
    # is drawn only max/n_c times.
    small, large, held = [], [], 0
    for r in sorted(found, key=lambda r: r["bytes"]):
        held += r["bytes"]
        (small if held <= broadcast_bytes else large).append(r[label])
    pieces = []
    if small:
        rows = F.broadcast(indexed.where(F.col(label).isin(small)))
        pieces.append(draws.where(F.col("_cls").isin(small)).join(rows, cond))
    if large:
        pieces.append(draws.where(F.col("_cls").isin(large)).join(indexed.where(F.col(label).isin(large)), cond))
    joined = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
    return joined.drop("_cls", "_pick", "idx")


def synonym_sets(synonyms: DataFrame) -> DataFrame:
    """(word, lemmas ARRAY<STRING>) ordered by set number: one row per word."""
    arr = F.array_sort(F.collect_list(F.struct("set_no", "lemma")))
    return synonyms.groupBy("word").agg(F.transform(arr, lambda e: e["lemma"]).alias("lemmas"))


def synonym_replace(
    df: DataFrame, text: str, keys: Sequence[str], synonyms: DataFrame, seed: int = SEED, out: str = "augmented"
) -> DataFrame:
    """keys + ``out``: each whitespace word that has synonym sets becomes the
    first lemma of one set chosen by hash(seed, keys, position); other words stay.
    Words are joined with one space."""
    sets = broadcast_by_bytes(synonym_sets(synonyms))
    # Dealt by their keys as texts, so that with sets that are broadcast no word is shuffled. A row without words has a
    # row without a position, so it still comes out ('').
    dealt = df.repartition(work_partitions(df), *keys)
    j = dealt.select(*keys, F.posexplode_outer(split_ws(F.col(text))).alias("pos", "word")).join(sets, "word", "left")
    n = F.size("lemmas")
    chosen = element(F.col("lemmas"), (portable_hash(seed, *[F.col(k) for k in keys], F.col("pos")) % n).cast("int"))
    w = F.when(F.col("lemmas").isNull(), F.col("word")).otherwise(chosen)
    # The words are chosen before they are collected: an aggregate would interpret the choice row by row.
    placed = once(j, keys, F.when(F.col("pos").isNotNull(), F.struct(F.col("pos"), w.alias("w"))).alias("_at"))
    agg = placed.groupBy(*keys).agg(F.sort_array(F.collect_list("_at")).alias("_ws"))
    return agg.select(*keys, F.array_join(F.transform("_ws", lambda e: e["w"]), " ").alias(out))


def shuffle_index(
    df: DataFrame, keys: Sequence[str], seed: int = SEED, n_buckets: int = N_BUCKETS, name: str = "row_index"
) -> DataFrame:
    """Seeded full shuffle: a dense index in the order of hash(seed, keys)."""
    ks = [F.col(k) for k in keys]
    h = portable_hash("shuffle", seed, *ks)
    return ordered_index(df, [], hash_bucket(n_buckets, "shuffle", seed, *ks), [h, *ks], name, n_buckets)

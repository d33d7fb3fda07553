"""Feature building: n-gram term counts, vocabulary, idf, TF-IDF, forced-width
concatenation and fixed-length pair encoding.

Sparse throughout: a document is a set of (term, weight) rows, never a dense
vector. Per-document aggregates (term counts, L2 norm) run after one
hash-partitioning of the text rows by their key, so the count, the norm
window and the later scoring aggregate reuse that partitioning instead of
shuffling the much larger n-gram rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.text import ngrams, split_ws, vectorizer_tokens
from aspectra.operators.match import sized_broadcast
from aspectra.operators.prepare import once
from aspectra.session import checkpoint

# ---- fixed values -------------------------------------------------------
MAX_FEATURES = 5000
# Width the inference path forces the concatenated feature vector to.
FORCED_WIDTH = 4526
# Pair encoding: length and special token ids (<s>, <pad>, </s>, <unk>).
MAX_LENGTH = 256
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
# -------------------------------------------------------------------------

# Largest vocabulary broadcast to every task (a vocabulary is capped by max_features).
BROADCAST_VOCAB_ROWS = 2_000_000


def term_counts(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    lo: int = 1,
    hi: int = 1,
    carry: Sequence[str] = (),
    cluster: bool = True,
) -> DataFrame:
    """keys + carry + (term, tf): raw counts of the vectoriser's n-grams per row.

    The rows are hash-partitioned by their full key once (text, not n-grams,
    crosses the network); the count per (key, term), the norm window per key
    and the scoring aggregate per key are then all satisfied by that
    partitioning. Partitioning by the whole key, not its first column, keeps
    one very large document from landing in a single task."""
    src = df.repartition(work_partitions(df), *keys) if cluster else df
    toks = src.select(*keys, *carry, vectorizer_tokens(F.col(text)).alias("_tok"))
    grams = toks.select(*keys, *carry, F.explode(ngrams(F.col("_tok"), lo, hi)).alias("term"))
    return grams.groupBy(*keys, *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


def work_partitions(df: DataFrame) -> int:
    """Partition count for CPU-heavy per-row work: the session's shuffle
    partitions, at least the task slots. Given explicitly, so that
    adaptive coalescing (meant for light rows) does not fold tokenisation of
    small-but-heavy inputs into a few tasks."""
    spark = df.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def fit_vocabulary(tf: DataFrame, n_docs: Column, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, idx, total, df, idf) for the ``max_features`` terms with the highest
    total count (ties by term); idx is the alphabetical position, idf the
    smoothed ln((1 + N) / (1 + df)) + 1."""
    return top_terms(tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")), n_docs, max_features)


def top_terms(stats: DataFrame, n_docs: Column, max_features: int = MAX_FEATURES) -> DataFrame:
    """The same from (term, total, df) of every term."""
    top = stats.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    # The window runs over at most max_features rows.
    w = Window.orderBy("term")
    return top.select(
        "term",
        (F.row_number().over(w) - 1).alias("idx"),
        "total",
        "df",
        (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"),
    )


def tfidf(
    tf: DataFrame, vocab: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), vocab_bound: int | None = MAX_FEATURES
) -> DataFrame:
    """keys + carry + (term, idx, weight): tf * idf, L2-normalised per row over
    the vocabulary terms (unseen terms are ignored). ``vocab_bound`` is the cap
    the vocabulary was fitted with (None: count it)."""
    v, _ = sized_broadcast(vocab.select("term", "idx", "idf"), BROADCAST_VOCAB_ROWS, vocab_bound)
    j = tf.join(v, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
    return j.select(*keys, *carry, "term", "idx", (F.col("_w") / norm).alias("weight"))


def concat_pad(
    logits: DataFrame, weights: DataFrame, keys: Sequence[str], n_logits: int = 3, width: int = FORCED_WIDTH
) -> DataFrame:
    """Sparse form of ``hstack([logits, tfidf])`` cut or zero-padded to ``width``:
    keys + (pos, value) for the non-zero positions below ``width``. Logit j is at
    position j, term idx at n_logits + idx; positions past the end are the padding."""
    lg = logits.select(*keys, F.posexplode("logits").alias("pos", "value"))
    tw = weights.select(*keys, (F.col("idx") + n_logits).alias("pos"), F.col("weight").alias("value"))
    out = lg.unionByName(tw)
    return out.where((F.col("pos") < width) & (F.col("value") != 0.0))


def encode_vocabulary(df: DataFrame, text_cols: Sequence[str], size: int | None = None) -> DataFrame:
    """(word, token_id): every whitespace word of the given text columns, most
    frequent first (ties by word), ids after the special tokens. ``size`` keeps
    only that many; other words are then encoded as unknown."""
    words = None
    for c in text_cols:
        part = df.select(F.explode(split_ws(F.col(c))).alias("word"))
        words = part if words is None else words.unionByName(part)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if size is not None:
        counts = counts.orderBy(F.col("n").desc(), "word").limit(size)
    # Sorted in ranges of (count, word), as most words of a large vocabulary share a count; a word's id is its place in its
    # range behind the words of all ranges before: one row per range, however large the vocabulary.
    placed = checkpoint(counts.orderBy(F.col("n").desc(), "word").select("word", F.monotonically_increasing_id().alias("_place")))
    # The place is numbered from 0 in each range, the range's number in the bits above.
    at, rank = F.shiftright("_place", PLACE_BITS), F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    placed = placed.select("word", at.alias("_range"), rank.alias("_rank"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    found = placed.join(F.broadcast(sizes), "_range")
    return found.select("word", (F.col("_before") + F.col("_rank") + UNK_ID + 1).cast("int").alias("token_id"))


# Bits of monotonically_increasing_id that count the rows of a partition.
PLACE_BITS = 33


def _ids(df: DataFrame, cols: Sequence[str], keys: Sequence[str], vocab: DataFrame, vocab_bound: int | None) -> DataFrame:
    """keys + ``<col>_ids`` for each of the columns: a row for every row, with the ids of all rows that share its keys;
    none where a key is null.

    The words of all columns are one stream: one look-up and one group, and the rows are dealt by their keys as texts before,
    so that a vocabulary that is broadcast leaves no words to shuffle.
    """
    none, k = F.array().cast("array<string>"), list(keys)
    split = df.repartition(work_partitions(df), *k).select(*k, *[F.coalesce(split_ws(F.col(c)), none).alias(f"_w{i}") for i, c in enumerate(cols)])
    starts, sizes = [F.lit(0)], [F.size(f"_w{i}") for i in range(len(cols))]
    for n in sizes:
        starts.append(starts[-1] + n)
    ends = [e.alias(f"_e{i}") for i, e in enumerate(starts)]
    words = split.select(*k, *ends, F.posexplode_outer(F.concat(*[F.col(f"_w{i}") for i in range(len(cols))])).alias("_pos", "word"))
    v, _ = sized_broadcast(vocab, BROADCAST_VOCAB_ROWS, vocab_bound)
    # (position, id) as one integer, which sorts fast.
    ided = words.join(v, "word", "left").withColumn("_tid", F.coalesce("token_id", F.lit(UNK_ID)).cast("bigint"))
    own = lambda i: (F.col("_pos") >= F.col(f"_e{i}")) & (F.col("_pos") < F.col(f"_e{i + 1}"))
    code = lambda i: F.shiftleft((F.col("_pos") - F.col(f"_e{i}")).cast("bigint"), 32) + F.col("_tid")
    # Computed before they are collected: an aggregate would interpret them row by row.
    codes = [F.when(own(i), code(i)).alias(f"_c{i}") for i in range(len(cols))]
    placed = once(ided, k, *codes, (F.coalesce(F.col("_pos"), F.lit(0)) == 0).alias("_begins"))
    groups = placed.groupBy(*k).agg(*[F.collect_list(f"_c{i}").alias(f"_c{i}") for i in range(len(cols))], F.count_if("_begins").cast("int").alias("_rows"))
    known = F.lit(True)
    for c in k:
        known = known & F.col(c).isNotNull()
    ids = lambda i: F.transform(F.sort_array(f"_c{i}"), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    each = groups.select(*k, *[F.when(known, ids(i)).otherwise(F.array().cast("array<int>")).alias(f"{c}_ids") for i, c in enumerate(cols)], "_rows")
    return each.select(*k, *[f"{c}_ids" for c in cols], F.explode(F.array_repeat(F.lit(0), F.col("_rows")))).drop("col")


def encode_pairs(
    df: DataFrame,
    first: str,
    second: str,
    keys: Sequence[str],
    vocab: DataFrame,
    max_length: int = MAX_LENGTH,
    vocab_bound: int | None = None,
    cut: str = "longest",
) -> DataFrame:
    """keys + (input_ids, attention_mask): ``<s> A </s></s> B </s>`` cut to fit ``max_length``, padded with <pad>.
    ``cut``: ``longest`` takes from the longer text first (ties cut B), ``first`` from A only, and from B just what
    would not fit without any of A."""
    if cut not in ("longest", "first"):
        raise ValueError(f"cut: longest or first, not {cut}")
    base = _ids(df, [first, second], keys, vocab, vocab_bound)
    ia, ib = F.col(f"{first}_ids"), F.col(f"{second}_ids")
    la, lb = F.size(ia), F.size(ib)
    budget = F.lit(max_length - 4)
    over = F.greatest(la + lb - budget, F.lit(0))
    # Longest-first removal in closed form: first even out the lengths, then
    # alternate, B losing the first token of each pair of removals.
    gap = F.abs(la - lb)
    rest = F.greatest(over - gap, F.lit(0))
    common = F.least(la, lb)
    keep_a = (
        F.when(over == 0, la)
        .when(la - lb >= over, la - over)
        .when(lb - la >= over, la)
        .otherwise(common - F.floor(rest / 2).cast("int"))
    )
    keep_b = (
        F.when(over == 0, lb)
        .when(la - lb >= over, lb)
        .when(lb - la >= over, lb - over)
        .otherwise(common - F.ceil(rest / 2).cast("int"))
    )
    if cut == "first":
        keep_a, keep_b = F.greatest(la - over, F.lit(0)), F.least(lb, budget)
    ids = F.concat(
        F.array(F.lit(BOS_ID)),
        F.slice(ia, 1, keep_a),
        F.array(F.lit(EOS_ID), F.lit(EOS_ID)),
        F.slice(ib, 1, keep_b),
        F.array(F.lit(EOS_ID)),
    )
    return base.select(*keys, *_padded(ids, max_length))


def _padded(ids: Column, length: int) -> tuple[Column, Column]:
    n = F.size(ids)
    padded = F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return padded.alias("input_ids"), mask.alias("attention_mask")


def encode_texts(
    df: DataFrame, text: str, keys: Sequence[str], vocab: DataFrame, max_length: int = MAX_LENGTH, vocab_bound: int | None = None
) -> DataFrame:
    """keys + (input_ids, attention_mask): ``<s> A </s>`` of single texts, cut at the end and padded with <pad>."""
    found = _ids(df, [text], keys, vocab, vocab_bound)
    ids = F.concat(F.array(F.lit(BOS_ID)), F.slice(F.col(f"{text}_ids"), 1, max_length - 2), F.array(F.lit(EOS_ID)))
    return found.select(*keys, *_padded(ids, max_length))

"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each, its mean m and deviation s (root of the mean squared
difference from m) are kept at several resolutions. For segments of length l::

    |q - x|^2  >=  sum of l * ((mq - mx)^2 + (sq - sx)^2)        and so
    <q, x>     <=  sum of l * (mq * mx + sq * sx)

which is the same bound, as <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2. Candidates go through the
resolutions from coarse to fine and are dropped as soon as their bound is below the query's
k-th best exact score so far; the survivors' scores are computed exactly, in integers. Each
query's threshold starts from its exact scores on a bounded sample of rows, so pruning works
from the first block.

The statistics are those of the vectors turned by an orthonormal matrix, which leaves inner products as they are: its axes are
the directions in which a bounded sample of rows spreads most, widest first, and segments grow from one axis on. The
fewer directions a collection spreads in, the more the coarse segments decide. Vectors that spread evenly in all directions can't be
pruned by any segment statistics; ``pruning`` reports what share was.

Queries are a table and are taken in blocks: a block is broadcast (at most ``block`` vectors, whatever
the data), all rows are read against it where they lie, each task keeps k rows a query, and
only these are shuffled. A task holds a product of ``QUERIES`` x ``ROWS`` numbers at a time.

Defined cases: components become floor(scale * x); vectors that are null, empty, or hold null or non-finite
components, and rows without an id, take no part; nor do vectors whose squared length in these integers is 2^62 or
more, as scores with them needn't fit a long (all others do); a row is no candidate of a query with
its own id; vectors of another dimension than the query's are no candidates; a query with fewer than k
candidates returns them all; ties go to the smaller id; repeated candidate rows stand as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import slices, stash
from aspectra.llm.vectors import matrices

SEGMENTS = (1, 4, 16)
BLOCK = 16_384
SAMPLE = 2_048
ROWS = 2_048
QUERIES = 512
CELLS = 1 << 22  # components gathered at a time
NONE = -((1 << 63) - 1)  # below every score, and so is its negative above
EXACT = float(1 << 53)  # integers below it are exact as doubles


def to_integers(ids: np.ndarray, x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        f = np.floor(scale * x.astype(np.float64))
        fits = (f * f).sum(1) < 2.0**62
    return ids[fits], f[fits].astype(np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def exact_as_doubles(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether no partial sum of a product of the rows can reach 2^53: sums of the components' absolute products are at most
    the product of the lengths."""
    return bool(len(q) and len(x)) and lengths(q).max() * lengths(x).max() < EXACT / 2


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of the rows, in integers."""
    if exact_as_doubles(q, x):
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def products_of(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows ``a`` of ``q`` with the rows ``b`` of ``x``, in integers."""
    if 8 * len(a) > len(q) * len(x):
        return products(q, x)[a, b]
    out, step = np.empty(len(a), np.int64), max(1, CELLS // q.shape[1])
    for s in range(0, len(a), step):
        part = slice(s, s + step)
        out[part] = np.einsum("ij,ij->i", q[a[part]], x[b[part]])
    return out


def axes(sample: np.ndarray) -> np.ndarray:
    """An orthonormal matrix whose columns are the directions in which the rows spread, widest first."""
    x = sample.astype(np.float64)
    top = np.abs(x).max(initial=0)
    x = x / top if top > 0 else x
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def ends(d: int, n: int) -> np.ndarray:
    """Where the segments of a resolution end: the first has one axis, the others grow; resolutions of 1, 4 and 16 are nested."""
    return np.unique(np.round(np.geomspace(1, d, n)).astype(int)) if n > 1 else np.array([d])


def statistics(x: np.ndarray, n: int) -> np.ndarray:
    """Per row the segments' means and deviations, each times the root of its length: the
    bound is then a plain inner product."""
    out, start = [], 0
    for end in ends(x.shape[1], n):
        seg = x[:, start:end].astype(np.float64)
        root = (end - start) ** 0.5
        out += [seg.mean(1) * root, seg.std(1) * root]
        start = end
    return np.stack(out, 1)


def bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products, with room for rounding."""
    b = q @ x.T
    return b + 1e-6 * (1 + np.abs(b)) + 1e-9 * np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), -NONE)

    def threshold(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(query)
        q = np.concatenate([query, np.repeat(some, self.k)])
        s = np.concatenate([score, self.score[some].ravel()])
        i = np.concatenate([ids, self.id[some].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, some)
        at = first[:, None] + np.arange(self.k)[None, :]
        self.score[some], self.id[some] = s[at], i[at]


class Asked:
    """Queries of one dimension: their integers, the axes and, per resolution, their statistics."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, floor: np.ndarray):
        self.ids, self.q, self.turn, self.floor = ids, q, turn, floor
        turned = q @ turn
        self.stats = [statistics(turned, n) for n in SEGMENTS]


def search_block(asked: Asked, best: Best, ids: np.ndarray, x: np.ndarray) -> int:
    """Offer every row of ``x`` that may be among a query's best; returns how many pairs were scored."""
    turned = x @ asked.turn
    x_stats, scored = [statistics(turned, n) for n in SEGMENTS], 0
    for s in range(0, len(asked.ids), QUERIES):
        part = slice(s, s + QUERIES)
        least = best.threshold()[part]
        able = bounds(asked.stats[0][part], x_stats[0]) >= least[:, None]
        able &= asked.ids[part][:, None] != ids[None, :]
        a, b = np.nonzero(able)
        for level in range(1, len(SEGMENTS)):
            qs, xs = asked.stats[level][part], x_stats[level]
            if 8 * len(a) > able.size:  # many left: bound them all at once
                up = bounds(qs, xs)[a, b]
            else:
                up = np.einsum("ij,ij->i", qs[a], xs[b])
                up += 1e-6 * (1 + np.abs(up)) + 1e-9 * np.sqrt((qs[a] ** 2).sum(1) * (xs[b] ** 2).sum(1))
            keep = up >= least[a]
            a, b = a[keep], b[keep]
        if len(a):
            score = products_of(asked.q[part], x, a, b)
            scored += len(a)
            good = score >= least[a]
            if good.any():
                best.offer(a[good] + s, score[good], ids[b[good]])
    return scored


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: int, id_col: str, vector_col: str, block: int) -> list[DataFrame]:
    """For each block of queries (query_id, id, score): k rows a query and task; and a row a task without a query, with the numbers of
    pairs it had (``id``) and scored exactly (``score``)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    # Any rows do for the starting thresholds and the axes: they only decide how early pruning sets in.
    sample = _local(rows.limit(SAMPLE), scale)
    turns = {x.shape[1]: axes(x) for _, x in sample}
    count = asked.count()
    n_blocks = -(-count // block) or 1
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    dealt = stash(dealt, "topk-queries")[0] if n_blocks > 1 else dealt
    found = []
    for turn in range(n_blocks):
        groups = _local(dealt.where(F.col("block") == turn).select("id", "v"), scale)
        groups = [Asked(i, q, turns.get(q.shape[1], np.eye(q.shape[1])), _floor(i, q, sample, k)) for i, q in groups]
        shared = spark.sparkContext.broadcast(groups)

        def run(batches, shared=shared):
            state = [(g, Best(len(g.ids), k, g.floor)) for g in shared.value]
            pairs = scored = 0
            for b in slices(batches, ROWS):
                for ids, x in matrices(b.column(0), b.column(1)):
                    ids, x = to_integers(ids, x, scale)
                    for g, best in state:
                        if g.q.shape[1] == x.shape[1] and len(x):
                            pairs += len(g.ids) * len(x)
                            scored += search_block(g, best, ids, x)
            yield record(np.array([None]), [pairs], [scored])
            for g, best in state:
                full = best.score > NONE
                yield record(np.repeat(g.ids, k)[full.ravel()], best.id[full], best.score[full])

        found.append(rows.mapInArrow(run, "query_id long, id long, score long"))
    return found


def record(query, ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (query, ids, score)], ["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` its k best rows of ``vectors``."""
    out, found = None, search(vectors, queries, k, scale, id_col, vector_col, block)
    for part in found:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")  # at most k rows a task
        part = part.where("query_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = part.select("query_id", "rank", "id", "score")
        if len(found) > 1:
            part = stash(part, "topk-block")[0]
        out = part if out is None else out.unionByName(part)
    return out


def pruning(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(pairs, scored, pruned): how many pairs of a query and a row there are, how many were scored exactly, and the share that the
    bounds dropped (null without pairs; a query's own row counts as dropped)."""
    out = None
    for part in search(vectors, queries, k, scale, id_col, vector_col, block):
        part = part.where("query_id is null")
        out = part if out is None else out.unionByName(part)
    sums = out.agg(F.coalesce(F.sum("id"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("score"), F.lit(0)).alias("scored"))
    return sums.withColumn("pruned", F.expr("1 - try_divide(cast(scored as double), pairs)"))


def _local(df: DataFrame, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, integers) per dimension of a bounded table, on the driver."""
    t = df.toArrow()
    if not t.num_rows:
        return []
    column = lambda i: t.column(i).combine_chunks()
    found = (to_integers(i, x, scale) for i, x in matrices(column(0), column(1)))
    return [(i, x) for i, x in found if len(i)]


def _floor(ids: np.ndarray, q: np.ndarray, sample, k: int) -> np.ndarray:
    """A query's k-th best score over the sample: no row below it is among its best."""
    floor = np.full(len(ids), NONE)
    for s_ids, x in sample:
        if x.shape[1] != q.shape[1] or len(s_ids) <= k:
            continue
        for s in range(0, len(ids), QUERIES):
            score = products(q[s : s + QUERIES], x)
            score[ids[s : s + QUERIES][:, None] == s_ids[None, :]] = NONE
            floor[s : s + QUERIES] = np.partition(score, len(s_ids) - k, axis=1)[:, len(s_ids) - k]
    return floor

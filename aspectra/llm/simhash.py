"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at distance at most 2r have a common variant within distance r of both. So every
distinct fingerprint emits all its variants within half the radius; equal variants meet
in one bucket; each group of fingerprints that share a variant is linked to its smallest
member (they all lie within 2r of each other by the triangle inequality, so this star has
the same components as all pairs); links are deduplicated and their distance verified.

The variants are many times the documents, so they are dealt in ``slices`` rounds. A
variant's round is the XOR of (bit position mod slices) over its set bits, which a mask changes
in a known way: each round generates only its own variants. Each round's shuffle is freed
before the next. Variants travel packed, 8 bytes and 2 for the mask, in one row per task
and bucket; a bucket's size is set by the count of fingerprints, not by their likeness, as
the bucket is a hash of the variant.

Defined cases: null or blank text has fingerprint zero, linked like any other; repeated rows
and equal fingerprints are one node, the smallest id; rows without an id get a fingerprint
and no component; an empty table gives an empty one; other columns pass through unseen.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from aspectra.llm.common import discard, lean, shuffles_freed, slices, stash
from aspectra.llm.components import components

SLICES = 8
BUCKET_ROWS = 250_000
FEED = 512
MIX = 0x9E3779B97F4A7C15
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    words = (text or "").encode().translate(LOWER).split()  # splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)
    count = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[s : s + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(count * 2 > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) of every row; fp as a signed 64-bit integer with the same bits."""

    def run(batches):
        for b in slices(batches, 512):
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), StructType().add("id", docs.schema[id_col].dataType).add("fp", LongType()))


def ball_masks(radius: int, n_slices: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each syndrome: the masks of at most ``radius`` bits with it, and their numbers."""
    masks, syndromes = [], []
    for r in range(radius + 1):
        for bits in combinations(range(64), r):
            masks.append(sum(1 << i for i in bits))
            s = 0
            for i in bits:
                s ^= i % n_slices
            syndromes.append(s)
    masks, syndromes = np.array(masks, np.uint64), np.array(syndromes)
    return [(masks[syndromes == s], np.flatnonzero(syndromes == s).astype(np.uint16)) for s in range(n_slices)]


def syndrome(fp: np.ndarray, n_slices: int) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for i in range(64):
        out ^= ((fp >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i % n_slices)
    return out


def links(fps: DataFrame, max_bits: int = 4, n_slices: int = SLICES) -> DataFrame:
    """Star links (a, b) between distinct fingerprints ``fp`` at most ``max_bits`` apart; every such
    pair is connected through links that hold themselves. ``n_slices`` is a power of two."""
    spark = fps.sparkSession
    radius = (max_bits + 1) // 2
    table = ball_masks(radius, n_slices)
    per_fp = sum(len(m) for m, _ in table) // n_slices
    n_fps = fps.count()
    buckets = max(8 * spark.sparkContext.defaultParallelism, n_fps * per_fp // BUCKET_ROWS + 1)
    ordered = np.zeros(sum(len(m) for m, _ in table), np.uint64)
    for m, k in table:
        ordered[k] = m

    def emit(turn: int):
        def run(batches):
            # FEED bounds the variants of a slice in memory; a bucket's blobs grow to a few hundred KB.
            out_v, out_m, held = [], [], 0

            def flush():
                v, m = np.concatenate(out_v), np.concatenate(out_m)
                where = ((v * np.uint64(MIX)) >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(where.astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
                v, m, where = v[order], m[order], where[order]
                at = np.searchsorted(where, np.arange(buckets + 1))
                full = [k for k in range(buckets) if at[k] < at[k + 1]]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([v[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()),
                        pa.array([m[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()),
                    ],
                    ["bucket", "variants", "masks"],
                )

            for b in slices(batches, FEED):
                fp = b.column(0).to_numpy().view(np.uint64)
                s = syndrome(fp, n_slices)
                for k in range(n_slices):
                    some = fp[s == k]
                    masks, numbers = table[k ^ turn]
                    if len(some) and len(masks):
                        out_v.append((some[:, None] ^ masks[None, :]).ravel())
                        out_m.append(np.tile(numbers, len(some)))
                        held += len(out_v[-1])
                if held >= 1 << 21:
                    yield flush()
                    out_v, out_m, held = [], [], 0
            if held:
                yield flush()

        return run

    def meet(batches):
        """Partitions hold whole buckets, sorted by bucket."""
        now, vs, ms = None, [], []

        def pairs():
            v, m = np.concatenate(vs), np.concatenate(ms)
            fp = v ^ ordered[m]
            order = np.argsort(v, kind="stable")
            v, fp = v[order], fp[order]
            same = v[1:] == v[:-1]
            if not same.any():
                return None
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            size = np.diff(np.append(starts, len(v)))
            least = np.repeat(np.minimum.reduceat(fp, starts), size)
            keep = least != fp
            both = np.unique(np.stack([least[keep], fp[keep]], 1), axis=0)
            near = np.bitwise_count(both[:, 0] ^ both[:, 1]) <= max_bits
            both = both[near].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for b in batches:
            for bucket, v, m in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if bucket != now and vs:
                    if (found := pairs()) is not None:
                        yield found
                    vs, ms = [], []
                now = bucket
                vs.append(np.frombuffer(v.as_buffer(), np.uint64))
                ms.append(np.frombuffer(m.as_buffer(), np.uint16))
        if vs and (found := pairs()) is not None:
            yield found

    found, paths = None, []
    for turn in range(n_slices):
        dealt = fps.select("fp").mapInArrow(lean(emit(turn)), "bucket int, variants binary, masks binary")
        dealt = dealt.repartition(-(-buckets // 4), "bucket").sortWithinPartitions("bucket")
        with shuffles_freed(spark):
            part, path = stash(dealt.mapInArrow(lean(meet), "a long, b long"), "simhash-links")
        paths.append(path)
        found = part if found is None else found.unionByName(part)
    out, _ = stash(found.distinct(), "simhash-edges")
    discard(spark, *paths)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component_id, first): every row's fingerprint, the smallest id reachable by links, and whether the row has
    its component's smallest (id, fp). Equal rows are all first; where ids repeat, components may share a component_id."""
    with shuffles_freed(docs.sparkSession):
        fps, _ = stash(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fps")
        nodes, _ = stash(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
        of, _ = stash(components(links(nodes.select("fp"), max_bits)), "simhash-components")
        # A component's id is the smallest document id of its fingerprints.
        placed = nodes.join(of.select(F.col("node").alias("fp"), "component"), "fp", "left")
        placed = placed.select("fp", "least", F.coalesce("component", "fp").alias("root"))
        smallest = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp")))
        roots = placed.groupBy("root").agg(smallest.alias("head"))
        heads = placed.join(roots, "root").select("fp", F.col("head.least").alias("component_id"), F.col("head.fp").alias("head_fp"))
        classes, _ = stash(heads, "simhash-classes")
    first = (F.col("id") == F.col("component_id")) & (F.col("fp") == F.col("head_fp"))
    return fps.join(classes, "fp").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), first.alias("first"))

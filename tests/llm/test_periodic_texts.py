"""Substring dedup on texts of short periods and on a group of copies: results by brute force, memory by measurement."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.llm import substring_dedup as SD
from tests.llm import brute

RULER, CODE = "=" * 300, "the 23 bytes of a line\n"


def removed(spark, docs, parts=3, length=50, anchor=24):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    out = SD.remove_repeats(df, length, anchor).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def test_periodic_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(SD, "HITS", 37)
    rnd = random.Random(3)
    docs = [
        (1, "a" * 400), (2, "x" + "a" * 333 + "y" + "a" * 60), (3, "ab" * 200), (4, "ba" * 100 + "c" + "ab" * 99), (5, CODE * 20), (6, CODE[7:] + CODE * 9 + "end"),
        (7, RULER + "own" + RULER), (8, RULER), (9, RULER), (10, "a" * 49), (11, "abc" * 90 + RULER[:80]), (12, " " * 120 + "\n" + " " * 70),
    ]
    for i in range(13, 40):
        parts = [c * rnd.randint(1, 150) for c in rnd.choices(["a", "ab", "abcd", "=", "z" * 5, "the word "], k=4)]
        docs.append((i, "".join(parts) + str(i)))
    assert removed(spark, docs) == brute.removed(docs)
    for length, anchor in ((12, 5), (20, 9)):
        assert removed(spark, docs, 2, length, anchor) == brute.removed(docs, length)


def test_steps():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(1, 30))
        which, piece = rnd.integers(0, 2, n), np.sort(rnd.integers(0, 2, n))
        at = np.cumsum(rnd.integers(1, 4, n))
        start, count, step = SD.steps(which, piece, at, 2)
        got = [(int(which[s]), int(piece[s]), int(at[s] + k * d)) for s, c, d in zip(start, count, step) for k in range(c)]
        assert got == list(zip(which.tolist(), piece.tolist(), at.tolist()))
        assert (step <= 2).all()


def test_united_spans():
    s = np.array([(2, 1, 5, 9), (1, 7, 0, 50), (1, 7, 40, 60), (1, 8, 45, 46), (1, 7, 60, 61), (2, 1, 10, 12), (1, 7, 10, 20)], SD.SPAN)
    assert SD.united(s).tolist() == [(1, 7, 0, 61), (1, 8, 45, 46), (2, 1, 5, 9), (2, 1, 10, 12)]


@pytest.mark.parametrize("unit", ["a", "ab", CODE])
def test_a_block_of_a_period_takes_little_memory(unit):
    """Peak of the segments' step over 4 MB; a row of bytes and an index for each place would be gigabytes."""
    import pyarrow as pa

    text = (unit * ((4 << 20) // len(unit) + 1))[: 4 << 20]
    run, width, columns = SD._segments(50, 24, 8)
    h = np.unique(SD.Runs([text[:1000].encode()], 50, 24).hash)
    rows = [(0, 0, h.tobytes(), None, None, None), (0, 2, None, 1, 5, text)]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["grp", "kind", "blob", "id", "crc", "text"])
    tracemalloc.start()
    places = sum(len(p) for b in run([batch]) for p in b.column(6).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900 << 20 and places < 100_000


def test_a_large_group_of_copies(spark):
    text = "a copy of more than fifty bytes that a third of all rows hold. " * 2
    docs = [(i, text if i % 3 else f"{i} own text {i}") for i in range(1500)]
    assert removed(spark, docs, 8) == brute.removed(docs)

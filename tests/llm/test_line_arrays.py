"""The line arrays as files that documents probe in place."""

from __future__ import annotations

import io

import numpy as np
import pytest

from aspectra.llm import line_dedup
from tests.llm import brute
from tests.llm.test_operators import local_docs


class Bytes(io.BytesIO):
    reads = 0

    def read_at(self, n, at):
        self.reads += n
        return self.getvalue()[at : at + n]


def shard(n: int):
    rnd = np.random.default_rng(n)
    pairs = np.zeros(n, line_dedup.PAIR)
    pairs["hi"], pairs["lo"] = rnd.integers(0, 1 << 63, (2, n)).astype(np.uint64)
    count, top = rnd.integers(2, 9, n), rnd.integers(-5, 99, n)
    out = Bytes()
    line_dedup.write_shard(out, pairs, count, top)
    return pairs, count, top, out


@pytest.mark.parametrize("n", [1, 2, 447, 30_000])
def test_a_shard_answers_for_its_keys_and_no_others(n):
    pairs, count, top, out = shard(n)
    held = line_dedup.ShardFile(out)
    got = held.probe(pairs)
    assert (got[0] == count).all() and (got[1] == top).all()
    other = pairs.copy()
    other["hi"] += np.uint64(1)
    assert not held.probe(other)[0].any()
    assert held.probe(pairs[:0])[0].shape == (0,)


def test_few_keys_read_few_pages():
    pairs, count, top, out = shard(30_000)
    held = line_dedup.ShardFile(out)
    out.reads = 0
    few = np.repeat(pairs[[5, 29_999, 17]], 4)
    got = held.probe(few)
    assert got[0].tolist() == np.repeat(count[[5, 29_999, 17]], 4).tolist() and got[1].tolist() == np.repeat(top[[5, 29_999, 17]], 4).tolist()
    assert out.reads < len(out.getvalue()) / 4


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_shards", [None, 37])
def test_documents_probe_without_an_exchange(spark, n_shards):
    docs = local_docs(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.dedup_lines(frame, n_shards=n_shards)
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: t for (i, _), t in zip(docs, brute.drop_lines(docs))}


def test_counts_decide(spark):
    line = "a line that some documents share"
    docs = spark.createDataFrame([(i, f"{line}\n{i}") for i in range(4)], "doc_id long, text string")
    for least, dropped in ((2, 3), (4, 3), (5, 0)):
        got = line_dedup.dedup_lines(docs, min_docs=least)
        assert {r["doc_id"]: r["_n_dropped"] for r in got.collect()} == {i: int(i < dropped) for i in range(4)}


def test_other_columns_pass(spark):
    docs = spark.sql("select 1L as id, 'x\ny' as text, array(1, null) as lines, named_struct('a.b', 2) as doc, 7L as doc_id, null as void_ from range(3)")
    docs = docs.selectExpr("id", "text", "lines", "doc", "doc_id", "cast(void_ as int) as `n lines`")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns + ["_n_lines", "_n_dropped"]
    assert got.drop("_n_lines", "_n_dropped").collect() == docs.collect()

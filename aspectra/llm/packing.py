"""Packing: concatenate all documents' token ids and cut the stream into fixed windows.

Two passes. The first tokenises every document once, in place, and writes its ids with a
running token count inside its write task. The totals of those tasks (one small row per
task) give, as prefix sums, where each task's stream starts; so the second pass knows the
global offset of every document and cuts it at multiples of the window length, task by
task, with no shuffle and no order to keep. Only the last window can be short, so padding
is at most one window for the whole corpus.

Defined cases: a null text is empty (its document is the end id alone); a repeated row is
a document of its own; a document longer than a window becomes several pieces; an empty
table has no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import lean, slices, stash, type_of
from aspectra.llm.tokens import encoder

ROWS = 512


def token_runs(docs: DataFrame, tokenizer: str, end_id: int, pieces: str, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """First pass: (part, local_start, id, n, ids) with ids packed; part numbers the task."""

    def run(batches):
        enc, part, at = encoder(tokenizer, pieces, special_as_text), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        width = len(end)
        for b in slices(batches, ROWS):
            ids = [x + end for x in enc.encode_all(b.column(1).to_pylist())]
            n = np.array([len(x) // width for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int64)), pa.array(start), b.column(0), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "local_start", "id", "n", "ids"],
            )

    schema = f"part long, local_start long, id {type_of(docs, id_col)}, n long, ids binary"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def cut_runs(runs: DataFrame, id_name: str, window: int, with_ids: bool) -> DataFrame:
    """Second pass: rows (start, id, n, ids) with the global start -> pieces."""

    def cut(batches):
        for b in slices(batches, ROWS):
            rows, who = [], []
            for i, (start, n, ids) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                wide = np.frombuffer(ids, np.dtype(f"<u{len(ids) // n}")).astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(start + done, window)
                    take = min(n - done, window - offset)
                    piece = wide[done : done + take].tobytes()
                    rows.append((done, take, zlib.crc32(piece), n, sequence, offset, done > 0, done + take < n, piece if with_ids else None))
                    who.append(i)
                    done += take
            cols = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(who, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                [id_name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues", "continued", "ids"],
            )

    schema = (
        f"{id_name} {type_of(runs, 'id')}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, continues boolean, continued boolean, ids binary"
    )
    return runs.select("start", "id", "n", "ids").mapInArrow(lean(cut), schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    pieces: str = "whole",
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    special_as_text: bool = True,
) -> DataFrame:
    """Pieces of all documents. The boundary record of a cut is in ``continues`` (the piece
    starts inside its document) and ``continued`` (the document goes on in the next window).
    ``ids``: the piece's ids as little-endian 32-bit integers, null unless ``with_ids``."""
    spark = docs.sparkSession
    runs, _ = stash(token_runs(docs, tokenizer, end_id, pieces, id_col, text_col, special_as_text), "pack-runs")
    # One row per write task, so this is bounded by the number of tasks, not of documents.
    totals = runs.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("total")).orderBy("part").collect()
    offsets, at = [], 0
    for r in totals:
        offsets.append((r["part"], at))
        at += r["total"]
    table = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    placed = runs.join(table, "part").withColumn("start", F.col("before") + F.col("local_start"))
    return cut_runs(placed, id_col, window, with_ids)

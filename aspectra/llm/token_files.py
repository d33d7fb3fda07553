"""Token-id files: independent zstandard frames with a trailing seek table.

Layout of one file (all integers little-endian)::

    frame*        each a complete zstandard frame; its content is
                  u32 n_docs, u8 id width, n_docs x (u8 has_id, i64 doc_id, u64 n_tokens), ids
    doc table     skippable frame 0x184D2A50: n_frames x (i64 first doc_id, i64 last doc_id)
    seek table    skippable frame 0x184D2A5E of the zstandard seekable format: n_frames x
                  (u32 compressed size, u32 content size, u32 low half of XXH64 of the content),
                  then u32 n_frames, u8 0x80 (checksums present), u32 0x8F92EAB1

Any zstandard tool reads the file as a whole. A reader that wants few documents reads the
tail, finds their frames and inflates only those, checking each frame's checksum.

Files are written in ascending document order: one range partition, sorted, per file. A
file's token total is in the manifest; prefix sums over files give global starts.

Defined cases: null text is empty (its document is the end id alone); rows without an id
come first; repeated rows are documents of their own; a text longer than a frame is a
frame of its own; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.common import shuffle_partitions, shuffles_freed, slices, stash
from aspectra.llm.shared_files import new_file, open_random
from aspectra.llm.tokens import encoder
from aspectra.session import scratch_path

FRAME_BYTES = 1 << 20
DOC_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = struct.Struct("<Bqq")
MANIFEST = "part long, path string, n_docs long, n_tokens long, n_frames long"


class FrameWriter:
    def __init__(self, out, width: int, level: int = 3):
        self.out, self.width, self.zip = out, width, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.docs: list[tuple] = []
        self.ids: list[bytes] = []
        self.size, self.frames, self.ranges = 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // self.width))
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        head = [struct.pack("<IB", len(self.docs), self.width)]
        head += [ENTRY.pack(d is not None, d or 0, n) for d, n in self.docs]
        content = b"".join(head + self.ids)
        frame = self.zip.compress(content)
        self.out.write(frame)
        self.frames.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ranges.append((self.docs[0][0] or 0, self.docs[-1][0] or 0))
        self.docs, self.ids, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<qq", *r) for r in self.ranges)
        self.out.write(struct.pack("<II", DOC_MAGIC, len(table)) + table)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        self.out.close()


class FrameReader:
    def __init__(self, file):
        self.file, self.zip = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        at = size - 9 - 12 * n
        self.frames = list(struct.iter_unpack("<III", file.read_at(12 * n, at)))
        self.ranges = list(struct.iter_unpack("<qq", file.read_at(16 * n, at - 8 - 16 * n)))
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)])

    def frame(self, k: int):
        """Documents of frame k: (doc_id, ids as a NumPy array)."""
        packed, size, check = self.frames[k]
        content = self.zip.decompress(self.file.read_at(packed, int(self.starts[k])), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        n, width = struct.unpack_from("<IB", content)
        at = 5 + ENTRY.size * n
        for has, doc, count in ENTRY.iter_unpack(content[5:at]):
            yield (doc if has else None), np.frombuffer(content, f"<u{width}", count, at)
            at += count * width

    def find(self, doc_id: int):
        """Ids of every document with that id, inflating only frames that can hold it."""
        for k, (first, last) in enumerate(self.ranges):
            if first <= doc_id <= last:
                yield from (ids for d, ids in self.frame(k) if d == doc_id)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 2, pieces: str = "whole", id_col: str = "doc_id", text_col: str = "text",
    root: str | None = None, files: int | None = None, special_as_text: bool = True,
) -> DataFrame:
    """Write all documents; returns the manifest, one row per file, as a stashed table."""
    spark = docs.sparkSession
    root = root or scratch_path(spark, "token-files")

    def write(batches):
        enc, part, w, n_docs, n_tokens = encoder(tokenizer, pieces, special_as_text), TaskContext.get().partitionId(), None, 0, 0
        end = np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches, 512):
            if w is None:
                path, out = new_file(root, f"tokens-{part:06d}", ".zst")
                w = FrameWriter(out, len(end))
            for d, x in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                ids = x + end
                w.add(d, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // len(end)
        if w is not None:
            w.close()
            row = {"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_frames": [len(w.frames)]}
            yield pa.RecordBatch.from_pydict(row)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(files or shuffle_partitions(spark), F.col("id").asc_nulls_first())
    with shuffles_freed(spark):
        manifest, _ = stash(dealt.sortWithinPartitions(F.col("id").asc_nulls_first()).mapInArrow(write, MANIFEST), "token-manifest")
    return manifest


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, ids (32-bit; null unless ``with_ids``)."""
    # One row per file.
    files = manifest.orderBy("part").select("path", "n_tokens").collect()
    placed, at = [], 0
    for r in files:
        placed.append((r["path"], at))
        at += r["n_tokens"]
    if not placed:
        placed_df = spark.createDataFrame([], "path string, before long")
    else:
        placed_df = spark.createDataFrame(spark.sparkContext.parallelize(placed, len(placed)), "path string, before long")

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_random(path) as f:
                    reader = FrameReader(f)
                    for k in range(len(reader.frames)):
                        rows = []
                        for doc, ids in reader.frame(k):
                            wide = ids.astype("<u4").tobytes()
                            rows.append((doc, start, len(ids), zlib.crc32(wide), wide if with_ids else None))
                            start += len(ids)
                        kinds = [pa.int64()] * 4 + [pa.binary()]
                        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed_df.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")

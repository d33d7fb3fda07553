"""Line dedup through a sharded minimal perfect hash.

1. Every task hashes its documents' lines (128 bits) and pre-aggregates (documents, largest
   document id) per hash, so a line that every document has leaves a task once per block.
   Blocks travel packed, one row per shard; the shard is taken from the hash.
2. Each shard sums its blocks, keeps hashes found in two documents or more (others can't lose a
   line, whatever the threshold) and writes one file of arrays to the shared folder, addressed by a
   minimal perfect hash: levels of bits with ranks, then one half of the hash as fingerprint, the
   count, and the largest document id. No keys are stored twice and no lines at all.
3. The documents are read again, and every task probes the files in place: a block's hashes are
   sorted by shard, and of each shard the pages they point at are read, or the array as a whole
   where that is less. Neither lines nor texts are shuffled; the counts decide which lines go.

There is a shard per ``SHARD_BYTES`` of text, which are measured, so a shard's arrays are bounded. The
driver learns the name of each shard's file, 16 bytes per shard: 25 MB for 100 TB of text.
Files of failed attempts are never looked at, as names come from the committed table.

A key is the line without white space (0x20, 0x09-0x0D) at its ends, A-Z lower-cased. Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines,
except in the document with the largest id that holds them.

Defined cases: null or empty text is one empty line, and stays as it is; a repeated row is a
document of its own, and rows that share the largest id all keep the line; a null id is
below every other; a text left without lines is empty; all columns pass through unchanged but
the text; an empty table stays empty. Keys are told apart by 128 bits of XXH3 when counted; a line
that isn't in the arrays would have to share 64 bits with the key at its slot to be taken for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.llm.common import lean, shuffles_freed, slices, stash
from aspectra.llm.shared_files import new_file, open_random
from aspectra.session import scratch_path

WHITE = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
BLOCK_LINES = 200_000
SHARD_BYTES = 64 << 20  # text for which there is one shard
BLOCK_BYTES = 32 << 20  # text that a task holds while it probes
PAIR = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def key_hash(line: str, min_chars: int) -> bytes | None:
    key = line.strip(WHITE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


# ---- minimal perfect hash: levels of bit arrays, a key's slot is the rank of its bit ----


def _slot(lo: np.ndarray, level: int, size: int) -> np.ndarray:
    x = lo ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_levels(lo: np.ndarray, hi: np.ndarray, gamma: float = 2.0) -> list[np.ndarray]:
    """Bit arrays: at each level the keys that are alone in their slot set its bit, the others go
    on. Keys with equal ``lo`` can't part by it, so ``hi`` is mixed in."""
    levels, rest = [], lo ^ (hi * np.uint64(0x9FB21C651E98DF25))
    while len(rest):
        size = max(8, int(gamma * len(rest)))
        at = _slot(rest, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
        if len(levels) > 200:
            raise ValueError("equal keys")
    return levels


class Levels:
    """The levels in memory, to number the keys of a shard that is being built."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, before = levels, [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - 1)
            before += int(bits.sum())

    def index(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit (such a key isn't in the set)."""
        out, left = np.full(len(lo), -1, np.int64), np.arange(len(lo))
        x = lo ^ (hi * np.uint64(0x9FB21C651E98DF25))
        for k, bits in enumerate(self.levels):
            at = _slot(x[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out


# ---- a shard's file: header page, levels as cells of rank and bits, fingerprints, counts, largest ids ----

PAGE = 4096
CELL_BITS = 448
CELL = np.dtype([("rank", "<u8"), ("words", "<u8", 7)])  # set bits before the cell, the cell's bits
MARK, COUNT, TOP = np.dtype("<u8"), np.dtype("<u4"), np.dtype("<i8")


def write_shard(out, pairs: np.ndarray, count: np.ndarray, top: np.ndarray) -> None:
    """Write the arrays of distinct keys ``pairs``."""
    levels = build_levels(pairs["lo"], pairs["hi"])
    slot = Levels(levels).index(pairs["lo"], pairs["hi"])
    header = np.zeros(PAGE // 8, "<u8")
    header[:2] = len(levels), len(pairs)
    header[2 : 2 + len(levels)] = [len(x) for x in levels]
    out.write(header.tobytes())
    before = 0
    for bits in levels:
        cells = np.zeros(-(-len(bits) // CELL_BITS), CELL)
        padded = np.zeros(len(cells) * CELL_BITS, bool)
        padded[: len(bits)] = bits
        cells["words"] = np.packbits(padded, bitorder="little").view("<u8").reshape(-1, 7)
        held = np.bitwise_count(cells["words"]).sum(axis=1, dtype=np.uint64)
        cells["rank"] = before + np.cumsum(held) - held
        before += int(held.sum())
        out.write(cells.tobytes())
    for kind, values in ((MARK, pairs["hi"]), (COUNT, np.minimum(count, 0xFFFFFFFF)), (TOP, top)):
        array = np.zeros(len(pairs), kind)
        array[slot] = values
        out.write(array.tobytes())


class ShardFile:
    """A shard's arrays, probed where they lie."""

    def __init__(self, file):
        self.file = file
        header = np.frombuffer(file.read_at(PAGE, 0), "<u8").astype(np.int64)
        self.n, at = int(header[1]), PAGE
        self.levels = []
        for size in header[2 : 2 + header[0]].tolist():
            cells = -(-size // CELL_BITS)
            self.levels.append((size, at, cells))
            at += cells * CELL.itemsize
        self.marks, self.counts = at, at + self.n * MARK.itemsize
        self.tops = self.counts + self.n * COUNT.itemsize

    def fetch(self, base: int, kind: np.dtype, n: int, index: np.ndarray) -> np.ndarray:
        """Items of the array of ``n`` at ``base``: by pages, or whole where that reads less."""
        whole, per = n * kind.itemsize, PAGE // kind.itemsize
        pages = np.unique(index // per)
        if len(pages) * PAGE >= whole:
            return np.frombuffer(self.file.read_at(whole, base), kind)[index]
        held = b"".join(self.file.read_at(PAGE, base + p * PAGE) for p in pages[:-1].tolist())
        held += self.file.read_at(min(PAGE, whole - int(pages[-1]) * PAGE), base + int(pages[-1]) * PAGE)
        return np.frombuffer(held, kind)[np.searchsorted(pages, index // per) * per + index % per]

    def probe(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) of each key; count 0 where the shard doesn't have it."""
        count, top = np.zeros(len(pairs), np.int64), np.full(len(pairs), NO_ID, np.int64)
        slot, left = np.full(len(pairs), -1, np.int64), np.arange(len(pairs))
        x = pairs["lo"] ^ (pairs["hi"] * np.uint64(0x9FB21C651E98DF25))
        for k, (size, base, cells) in enumerate(self.levels):
            if not len(left):
                break
            at = _slot(x[left], k, size)
            cell = self.fetch(base, CELL, cells, at // CELL_BITS)
            word, bit = at % CELL_BITS // 64, (at % 64).astype(np.uint64)
            here = cell["words"][np.arange(len(at)), word]
            hit = (here >> bit & np.uint64(1)).astype(bool)
            earlier = np.where(np.arange(7) < word[:, None], np.bitwise_count(cell["words"]), 0).sum(axis=1)
            rank = cell["rank"].astype(np.int64) + earlier + np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[hit]] = rank[hit]
            left = left[~hit]
        some = np.flatnonzero(slot >= 0)
        if len(some):
            some = some[self.fetch(self.marks, MARK, self.n, slot[some]) == pairs["hi"][some]]
        if len(some):
            count[some] = self.fetch(self.counts, COUNT, self.n, slot[some])
            top[some] = self.fetch(self.tops, TOP, self.n, slot[some])
        return count, top


# ---- passes ----


def _shard(hi: np.ndarray, n: int) -> np.ndarray:
    return ((hi >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _by_shard(pairs: np.ndarray, n: int):
    """Order that sorts the hashes by shard, and (shard, from, to) of each."""
    where = _shard(pairs["hi"], n)
    order = np.argsort(where, kind="stable")
    at = np.searchsorted(where[order], np.arange(n + 1))
    return order, [(k, at[k], at[k + 1]) for k in np.flatnonzero(at[1:] > at[:-1]).tolist()]


def _counts(n_shards: int, min_chars: int):
    def run(batches):
        seen: dict[bytes, list[int]] = {}

        def flush():
            pairs = np.frombuffer(b"".join(seen), PAIR)
            n, top = np.array(list(seen.values()), np.int64).T
            order, parts = _by_shard(pairs, n_shards)
            pairs, n, top = pairs[order], n[order], top[order]
            rows = [(k, pairs[a:z].tobytes(), n[a:z].tobytes(), top[a:z].tobytes()) for k, a, z in parts]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 3)], ["shard", "keys", "n", "top"])

        for b in slices(batches, 512):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = NO_ID if doc is None else doc
                keys = {key_hash(x, min_chars) for x in (text or "").split("\n")}
                keys.discard(None)
                for k in keys:
                    if (e := seen.get(k)) is None:
                        seen[k] = [1, doc]
                    else:
                        e[0] += 1
                        e[1] = max(e[1], doc)
            if len(seen) >= BLOCK_LINES:
                yield flush()
                seen.clear()
        if seen:
            yield flush()

    return run


def _arrays(root: str):
    """One file per shard that holds a key of two documents; rows (shard, name)."""

    def run(batches):
        now, held = None, []

        def build():
            pairs, n, top = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in ((0, PAIR), (1, np.int64), (2, np.int64)))
            order = np.lexsort((pairs["lo"], pairs["hi"]))
            pairs, n, top = pairs[order], n[order], top[order]
            first = np.concatenate([[0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1])
            n, top, pairs = np.add.reduceat(n, first), np.maximum.reduceat(top, first), pairs[first]
            keep = n >= 2
            if not keep.any():
                return None
            uri, out = new_file(root, "arrays", ".bin")
            with out:
                write_shard(out, pairs[keep], n[keep], top[keep])
            name = bytes.fromhex(uri[-len(".bin") - 32 : -len(".bin")])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name], pa.binary())], ["shard", "name"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != now and held:
                    if (made := build()) is not None:
                        yield made
                    held = []
                now = row[0]
                held.append(row[1:])
        if held and (made := build()) is not None:
            yield made

    return run


class ArrayFiles:
    """The files of all shards below ``root``: 16 bytes of name each, zeros where a shard has no file."""

    def __init__(self, root: str, n_shards: int, names: dict[int, bytes]):
        self.root, self.n_shards, self.names = root, n_shards, np.zeros((n_shards, 16), np.uint8)
        for k, name in names.items():
            self.names[k] = np.frombuffer(name, np.uint8)

    def probe(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) of each key; count 0 for keys that no file has."""
        count, top = np.zeros(len(pairs), np.int64), np.full(len(pairs), NO_ID, np.int64)
        order, parts = _by_shard(pairs, self.n_shards)
        for k, a, z in parts:
            if self.names[k].any():
                with open_random(f"{self.root}/arrays-{self.names[k].tobytes().hex()}.bin") as file:
                    count[order[a:z]], top[order[a:z]] = ShardFile(file).probe(pairs[order[a:z]])
        return count, top


def line_arrays(docs: DataFrame, min_chars: int = 20, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> ArrayFiles:
    """Build the shards' files: (documents, largest id) of every line found in two documents or more."""
    spark = docs.sparkSession
    if n_shards is None:
        n_shards = 1 + (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // SHARD_BYTES
    rows = docs.select(F.col(id_col).cast("long"), text_col)
    blocks = rows.mapInArrow(lean(_counts(n_shards, min_chars)), "shard int, keys binary, n binary, top binary")
    root = scratch_path(spark, "line-arrays")
    files = blocks.repartition(-(-n_shards // 2), "shard").sortWithinPartitions("shard").mapInArrow(lean(_arrays(root)), "shard int, name binary")
    with shuffles_freed(spark):
        files, _ = stash(files, "line-array-files")
    return ArrayFiles(root, n_shards, {r["shard"]: bytes(r["name"]) for r in files.collect()})


def _cut(files: ArrayFiles, min_chars: int, min_docs: int, text_at: int):
    """Rows (doc, id) with the text of ``doc`` cleaned, block by block."""

    def finish(held):
        keys, owners, places, ids = [], [], [], []
        for b, texts in held:
            for doc, text in zip(b.column(1).to_pylist(), texts):
                for i, line in enumerate((text or "").split("\n")):
                    if (k := key_hash(line, min_chars)) is not None:
                        keys.append(k)
                        owners.append(len(ids))
                        places.append(i)
                ids.append(NO_ID if doc is None else doc)
        owner = np.array(owners, np.int64)
        count, top = files.probe(np.frombuffer(b"".join(keys), PAIR))
        drop = np.flatnonzero((count >= min_docs) & (np.array(ids, np.int64)[owner] < top))
        gone: dict[int, set[int]] = {}
        for j in drop.tolist():
            gone.setdefault(owners[j], set()).add(places[j])
        row = 0
        for b, texts in held:
            kept, before, dropped = [], [], []
            for t in texts:
                lines = gone.get(row, ())
                before.append((t or "").count("\n") + 1)
                dropped.append(len(lines))
                kept.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in lines) if lines else t)
                row += 1
            fields = b.column(0).flatten()
            fields[text_at] = pa.array(kept, fields[text_at].type)
            doc = pa.StructArray.from_arrays(fields, fields=list(b.column(0).type))
            yield pa.RecordBatch.from_arrays([doc, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], ["doc", "n_lines", "n_dropped"])

    def run(batches):
        held, size = [], 0
        for b in slices(batches, 512):
            texts = b.column(0).flatten()[text_at].to_pylist()
            held.append((b, texts))
            size += sum(len(t) for t in texts if t)
            if size >= BLOCK_BYTES:
                yield from finish(held)
                held, size = [], 0
        if held:
            yield from finish(held)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the text cleaned, plus ``_n_lines`` (before) and ``_n_dropped``."""
    files = line_arrays(docs, min_chars, n_shards, id_col, text_col)
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).cast("long").alias("id"))
    schema = T.StructType([T.StructField("doc", whole.schema["doc"].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = whole.mapInArrow(lean(_cut(files, min_chars, min_docs, names.index(text_col))), schema)
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in names], F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))

"""Removal of repeated byte strings by column-wise suffix sorting of many short documents.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a
smaller id. Documents are far too long for one symbol of each per round, so they are first
cut, without loss, into short overlapping strings on which the column-wise construction runs:

1. *Anchors.* Every string of ``length`` bytes (a window) has one anchor: its substring of ``anchor`` bytes
   with the smallest hash, the leftmost of equals. Equal windows have equal anchors at equal
   places. Distinct anchor hashes are counted over documents, packed and pre-aggregated per
   block; only anchors found in two documents or more can matter.
2. *Segments.* Runs of neighbouring windows with one such anchor become a segment, placed in a fixed
   frame of columns so that the anchor starts at the same column in all. Equal windows
   thus stand at the same columns of segments in the same bucket (by anchor hash). Equal
   segments of a block go on once, with the smallest document id, so what a bucket gets of a passage
   follows the number of blocks that hold it, not of documents. Equal ones a fixed step apart, as rulers, padding and
   other text of a short period give them, are one place with a count.
3. *Column-wise construction.* In a bucket, from the last column to the first, one symbol of each
   segment is inserted in front of its suffix: the symbols in suffix order are the round's column
   of the Burrows-Wheeler transform, a stable sort by it is the next suffix order, and the common
   prefix of neighbours is one more than the least one between their old places. Columns are
   read from a file in the shared folder, one after another. Suffixes whose common prefix is at least ``length``
   are equal windows; the smallest id among them decides.
4. Verdicts, a bit per window, go back to the blocks, become spans, and the spans meet their
   documents, where they are united and cut out.

Exact copies of a whole text are settled by digest beforehand: all but the first lose everything.

Defined cases: null text is empty; matches never cross documents; strings are judged on the input; texts
shorter than ``length`` stay; overlaps inside one document count only against smaller ids; rows that
share an id are not smaller than each other; a null id is larger than every other; invalid UTF-8 can be
left over, so the kept bytes are binary; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import discard, shuffle_partitions, shuffles_freed, slices, stash
from aspectra.llm.shared_files import new_file, open_stream, remove_file
from aspectra.operators.match import salted_join
from aspectra.session import scratch_path

LENGTH = 50
ANCHOR = 24
CHUNK = 4 << 20
BLOCK_ANCHORS = 1 << 20
PART_BYTES = 16 << 20
NO_ID = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15


def rolling_hash(a: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each position (the last k - 1 are cut off)."""
    bits, power, h = k, BASE, a.astype(np.uint64) + np.uint64(1)
    out, out_len, n = None, 0, 1
    while bits:
        if bits & 1:
            if out is None:
                out, out_len = h, n
            else:  # the n bytes from here, then the out_len bytes after them
                size = len(h) - out_len
                shift = np.uint64(pow(BASE, out_len, 1 << 64))
                out, out_len = h[:size] * shift + out[n : n + size], out_len + n
        bits >>= 1
        if bits:
            h = h[:-n] * np.uint64(power) + h[n:]
            power, n = power * power % (1 << 64), 2 * n
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, m = 1, x
    while 2 * n <= w:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[: len(x) - w + 1], m[w - n : w - n + len(x) - w + 1]) if w > n else m


def chunks_of(data: bytes, length: int):
    """(offset, piece) of a text: pieces overlap by length - 1, so every window is in just one."""
    for s in range(0, max(1, len(data) - length + 1), CHUNK):
        yield s, data[s : s + CHUNK + length - 1]


class Runs:
    """Runs of windows with one anchor over concatenated pieces: first and last window, anchor
    position and hash, and the piece each lies in."""

    def __init__(self, pieces: list[bytes], length: int, anchor: int):
        a = self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(size)
        self.first = self.last = self.at = self.piece = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if len(a) < length:
            return
        h = rolling_hash(a, anchor)
        low = np.uint64((1 << max(1, int(len(a)).bit_length())) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, length - anchor + 1) & low).astype(np.int64)
        left = np.repeat(self.ends, size)[: len(at)] - np.arange(len(at))
        ok = np.flatnonzero(left >= length)
        if not len(ok):
            return
        p = at[ok]
        new = np.flatnonzero((p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)) + 1
        s, e = np.concatenate([[0], new]), np.concatenate([new, [len(ok)]]) - 1
        self.first, self.last, self.at = ok[s], ok[e], p[s]
        self.hash = h[self.at]
        self.piece = np.searchsorted(self.ends, self.first, side="right")


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _pieces(rows, length: int):
    """Batches of (row, offset, piece) with about CHUNK bytes each."""
    held, size = [], 0
    for row, data in rows:
        for offset, piece in chunks_of(data, length):
            held.append((row, offset, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchors(length: int, anchor: int, buckets: int, groups: int):
    """Distinct (hash, group) per block; ``many`` marks hashes of two documents of the block."""

    def run(batches):
        hs, gs, ds, held, docs = [], [], [], 0, 0

        def flush():
            h, g, d = np.concatenate(hs), np.concatenate(gs), np.concatenate(ds)
            order = np.argsort(h, kind="stable")  # documents stay in order
            h, g, d = h[order], g[order], d[order]
            first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            size = np.diff(np.append(first, len(h)))
            many = np.repeat(d[first] != d[first + size - 1], size)
            b = _bucket(h, buckets)
            order = np.lexsort((h, g, b))
            h, g, b, many = h[order], g[order], b[order], many[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            h, g, b, many = h[once], g[once], b[once], many[once]
            cut = np.searchsorted(b, np.arange(buckets + 1))
            rows = [
                (k, h[x:y].tobytes(), np.bincount(g[x:y], minlength=groups).astype("<u4").tobytes(), np.packbits(many[x:y]).tobytes())
                for k, (x, y) in enumerate(zip(cut, cut[1:])) if x < y
            ]
            kinds = [pa.int32()] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "hashes", "sizes", "many"])

        def rows_of():
            for b in slices(batches, 256):
                yield from zip(b.column(0).to_pylist(), ((t or "").encode() for t in b.column(1).to_pylist()))

        for held_pieces in _pieces(enumerate_rows(rows_of()), length):
            r = Runs([p for _, _, p in held_pieces], length, anchor)
            if not len(r.hash):
                continue
            group = np.array([row[1] for row, _, _ in held_pieces], np.int64)
            doc = np.array([row[0] for row, _, _ in held_pieces], np.int64)
            hs.append(r.hash)
            gs.append(group[r.piece])
            ds.append(doc[r.piece])
            held += len(r.hash)
            if held >= BLOCK_ANCHORS:
                yield flush()
                hs, gs, ds, held = [], [], [], 0
        if held:
            yield flush()

    return run


def enumerate_rows(rows):
    for i, (key, data) in enumerate(rows):
        yield (i, key), data


def _repeated(groups: int):
    """Hashes of two documents or more, sent to each group of documents that has them."""

    def run(batches):
        now, held = None, []

        def meet():
            h = np.concatenate([np.frombuffer(x[0], np.uint64) for x in held])
            g = np.concatenate([np.repeat(np.arange(groups), np.frombuffer(x[1], "<u4")) for x in held])
            many = np.concatenate([np.unpackbits(np.frombuffer(x[2], np.uint8), count=len(x[0]) // 8) for x in held]).astype(bool)
            order = np.argsort(h, kind="stable")
            h, g, many = h[order], g[order], many[order]
            first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            size = np.diff(np.append(first, len(h)))
            keep = np.repeat((size > 1) | np.logical_or.reduceat(many, first), size)
            h, g = h[keep], g[keep]
            order = np.argsort(g, kind="stable")
            h, g = h[order], g[order]
            cut = np.searchsorted(g, np.arange(groups + 1))
            rows = [(k, np.unique(h[x:y]).tobytes()) for k, (x, y) in enumerate(zip(cut, cut[1:])) if x < y]
            if rows:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary()])], ["grp", "blob"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != now and held:
                    if (out := meet()) is not None:
                        yield out
                    held = []
                now = row[0]
                held.append(row[1:])
        if held and (out := meet()) is not None:
            yield out

    return run


# A segment's place, and n - 1 more of them, each a step after the other.
RECORD = np.dtype([("id", "<i8"), ("crc", "<u4"), ("pos", "<i8"), ("n", "<i8"), ("step", "<i4")])
HITS = 1 << 16
SEGMENTS = "bucket int, block string, grp int, segments binary, least binary, sizes binary, places binary"


def row_hash(x: np.ndarray) -> np.ndarray:
    words = x.view(np.uint64)
    h = np.full(len(x), 0x243F6A8885A308D3, np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def equal_rows(x: np.ndarray):
    """(number of the class of each row, a row of each class)."""
    _, first, which = np.unique(row_hash(x), return_index=True, return_inverse=True)
    if not (x[first[which]] == x).all():
        _, first, which = np.unique(x.view(f"V{x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return which, first


def steps(which: np.ndarray, piece: np.ndarray, at: np.ndarray, most: int):
    """Runs of neighbours with one class, one piece and one distance of at most ``most``: (first, number, distance)."""
    same = (which[1:] == which[:-1]) & (piece[1:] == piece[:-1])
    apart = np.where(same, at[1:] - at[:-1], most + 1)
    near = apart <= most
    new = np.ones(len(which), bool)
    new[1:] = ~near
    # Within such a run, a distance unlike the one before begins another.
    new[2:] |= near[1:] & near[:-1] & (apart[1:] != apart[:-1])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(which)))
    step = np.where(n > 1, np.append(apart, 0)[start], 0)
    return start, n, step


def _segments(length: int, anchor: int, buckets: int):
    """Partitions hold whole groups: first their repeated hashes, then their copies, then documents."""
    lead = length - anchor  # the anchor's column
    columns = lead + length
    width = -(-(columns + 2) // 8) * 8

    def frames(r, hit):
        """The segments of some hits, each in the fixed frame of columns."""
        first, last, pos = r.first[hit], r.last[hit], r.at[hit]
        x = np.zeros((len(hit), width), np.uint8)
        source = (pos - lead)[:, None] + np.arange(columns)[None, :]
        inside = (source >= first[:, None]) & (source < (last + length)[:, None])
        x[:, :columns] = np.where(inside, r.bytes[np.clip(source, 0, len(r.bytes) - 1)], 0)
        x[:, columns], x[:, columns + 1] = first - pos + lead, last - pos + lead
        return x

    def distinct(r, hit):
        """(class of each hit, a segment and the anchor hash of each class): some hits at a time are laid out, as a
        text of a short period has one at every byte or two."""
        which, kept, hashes, n = [], [], [], 0
        for s in range(0, len(hit), HITS):
            part = hit[s : s + HITS]
            x = frames(r, part)
            own, rep = equal_rows(x)
            which.append(own + n)
            kept.append(x[rep])
            hashes.append(r.hash[part[rep]])
            n += len(rep)
        which, x, h = np.concatenate(which), np.concatenate(kept), np.concatenate(hashes)
        if len(kept) > 1:
            own, rep = equal_rows(x)
            which, x, h = own[which], x[rep], h[rep]
        return which, x, h

    def blocks(group, flagged, docs):
        for held in _pieces(docs, length):
            r = Runs([p for _, _, p in held], length, anchor)
            if not len(r.hash):
                continue
            at = np.searchsorted(flagged, r.hash)
            hit = np.flatnonzero(flagged[np.minimum(at, len(flagged) - 1)] == r.hash)
            if not len(hit):
                continue
            which, x, hashes = distinct(r, hit)
            first, piece = r.first[hit], r.piece[hit]
            # Equal segments one step after another, as a period gives them, are one place with a count.
            start, n, step = steps(which, piece, first, length)
            which, first, piece = which[start], first[start], piece[start]
            place = np.zeros(len(start), RECORD)
            begin = np.concatenate([[0], r.ends])[piece]
            place["pos"] = np.array([o for _, o, _ in held], np.int64)[piece] + first - begin
            place["id"] = np.array([row[0] for row, _, _ in held], np.int64)[piece]
            place["crc"] = np.array([row[1] for row, _, _ in held], np.uint32)[piece]
            place["n"], place["step"] = n, step
            del r, hit
            order = np.argsort(which, kind="stable")
            place, size = place[order], np.bincount(which)
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(place["id"], starts)
            bucket = _bucket(hashes, buckets)
            block, rows = uuid.uuid4().hex, []
            for k in np.unique(bucket).tolist():
                mine = np.flatnonzero(bucket == k)
                spots = np.concatenate([place[starts[i] : starts[i] + size[i]] for i in mine.tolist()])
                rows.append((k, block, group, x[mine].tobytes(), least[mine].tobytes(), size[mine].astype("<u4").tobytes(), spots.tobytes()))
            kinds = [pa.int32(), pa.string(), pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in SEGMENTS.split(", ")])

    def run(batches):
        for group, blobs, copies, docs in by_group(batches):
            flagged = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs] or [np.zeros(0, np.uint64)])
            flagged.sort()
            if len(flagged):
                yield from blocks(group, flagged, (((i, c), d) for i, c, d in docs if (i, c) not in copies))
            else:
                for _ in docs:
                    pass

    return run, width, columns


def by_group(batches):
    """Rows (grp, kind, blob, id, crc, text) sorted by grp and kind -> per group its blobs (kind 0), the set
    of its copies (kind 1) and an iterator of its documents (kind 2). Take all documents before the next group."""

    def rows():
        for b in slices(batches, 256):
            yield from zip(*(c.to_pylist() for c in b.columns))

    it = rows()
    row = next(it, None)
    while row is not None:
        group, blobs, copies = row[0], [], set()
        while row is not None and row[0] == group and row[1] < 2:
            if row[1] == 0:
                blobs.append(row[2])
            else:
                copies.add((row[3], row[4]))
            row = next(it, None)

        def docs():
            nonlocal row
            while row is not None and row[0] == group:
                now, row = row, next(it, None)
                yield now[3], now[4], (now[5] or "").encode()

        mine = docs()
        yield group, blobs, copies, mine
        for _ in mine:
            pass


def repeated_windows(segments: list[np.ndarray], columns: int, least: np.ndarray, length: int, root: str) -> np.ndarray:
    """Bit c of a segment: its window at column c also starts in a document with an id below ``least``. The columns lie in a
    file below ``root``, which is read once from its start to its end; the segments themselves are let go."""
    lo, hi = (np.concatenate([x[:, k] for x in segments]).astype(np.int64) for k in (columns, columns + 1))
    n, out = len(lo), np.zeros(len(lo), np.uint64)
    uri, f = new_file(root, "columns", ".bin")
    with f:
        for c in range(columns - 1, -1, -1):
            for x in segments:
                f.write(x[:, c].tobytes())
    segments.clear()
    with open_stream(uri) as f:
        order, lcp = np.arange(n), np.zeros(n, np.uint8)
        for c in range(columns - 1, -1, -1):
            transform = np.frombuffer(f.read(n), np.uint8)[order]
            perm = np.argsort(transform, kind="stable")
            grown = np.zeros(n, np.uint8)
            at = 0
            for size in np.bincount(transform, minlength=256).tolist():
                if size > 1:
                    old = perm[at : at + size]
                    between = lcp[old[0] + 1 : old[-1] + 1]
                    grown[at + 1 : at + size] = np.minimum.reduceat(between, old[:-1] - old[0]) + 1
                at += size
            order, lcp = order[perm], grown
            if c <= columns - length:
                here = (lo[order] <= c) & (c <= hi[order])
                ids = np.where(here, least[order], NO_ID)
                starts = np.flatnonzero(lcp < length)
                smallest = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, n)))
                out[order[here & (smallest < ids)]] |= np.uint64(1 << c)
    remove_file(uri)
    return out


def _verdicts(width: int, columns: int, length: int, root: str):
    def run(batches):
        now, held = None, []

        def meet():
            least = np.concatenate([np.frombuffer(i, "<i8") for _, _, i in held])
            sizes = [(block, len(s) // width) for block, s, _ in held]
            segments = [np.frombuffer(s, np.uint8).reshape(-1, width) for _, s, _ in held]
            held.clear()
            bits, at, rows = repeated_windows(segments, columns, least, length, root), 0, []
            for block, n in sizes:
                rows.append((now, block, bits[at : at + n].tobytes()))
                at += n
            kinds = [pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "block", "bits"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != now and held:
                    yield meet()
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield meet()

    return run


SPAN = np.dtype([("id", "<i8"), ("crc", "<u4"), ("start", "<i8"), ("end", "<i8")])


def united(spans: np.ndarray) -> np.ndarray:
    """Spans of each (id, crc) that overlap or touch, as one."""
    spans = spans[np.lexsort((spans["start"], spans["crc"], spans["id"]))]
    other = np.concatenate([[True], (spans["id"][1:] != spans["id"][:-1]) | (spans["crc"][1:] != spans["crc"][:-1])])
    far = np.cumsum(other) * (int(spans["end"].max()) + 1)  # puts each text behind the one before
    reach = np.maximum.accumulate(spans["end"] + far)
    new = other.copy()
    new[1:] |= spans["start"][1:] + far[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = spans[first].copy()
    out["end"] = np.maximum.reduceat(spans["end"], first)
    return out


def _spans(width: int, columns: int, length: int):
    """Per occurrence of a segment, the bytes covered by its repeated windows."""

    def of_places(place, which, lo, mine):
        start, out = place["pos"] - lo[which], []
        # The spans of one step after another overlap, as no step is longer than a window.
        more = (place["n"] - 1) * place["step"]
        rows = np.flatnonzero(mine)
        left = mine[rows]
        while len(rows):  # runs of set bits, lowest first
            low = left & (~left + np.uint64(1))
            a = np.log2(low.astype(np.float64)).astype(np.int64)
            rest = left + low  # carries through the run
            z = np.where(rest == 0, 64, np.log2((rest & (~rest + np.uint64(1))).astype(np.float64) + (rest == 0)).astype(np.int64))
            s = np.zeros(len(rows), SPAN)
            s["id"], s["crc"] = place["id"][rows], place["crc"][rows]
            s["start"], s["end"] = start[rows] + a, start[rows] + z - 1 + length + more[rows]
            out.append(s)
            left = left & rest
            keep = left != 0
            left, rows = left[keep], rows[keep]
        return out

    def run(batches):
        for b in batches:
            for group, segments, least, sizes, places, bits in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(segments, np.uint8).reshape(-1, width)
                lo, hi = x[:, columns].astype(np.int64), x[:, columns + 1].astype(np.int64)
                all_bits = ((np.uint64(2) << (hi - lo).astype(np.uint64)) - np.uint64(1)) << lo.astype(np.uint64)
                place, ends = np.frombuffer(places, RECORD), np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)
                least, bits, out = np.frombuffer(least, "<i8"), np.frombuffer(bits, np.uint64), []
                for s in range(0, len(place), HITS):
                    some = place[s : s + HITS]
                    which = np.searchsorted(ends, np.arange(s, s + len(some)), side="right")
                    # Where a window's smallest document is the block's, later documents of the block repeat it.
                    out += of_places(some, which, lo, np.where(some["id"] > least[which], all_bits[which], bits[which]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([united(np.concatenate(out)).tobytes()], pa.binary())], ["grp", "blob"])

    return run


def _kept(min_copy: int):
    def run(batches):
        for _, blobs, copies, docs in by_group(batches):
            spans = np.concatenate([np.frombuffer(x, SPAN) for x in blobs] or [np.zeros(0, SPAN)])
            spans = spans[np.lexsort((spans["start"], spans["crc"], spans["id"]))]
            key = spans["id"]
            held, size = [], 0
            for i, crc, data in docs:
                if (i, crc) in copies and len(data) >= min_copy:
                    starts, ends = [0], [len(data)]
                else:
                    a, z = np.searchsorted(key, i), np.searchsorted(key, i, side="right")
                    s = spans[a:z]
                    s = s[s["crc"] == crc]
                    starts, ends = [], []
                    if len(s):
                        reach = np.maximum.accumulate(s["end"])
                        new = np.flatnonzero(s["start"][1:] > reach[:-1]) + 1
                        starts = s["start"][np.concatenate([[0], new])].tolist()
                        ends = reach[np.concatenate([new - 1, [len(s) - 1]])].tolist()
                kept = b"".join(data[x:y] for x, y in zip([0, *ends], [*starts, len(data)]))
                held.append((None if i == NO_ID else i, len(data), len(data) - len(kept), len(starts), kept))
                size += len(kept)
                if size > 8 << 20 or len(held) >= 2000:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return run


def _batch(rows):
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` are the remaining bytes.
    ``length - anchor`` must be below 64."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))
    with shuffles_freed(spark):
        facts, facts_path = stash(rows.select("id", "crc", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest")), "repeat-facts")
        total = facts.agg(F.sum("n")).first()[0] or 0
        # Four buckets and groups a partition, so that their hashes deal them out evenly.
        parts = 4 * max(shuffle_partitions(spark), total // PART_BYTES + 1)
        group = F.pmod(F.xxhash64("id", "crc"), F.lit(parts)).cast("int").alias("grp")
        first = facts.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "first")
        copies, copies_path = stash(salted_join(facts, first, "digest", ["id", "crc"]).where("id > first").select(group, "id", "crc").distinct(), "repeat-copies")

        found = rows.select(group, "text").mapInArrow(_anchors(length, anchor, parts, parts), "bucket int, hashes binary, sizes binary, many binary")
        found = found.repartition(parts // 4, "bucket").sortWithinPartitions("bucket")
        repeated, repeated_path = stash(found.mapInArrow(_repeated(parts), "grp int, blob binary"), "repeat-anchors")

        cut, width, columns = _segments(length, anchor, parts)
        segments, segments_path = stash(_grouped(repeated, copies, rows, group, parts).mapInArrow(cut, SEGMENTS), "repeat-segments")
        discard(spark, repeated_path, facts_path)

        files = scratch_path(spark, "repeat-columns")
        dealt = segments.select("bucket", "block", "segments", "least").repartition(parts // 4, "bucket").sortWithinPartitions("bucket")
        bits, bits_path = stash(dealt.mapInArrow(_verdicts(width, columns, length, files), "bucket int, block string, bits binary"), "repeat-bits")
        told = segments.join(bits, ["bucket", "block"]).select("grp", "segments", "least", "sizes", "places", "bits")
        spans, _ = stash(told.mapInArrow(_spans(width, columns, length), "grp int, blob binary"), "repeat-spans")
        discard(spark, segments_path, bits_path, files)
    return _grouped(spans, copies, rows, group, parts).mapInArrow(_kept(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _grouped(blobs: DataFrame, copies: DataFrame, rows: DataFrame, group, parts: int) -> DataFrame:
    """Blobs, copies and documents of each group, in this order, in one partition."""
    none = F.lit(None)
    a = blobs.select("grp", F.lit(0).alias("kind"), "blob", none.cast("long").alias("id"), none.cast("long").alias("crc"), none.cast("string").alias("text"))
    b = copies.select("grp", F.lit(1).alias("kind"), none.cast("binary").alias("blob"), "id", "crc", none.cast("string").alias("text"))
    c = rows.select(group, F.lit(2).alias("kind"), none.cast("binary").alias("blob"), "id", "crc", "text")
    return a.unionByName(b).unionByName(c).repartition(parts // 4, "grp").sortWithinPartitions("grp", "kind")

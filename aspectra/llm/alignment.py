"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte of a text.

1. Every text is encoded by A (``tokenizers``, byte-level) and B (``sentencepiece``). The cumulative byte
   ends of each become a dictionary end -> index; the ends in both, sorted, cut both id lists into
   groups; in each group the tokens that end with it are linked.
2. The links of all documents, counted per id pair, give the corpus-wide table ``pairs``.
3. Each document's links are joined to that table: how often its pairs are linked anywhere, and
   whether a pair is the most frequent of its B id.

Both tokenizers see a text as ``space + text``: A gets the blank written out, B puts it there itself. Neither
joins anything across a place where a blank or newline follows something else, so a text is cut there, each
piece is aligned once by step 1 and kept, and a text's groups are those of its pieces, one after another.

Defined cases: a null or empty text has no tokens, nor has one whose A or B tokens don't spell it
(a text that holds U+2581 itself): all counts are 0 and ``groups`` is empty. The string of a special
token in a text is ordinary text. A repeated row, also one with a repeated or null id, is a document of its own,
and its links count again. An empty table stays empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import slices, stash, type_of, worker_state
from aspectra.llm.tokens import BOUNDARY, GROUP_CHARS, Encoder, cut_spaced
from aspectra.operators.match import salted_join

ROWS = 256
CACHE_PIECES = 700_000
SEGMENT_CHARS = 1 << 20
SPACE = "▁"  # how B's pieces write a blank
# A pair of the corpus table takes about this much of a broadcast; up to so many bytes it is one.
PAIR_BYTES, BROADCAST_BYTES = 64, 96 << 20


# ---- one text ----


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The ends that both have, in order, and after how many tokens of A and of B each is reached."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    return common, *(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))


def ending_together(ends: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How many tokens end with each slice: its last, and those before it if what follows them is empty."""
    return to - np.searchsorted(ends, ends[to - 1], "left")


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(path_a, "spaced"), SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        spelled = {i: bytes(alphabet[c] for c in t) for t, i in self.a.tok.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [spelled.get(i, b"") for i in range(self.a.tok.get_vocab_size())]
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.vocab_size())]
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.signed = np.array([[f"{i}{sign}" for i in range(n)] for sign in ",|;"], object)
        self.blank = self.b.piece_to_id(SPACE)
        self.cache: dict[str, tuple[str, bytes, int] | None] = {}

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def aligned(self, ids_a: list[list[int]], ids_b: list[list[int]], spelled: list[bytes]) -> list[tuple[str, bytes, int]] | None:
        """(groups, links as packed pairs, tokens of A << 32 | tokens of B) of texts that follow each other; None if
        the tokens spell something else, or one of two texts."""
        a, b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        parts_a, parts_b, whole = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b], b"".join(spelled)
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return None
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        common, to_a, to_b = common_ends(ends_a, ends_b)
        ends = np.cumsum([len(t) for t in spelled])
        group = np.searchsorted(common, ends, "right")  # groups up to the end of each text
        if not np.isin(ends, common).all():
            return None
        a, b, ends_a, ends_b = np.array(a), np.array(b), np.array(ends_a), np.array(ends_b)
        # Each group's links: the tokens of A with those of B that end with it, one of each but for empty tokens.
        n_a, n_b = ending_together(ends_a, to_a), ending_together(ends_b, to_b)
        k = np.concatenate([[0], np.cumsum(n_a * n_b)])
        g = np.repeat(np.arange(len(common)), n_a * n_b)
        nth = np.arange(k[-1]) - k[g]
        links = a[to_a[g] - n_a[g] + nth // n_b[g]].astype("<u8") << np.uint64(32) | b[to_b[g] - n_b[g] + nth % n_b[g]].astype("<u8")
        packed, k = links.tobytes(), 8 * k
        # The written groups: tokens of A and B take turns, group by group, each with the sign that follows it.
        written = np.empty(len(a) + len(b), object)
        after_a, after_b = np.zeros(len(a), int), np.zeros(len(b), int)
        after_a[to_a - 1], after_b[to_b - 1] = 1, 2
        written[np.arange(len(a)) + np.repeat(np.concatenate([[0], to_b[:-1]]), np.diff(to_a, prepend=0))] = self.signed[after_a, a]
        written[np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = self.signed[after_b, b]
        written, at = written.tolist(), (to_a + to_b).tolist()
        out, w, k0 = [], 0, 0
        for x, y, to in zip(ids_a, ids_b, group.tolist()):
            to_w, to_k = at[to - 1], int(k[to])
            out.append(("".join(written[w:to_w])[:-1], packed[k0:to_k], len(x) << 32 | len(y)))
            w, k0 = to_w, to_k
        return out

    def _learn(self, pieces: list[str]) -> None:
        ids_a = [np.frombuffer(x, self.a.dtype).tolist() for x in self.a.encode_all(pieces)]
        if len(self.a.cache) > CACHE_PIECES // 4:
            self.a.cache = {}
        # B puts a blank before what it gets: the piece's own, or else one that nothing after it joins.
        ids_b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        ids_b = [([self.blank] if p == " " else x) if p[0] == " " else x[1:] for p, x in zip(pieces, ids_b)]
        spelled = [p.encode() for p in pieces]
        found = self.aligned(ids_a, ids_b, spelled) or [(self.aligned([x], [y], [t]) or [None])[0] for x, y, t in zip(ids_a, ids_b, spelled)]
        self.cache.update(zip(pieces, found))

    def _cut(self, text: str) -> list[str]:
        pieces = cut_spaced(text)
        if not pieces[0]:  # a text that begins at a place to cut
            del pieces[0]
        return pieces

    def _align_group(self, group: list[tuple[int, str]], out: list) -> None:
        cut = [self._cut(s) for _, s in group]
        new = dict.fromkeys(chain.from_iterable(cut))
        if len(self.cache) + len(new) > CACHE_PIECES:  # the pieces met first are the frequent ones
            self.cache = dict(islice(self.cache.items(), CACHE_PIECES // 2))
        lack = [p for p in new if p not in self.cache]
        for i in range(0, len(lack), 4096):
            self._learn(lack[i : i + 4096])
        for (k, _), pieces in zip(group, cut):
            found = [self.cache[p] for p in pieces]
            if None in found:  # a piece isn't spelled by its tokens: only the whole text can tell
                out[k] = None
            elif out[k] is not None:
                out[k].append((";".join([x[0] for x in found]), b"".join([x[1] for x in found]), sum([x[2] for x in found])))

    def _align_whole(self, text: str) -> list[tuple[str, bytes, int]]:
        ids = self.a.tok.encode(" " + text, add_special_tokens=False).ids
        return self.aligned([ids], [self.b.encode(text)], [(" " + text).encode()]) or []

    def align_all(self, texts: list[str | None]) -> list[list[tuple[str, bytes, int]]]:
        """For each text its consecutive segments as (groups, links, tokens); none if it has no tokens."""
        out, group, size = [[] for _ in texts], [], 0
        for k, t in enumerate(texts):
            for s in segments(" " + t) if t else ():
                group.append((k, s))
                size += len(s)
                if size >= GROUP_CHARS:
                    self._align_group(group, out)
                    group, size = [], 0
        self._align_group(group, out)
        return [self._align_whole(t) if x is None else x for t, x in zip(texts, out)]


def segments(text: str):
    """Consecutive parts of a very long text, cut where both tokenizers cut."""
    at = 0
    while at < len(text):
        found = BOUNDARY.search(text, at + SEGMENT_CHARS) if at + SEGMENT_CHARS < len(text) else None
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


# ---- all texts ----


def document_links(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """A row per document: its counts and groups, its distinct links (``pair`` = A id << 32 | B id) and how often each occurs."""

    def run(batches):
        it, row = worker_state(("align", path_a, path_b), lambda: Aligner(path_a, path_b)), TaskContext.get().partitionId() << 33
        for batch in slices(batches, ROWS):
            counts, digests, groups, pairs, times = [], [], [], [], []
            for parts in it.align_all(batch.column(1).to_pylist()):
                both = sum(x[2] for x in parts)
                links = np.frombuffer(b"".join([x[1] for x in parts]), "<u8")
                pair, n = np.unique(links, return_counts=True)
                digest = hashlib.sha256(";".join([x[0] for x in parts]).encode()).hexdigest() if parts else ""
                counts.append((both >> 32, both & 0xFFFFFFFF, sum(x[0].count(";") + 1 for x in parts), len(links)))
                digests.append(digest)
                groups.append(";".join([x[0] for x in parts]) if with_groups else None)
                pairs.append(pair.astype(np.int64))
                times.append(n)
            at = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x).astype(np.int64))) for x in (pairs, times)]
            n = np.array(counts, np.int64).reshape(-1, 4).T
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), *map(pa.array, n), pa.array(digests), pa.array(groups, pa.string()), *lists],
                ["row", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "groups", "pairs", "times"],
            )

    schema = (
        f"row long, id {type_of(docs, id_col)}, n_a long, n_b long, n_groups long, n_links long, "
        "digest string, groups string, pairs array<long>, times array<long>"
    )
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): the links of each id pair in all documents; ``best`` if no A id has more with the B id."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    sums = each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n"))
    sums = sums.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")
    # A group has at most one row for each id of A.
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). ``documents``: the id column, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256`` and, with ``with_groups``, ``groups`` itself as ``a1,a2|b1;a3|b2``. ``pairs``: see ``pair_counts``.
    Both are tables in the shared folder or read from ones there."""
    links, _ = stash(document_links(docs, path_a, path_b, id_col, text_col, with_groups), "align-links")
    pairs, _ = stash(pair_counts(links), "align-pairs")
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    known = pairs.select("pair", "n", "best")
    # Vocabularies bound the table, not tightly enough: it is counted, and beyond the bound both sides are shuffled.
    small = pairs.count() * PAIR_BYTES <= broadcast_bytes
    met = each.join(F.broadcast(known), "pair") if small else salted_join(each, known, "pair", ["row"])
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = links.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"),
        F.col("digest").alias("groups_sha256"), *(["groups"] if with_groups else []),
    )
    return out, pairs

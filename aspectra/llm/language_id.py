"""Language identification by prediction by partial matching (PPM) with frozen statistics.

Per language, a context tree of bytes up to ``order`` deep counts which byte followed each
context. A text's code length in a language is the sum over its bytes of -log2 P(byte |
longest context in the tree), where a byte the context hasn't seen costs the context's
escape probability and is then predicted by the context one byte shorter, down to a
uniform distribution (escape by method C: with n occurrences of d distinct bytes a seen byte
has count/(n + d), the escape d/(n + d); no exclusion). The statistics are frozen, so the
cost of each (context, byte) is a fixed number: the trees of all languages are laid out as
one table of costs, and scoring a text is one lookup per byte, exact and whole.

The model is fitted on a bounded sample of labelled rows: about ``sample_docs`` documents a language
(chosen by a hash of the id, at most ``sample_chars`` long each); nothing else is bounded.
Contexts seen fewer than ``min_context`` times in all languages together are pruned.

``score`` is the posterior probability of the best language under equal priors, from the
code lengths: 1 / sum over languages of 2^(best length - length).

Defined cases: text that is null or has no letter (Unicode L*) is ``und`` with score 0, and so is
every text if no row is labelled; ties go to the language first in sorted order; rows with a
null id are never trained on; repeated rows count as often as they stand; texts of any length are
scored in full; other columns are never looked at.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import slices, worker_state

ORDER = 3
SAMPLE_DOCS = 500
SAMPLE_CHARS = 50_000
MIN_CONTEXT = 6
UND = "und"
CHUNK = 1 << 21


class Model:
    """Cost table. ``row_of`` maps the last ``order`` byte codes to a context's row; ``cost[row * a + code]``
    is the code length of that byte in every language. Code 0 is any byte not seen in training."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, min_context: int = MIN_CONTEXT):
        self.languages = sorted(texts)
        self.order = order
        seen = np.zeros(256, bool)
        for docs in texts.values():
            for t in docs:
                seen[np.frombuffer(t, np.uint8)] = True
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, seen.sum() + 1)
        a = self.a = int(seen.sum()) + 1
        # The start of a text is a context no tree has, so its first bytes fall back by themselves.
        streams = [np.concatenate([np.concatenate([np.zeros(order, np.int64), self.code[np.frombuffer(t, np.uint8)]]) for t in texts[k]] or [np.zeros(0, np.int64)]) for k in self.languages]
        rows_before = np.zeros(1, np.int64)  # context id -> row, one order shorter
        tables, n_rows, last = [], 0, None
        for k in range(order + 1):
            grams = []
            for s in streams:
                c = np.zeros(max(0, len(s) - k), np.int64)
                ok = np.ones(len(c), bool)
                for i in range(k + 1):
                    x = s[i : len(s) - k + i]
                    c, ok = c * a + x, ok & (x > 0)
                grams.append(np.unique(c[ok], return_counts=True))
            total = np.zeros(a**k, np.int64)
            for g, n in grams:
                np.add.at(total, g // a, n)
            contexts = np.flatnonzero(total >= (min_context if k else 0))
            row_of = rows_before[np.arange(a**k) % a ** max(k - 1, 0)] if k else np.zeros(1, np.int64)
            own = np.full(a**k, -1, np.int64)
            own[contexts] = np.arange(len(contexts))
            cost = np.empty((len(contexts), a, len(streams)), np.float32)
            for i, (g, n) in enumerate(grams):
                count = np.zeros((len(contexts), a), np.float64)
                at = own[g // a]
                count[at[at >= 0], (g % a)[at >= 0]] = n[at >= 0]
                all_n, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                shorter = np.full((1, a), 8.0) if k == 0 else last[row_of[contexts], :, i]
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit = -np.log2(count / (all_n + distinct))
                    miss = -np.log2(distinct / (all_n + distinct)) + shorter
                cost[:, :, i] = np.where(all_n == 0, shorter, np.where(count > 0, hit, miss))
            row_of[contexts] = n_rows + np.arange(len(contexts))
            n_rows += len(contexts)
            tables.append(cost)
            last = np.concatenate(tables)
            rows_before = row_of
        self.row_of = rows_before.astype(np.int32)
        self.cost = last.reshape(last.shape[0] * a, len(streams))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: one row per text, one column per language."""
        out = np.zeros((len(texts), len(self.languages)))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                size += len(texts[j])
                j += 1
            if size > 2 * CHUNK:  # one very long text: piece by piece, each with the bytes before it as context
                out[i] = sum(self._sum([texts[i][s : s + CHUNK]], texts[i][max(0, s - self.order) : s])[0] for s in range(0, size, CHUNK))
            else:
                out[i:j] = self._sum(texts[i:j], b"")
            i = j
        return out

    def _sum(self, texts: list[bytes], before: bytes) -> np.ndarray:
        o, a = self.order, self.a
        lead = np.zeros(o, np.int64)
        if before:
            lead[o - len(before) :] = self.code[np.frombuffer(before, np.uint8)]
        s = np.concatenate([x for t in texts for x in (lead, self.code[np.frombuffer(t, np.uint8)])])
        size = np.array([len(t) for t in texts])
        context = np.zeros(len(s) - o, np.int64)
        for i in range(o):
            context = context * a + s[i : len(s) - o + i]
        # Codes 0 stand where a text starts and where a byte is unknown: the context is then what follows the last of them.
        cost = self.cost[self.row_of[context] * np.int64(a) + s[o:]]
        ends = np.cumsum(size + o) - o
        starts = ends - size
        total = np.zeros((len(texts), cost.shape[1]))
        some = size > 0
        bounds = np.stack([starts[some], ends[some]], 1).ravel()
        if len(bounds):
            padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)])
            total[some] = np.add.reduceat(padded, bounds, axis=0, dtype=np.float64)[::2]
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
        best, score = [UND] * len(texts), [0.0] * len(texts)
        ask = [i for i, ok in enumerate(letters) if ok] if self.languages else []
        if ask:
            bits = self.lengths([texts[i].encode() for i in ask])
            least = bits.min(1, keepdims=True)
            p = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1)
            for i, k, x in zip(ask, bits.argmin(1).tolist(), p.tolist()):
                best[i], score[i] = self.languages[k], x
        return best, score


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_chars: int) -> DataFrame:
    """(lang, text): labelled rows outside the held-out fold; about ``sample_docs`` a language, by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & ~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.char_length("text") <= sample_chars)
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # one row per language
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(sizes, "lang").where(draw * F.col("n") < sample_docs).select("lang", "text")


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, order: int = ORDER, min_context: int = MIN_CONTEXT,
) -> dict[str, list[bytes]]:
    """The sample the trees are grown from: at most about languages x sample_docs x sample_chars
    characters, whatever the size of the corpus. Workers grow the trees from it once each."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in training_sample(docs, id_col, text_col, lang_col, sample_docs, sample_chars).collect():
        texts.setdefault(lang, []).append(text.encode())
    return texts


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, min_context: int = MIN_CONTEXT, **sample) -> DataFrame:
    """All columns of ``docs`` in one struct ``doc``, with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, order=order, min_context=min_context, **sample))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"))

    def run(batches):
        model = worker_state(name, lambda: Model(shared.value, order, min_context))
        for b in slices(batches, 512):
            lang, score = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc", "lang_pred", "score"])

    return whole.mapInArrow(run, f"doc {whole.schema['doc'].dataType.simpleString()}, lang_pred string, score double")

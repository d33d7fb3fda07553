"""Vocabulary terms of texts, row by row in Arrow batches.

A vocabulary is bounded, so it goes to the tasks as a table: words get numbers, and n-grams are paths of word numbers.
A batch's tokens are looked up as arrays; neither n-grams nor (row, term) pairs become rows of a shuffle.
Rows are independent of each other: rows that share a key are not put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import MARK, mark_tokens, vectorizer_tokens

# Tokens whose terms are in memory at a time, as far as single texts allow.
SLICE_TOKENS = 200_000


def slices(tokens: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(rows, tokens per row) in slices of bounded tokens, at least a row each."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(tokens):
        before = ends[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
        yield tokens.slice(at, to - at), lengths[at:to]
        at = to


def lookup(numbers: dict[str, int], words: pa.Array) -> np.ndarray:
    """The number of every word, -1 without any."""
    coded = words.dictionary_encode()
    found = np.array([numbers.get(w, -1) for w in coded.dictionary.to_pylist()] or [-1], dtype=np.int64)
    return found[coded.indices.to_numpy(zero_copy_only=False)]


class Paths:
    """Sequences of words as paths of word numbers; ``ends`` has a path's place at its last node."""

    def __init__(self, paths: Iterable[tuple[int, Sequence[str]]]):
        self.words: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, words in paths:
            node = 0
            for w in words:
                node = nodes.setdefault((node, self.words.setdefault(w, len(self.words))), len(nodes) + 1)
            ends.setdefault(node, k)
        steps = sorted((a * len(self.words) + w, b) for (a, w), b in nodes.items())
        self.steps = np.array([s for s, _ in steps] or [-1], dtype=np.int64)
        self.nodes = np.array([n for _, n in steps] or [-1], dtype=np.int64)
        self.ends = np.array([ends.get(n, -1) for n in range(len(nodes) + 1)], dtype=np.int64)

    def _step(self, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        step = nodes * len(self.words) + words
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        return np.where(self.steps[at] == step, self.nodes[at], -1)

    def found(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place) of every path that stands anywhere within a row, by length; -1 is no path's word."""
        at, n = np.flatnonzero(words >= 0), 1
        nodes = self._step(np.zeros(len(at), dtype=np.int64), words[at])
        while True:
            at, nodes = at[nodes >= 0], nodes[nodes >= 0]
            if not len(at):
                return
            place = self.ends[nodes]
            yield rows[at][place >= 0], place[place >= 0]
            more = at + n < len(words)
            at, nodes = at[more], nodes[more]
            same = (rows[at + n] == rows[at]) & (words[at + n] >= 0)
            at, nodes = at[same], nodes[same]
            nodes, n = self._step(nodes, words[at + n]), n + 1


class Terms:
    """The terms of orders ``lo`` to ``hi`` of a vocabulary, with their idf."""

    def __init__(self, terms: Sequence[str], idf: Sequence[float], lo: int, hi: int):
        self.idf = np.array(idf, dtype=np.float64)
        self.paths = Paths((k, words) for k, words in enumerate(t.split(" ") for t in terms) if lo <= len(words) <= hi)

    def weights(self, tokens: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) by row and term: tf * idf, L2-normalised in each row."""
        words, rows = lookup(self.paths.words, tokens.flatten()), np.repeat(np.arange(len(lengths)), lengths)
        found = [row * len(self.idf) + term for row, term in self.paths.found(words, rows)]
        both, tf = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *found]), return_counts=True)
        row, term = np.divmod(both, max(len(self.idf), 1))
        w = tf * self.idf[term]
        return row, term, w / np.sqrt(np.bincount(row, w * w, len(lengths)))[row]


def _once(run, type_: str):
    """Declared nondeterministic, so that no filter or later projection runs it a second time."""
    return F.arrow_udf(run, type_).asNondeterministic()


def weights(text: Column, terms: Sequence[str], numbers: Sequence[int], idf: Sequence[float], lo: int, hi: int) -> Column:
    """ARRAY<STRUCT<idx, weight>> of a text, by the terms' places; ``numbers`` are their idx."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, idx = Terms(terms, idf, lo, hi), np.array(numbers, dtype=np.int32)
        for batch in batches:
            out = [_no_weights]
            for part, lengths in slices(batch):
                row, term, w = known.weights(part, lengths)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))]).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(idx[term]), pa.array(w)], ["idx", "weight"])
                out.append(pa.ListArray.from_arrays(pa.array(ends), entries))
            yield pa.concat_arrays([o.cast(_no_weights.type) for o in out])

    return _once(run, "array<struct<idx:int,weight:double>>")(vectorizer_tokens(text))


_no_weights = pa.array([], pa.list_(pa.struct([("idx", pa.int32()), ("weight", pa.float64())])))


def scores(text: Column, terms: Sequence[str], idf: Sequence[float], logs: Sequence[Sequence[float]], priors: Sequence[float], lo: int, hi: int) -> Column:
    """ARRAY<DOUBLE>: by class, its prior plus the text's weights times the class's values of the terms (``logs``, by class)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, table = Terms(terms, idf, lo, hi), np.array(logs, dtype=np.float64).reshape(len(priors), -1)
        for batch in batches:
            flat = [np.empty(0)]
            for part, lengths in slices(batch):
                row, term, w = known.weights(part, lengths)
                each = [p + np.bincount(row, w * t[term], len(lengths)) for p, t in zip(priors, table)]
                flat.append(np.stack(each, axis=1).ravel())
            ends = np.arange(0, (len(batch) + 1) * len(priors), len(priors), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))

    return _once(run, "array<double>")(vectorizer_tokens(text))


def term_stats(rows: DataFrame, text: str, lo: int, hi: int) -> DataFrame:
    """(term, total, df) of all n-grams of orders ``lo`` to ``hi``: their occurrences, and the rows that have them. Counted
    in each slice of a batch first, so that what is shuffled is a slice's distinct n-grams."""

    def run(batches):
        for batch in batches:
            for part, lengths in slices(batch.column(0)):
                coded, owner = part.flatten().dictionary_encode(), np.repeat(np.arange(len(lengths)), lengths)
                words, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())
                grams, texts, at = words, names, np.arange(len(words))
                for n in range(1, hi + 1):
                    if n > 1:
                        more = at + n - 1 < len(words)
                        at, grams = at[more], grams[more]
                        same = owner[at + n - 1] == owner[at]
                        at, grams = at[same], grams[same]
                        pairs, grams = np.unique(grams * max(len(names), 1) + words[at + n - 1], return_inverse=True)
                        first, last = np.divmod(pairs, max(len(names), 1))
                        texts = pc.binary_join_element_wise(texts.take(pa.array(first)), names.take(pa.array(last)), " ")
                    if n >= lo and len(at):
                        total = np.bincount(grams, minlength=len(texts))
                        df = np.bincount(np.unique(owner[at] * len(texts) + grams) % len(texts), minlength=len(texts))
                        yield pa.RecordBatch.from_arrays([texts, pa.array(total, pa.int64()), pa.array(df, pa.int64())], ["term", "total", "df"])

    counted = rows.select(vectorizer_tokens(F.col(text)).alias("t")).mapInArrow(run, "term string, total long, df long")
    return counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def first_phrase(text: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """The place of the first of the phrases that is a whole word of the text; null without any.

    A phrase is the parts that marks divide it into, none for the empty phrase. It stands where as many parts of the marked
    text are its own, with a mark on both sides: neither the text's first part nor its last. The empty one stands at any mark.
    """
    empty = next((k for k, parts in enumerate(phrases) if not parts), None)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        paths, none = Paths((k, parts) for k, parts in enumerate(phrases) if parts), np.iinfo(np.int32).max
        for batch in batches:
            out = [np.empty(0, dtype=np.int64)]
            for part, lengths in slices(batch):
                words, rows = lookup(paths.words, part.flatten()), np.repeat(np.arange(len(lengths)), lengths)
                ends = np.cumsum(lengths)[lengths > 0]
                words[ends - lengths[lengths > 0]] = words[ends - 1] = -1
                best = np.where((lengths > 1) & (empty is not None), none if empty is None else empty, none)
                for row, place in paths.found(words, rows):
                    np.minimum.at(best, row, place)
                out.append(best)
            best = np.concatenate(out)
            yield pa.array(best.astype(np.int32), mask=best == none)

    return _once(run, "int")(F.split(mark_tokens(text), MARK))

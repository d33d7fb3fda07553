"""All substring hits of texts, each scored on its own prompt, text by text in Arrow batches.

A prompt is ``head(phrase) ++ text``, and its 1-gram counts add up: tf(h ++ s) = tf(h) + tf(s). With w = tf * idf:
    |w|^2   = S2(s) + C(h) + sum_{t in h} 2 idf_t^2 tf_h,t tf_s,t
    w . lp  = D(s) + E(h)
S2 and D are sums over the text's terms, C, E and the factors of tf_s,t a head's own. Phrases and heads are
bounded and go to the tasks as tables, so a hit is a few look-ups: only the texts are shuffled, to those that share their keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.text import vectorizer_tokens
from aspectra.operators.row_terms import lookup, slices


class Heads:
    """The heads' tables; ``tokens`` has each head's tokens, ``places`` a term's place in ``idf`` and ``logs`` (by class)."""

    def __init__(self, tokens: Sequence[Sequence[str]], places: dict[str, int], idf: np.ndarray, logs: np.ndarray):
        counted = [Counter(places[t] for t in ts if t in places) for ts in tokens]
        self.sizes = np.array([len(c) for c in counted], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms = np.array([t for c in counted for t in c], dtype=np.int64)
        tf, owner = np.array([n for c in counted for n in c.values()], dtype=np.float64), np.repeat(np.arange(len(counted)), self.sizes)
        weight = tf * idf[self.terms]
        self.squares = np.bincount(owner, weight * weight, len(counted))
        self.sums = [np.bincount(owner, weight * lp[self.terms], len(counted)) for lp in logs]
        self.factors = 2.0 * idf[self.terms] ** 2 * tf

    def shared(self, row: np.ndarray, head: np.ndarray, both: np.ndarray, tf: np.ndarray, n_terms: int) -> np.ndarray:
        """The sum over a head's terms of factor * tf in the text, for pairs of a text and a head; ``both`` has the texts'
        terms as row * n_terms + term, ascending."""
        n = self.sizes[head]
        pair = np.repeat(np.arange(len(head)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.starts[head][pair]
        if not len(pair) or not len(both):
            return np.zeros(len(head))
        wanted = row[pair] * n_terms + self.terms[at]
        found = np.minimum(np.searchsorted(both, wanted), len(both) - 1)
        return np.bincount(pair, np.where(both[found] == wanted, self.factors[at] * tf[found], 0.0), len(head))


def best_class(
    texts: DataFrame,
    text: str,
    keys: Sequence[str],
    phrases: Sequence[str],
    heads: Sequence[Sequence[str]],
    terms: Sequence[str],
    idf: Sequence[float],
    logs: Sequence[Sequence[float]],
    priors: Sequence[float],
) -> DataFrame:
    """keys + ``hits`` ARRAY<STRUCT<aspect, at>>: the phrases that stand anywhere in the text, in their order, with the place of
    the class that scores best on head ++ text (the first one on ties). One row for each value of the keys: hits of all
    its rows, scored on the terms of all its texts; rows with a null key are scored on the heads alone."""
    names, n_terms = list(keys), len(terms)
    entry = T.StructType([T.StructField("aspect", T.StringType()), T.StructField("at", T.IntegerType())])
    schema = T.StructType([texts.schema[c] for c in names] + [T.StructField("hits", T.ArrayType(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weight = {t: i for i, t in enumerate(terms)}, np.array(idf, dtype=np.float64)
        table = np.array(logs, dtype=np.float64).reshape(len(priors), -1)
        known, words = Heads(heads, places, weight, table), pa.array(phrases, pa.string())
        automaton, anywhere = ahocorasick.Automaton(), {k for k, p in enumerate(phrases) if not p}  # the empty phrase
        for k, phrase in enumerate(phrases):
            if phrase:
                automaton.add_word(phrase, k)
        automaton.make_automaton()
        walk = automaton.iter if len(automaton) else lambda _: ()
        for batch in batches:
            at = 0
            for tokens, lengths in slices(batch.column("_tokens")):
                part, n = batch.slice(at, len(lengths)), len(lengths)
                at += n
                hit, found = [], np.zeros(n, dtype=np.int64)
                for i, each in enumerate(part.column("_texts").to_pylist()):
                    for s in each:
                        here = sorted({k for _, k in walk(s)} | anywhere)
                        hit += here
                        found[i] += len(here)
                head, row = np.array(hit, dtype=np.int64), np.repeat(np.arange(n), found)
                own, owner = lookup(places, tokens.flatten()), np.repeat(np.arange(n), lengths)
                both, tf = np.unique((owner * n_terms + own)[own >= 0], return_counts=True)
                of, term = np.divmod(both, max(n_terms, 1))
                w = tf * weight[term]
                square = np.bincount(of, w * w, n)[row] + known.squares[head] + known.shared(row, head, both, tf, n_terms)
                norm = np.sqrt(square)
                by = np.where(norm > 0, norm, 1.0)
                dots = [(np.bincount(of, w * lp[term], n)[row] + e[head]) / by for lp, e in zip(table, known.sums)]
                scores = np.stack([p + np.where(norm > 0, d, 0.0) for p, d in zip(priors, dots)])
                best = pa.array(np.argmax(scores, axis=0).astype(np.int32))
                entries = pa.StructArray.from_arrays([words.take(pa.array(head)), best], ["aspect", "at"])
                ends = pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(ends, entries)], [*names, "hits"])

    grouped = texts.groupBy(*names).agg(F.collect_list(text).alias("_texts"))
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    # Texts are put together at a character that belongs to no token.
    tokens = F.when(complete, vectorizer_tokens(F.array_join("_texts", "\n"))).otherwise(F.array().cast("array<string>"))
    return grouped.select(*names, "_texts", tokens.alias("_tokens")).mapInArrow(run, schema)

"""Brute-force versions of the operators: one process, plain loops, no shared code."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash


def unite(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def removed(docs, length=50):
    """{id: (n_bytes, n_removed, n_spans, kept)} of (id, text) rows with distinct ids."""
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def drop_lines(docs, min_chars=20, min_docs=3):
    """[text] of (id, text) rows."""
    white = " \t\n\x0b\x0c\r"

    def key(line):
        line = line.strip(white)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line) if len(line) >= min_chars else None

    where = {}
    for row, (i, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            where.setdefault(k, []).append((i is not None, i or 0, row))
    out = []
    for i, t in docs:
        kept = []
        for x in (t or "").split("\n"):
            held = where.get(key(x), [])
            if len(held) < min_docs or max(held)[:2] == (i is not None, i or 0):
                kept.append(x)
        out.append(None if t is None else "\n".join(kept))
    return out

"""Token ids of whole texts with the ``tokenizers`` library, each distinct piece encoded once.

A text may be cut wherever the tokenizer's own pre-tokenizer always cuts; the ids of the
text are then the ids of its pieces, one after another, and a bounded cache of pieces
saves most of the encoding. ``pieces`` names the rule that holds for the tokenizer:

* ``"words"``  white space is dropped and no pre-token holds any (normalizers that act on
  single characters or composed ones only): cut at blanks and newlines.
* ``"spaced"`` byte-level pre-tokens hold white space only at their start, so every place
  where white space follows something else is a boundary: cut there.
* ``"whole"``  no cut; right for every tokenizer.

The string of a special token in a text is ordinary text with ``special_as_text``; without, it has the
special id, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives it. Special tokens hold no
white space, so they fall into one piece, which is then encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

from aspectra.llm.common import worker_state

CACHE_ENTRIES = 1_000_000

OTHER_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


def cut_spaced(text: str) -> list[str]:
    if OTHER_SPACE.search(text):
        return BOUNDARY.split(text)
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text:
        return RUNS.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def cut_words(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


CUTS = {"words": cut_words, "spaced": cut_spaced, "whole": lambda t: [t]}


JOINED = 100
GROUP_CHARS = 500_000
# Letters whose lower case and composed form are one character each, here and in the tokenizers.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SYMBOLS = r"!-/:-@\[-`{-~"
WORD = re.compile(f"([{LETTERS}]+)([{SYMBOLS}]*)")
SPACED_WORD = re.compile(f"(\n?)( ?[{LETTERS}]+)([{SYMBOLS}]*)")
PLAIN = re.compile(f"[{LETTERS}]+")
SPACED_PLAIN = re.compile(f" [{LETTERS}]+")


def parts_of_word(piece: str) -> list[str]:
    """Letters and the symbols after them are pre-tokens of their own; the tokenizer lower-cases."""
    found = WORD.fullmatch(piece)
    if not found:
        return [piece.lower() if piece.isascii() else piece]
    word, end = found.groups()
    return [word.lower(), end] if end else [word.lower()]


def parts_of_spaced(piece: str) -> list[str]:
    """A newline before a letter, letters with the blank before them, and the symbols after them are pre-tokens of their own."""
    found = SPACED_WORD.fullmatch(piece)
    return [x for x in found.groups() if x] if found and not piece.startswith("\n ") else [piece]


PARTS = {"words": parts_of_word, "spaced": parts_of_spaced, "whole": None}


class Encoder:
    def __init__(self, path: str, pieces: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        special = [] if special_as_text else [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        # Also in another case: a piece that is lower-cased first must not become one.
        self.special = re.compile("|".join(special), re.IGNORECASE) if special else None
        self.cut, self.parts = CUTS[pieces], PARTS[pieces]
        self.dtype = id_dtype(self.tok.get_vocab_size())
        self.keep = pieces != "whole"
        self.cache: dict[str, bytes] = {}
        # Where words of letters stand in one text, a token's own form shows where each begins or ends.
        self.lead = " " if pieces == "spaced" else ""
        self.plain = SPACED_PLAIN if self.lead else PLAIN
        self.mark = np.zeros(self.tok.get_vocab_size(), bool)
        for token, k in self.tok.get_vocab().items():
            self.mark[k] = token.startswith("\u0120") if self.lead else token.endswith("</w>")

    def _encode_joined(self, words: list[str]) -> None:
        """Encode many words in one text; a group whose tokens don't fall into its words stays for later."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        texts = [("" if self.lead else " ").join(g) for g in groups]
        for group, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.mark[ids])
            if len(at) != len(group):
                continue
            ends = np.append(at[1:], len(ids)) if self.lead else at + 1
            packed, width, a = ids.tobytes(), ids.itemsize, 0
            for word, z in zip(group, ends.tolist()):
                self.cache[word] = packed[a * width : z * width]
                a = z

    def _learn(self, pieces: set[str]) -> None:
        """Put new pieces in the cache, put together from parts that many of them share."""
        cache = self.cache
        whole = self.special.search if self.special else lambda piece: None
        new = {piece: [piece] if whole(piece) else self.parts(piece) for piece in pieces}
        lack = {x for xs in new.values() for x in xs}.difference(cache)
        self._encode_joined([x for x in lack if self.plain.fullmatch(x)])
        rest = [x for x in lack if x not in cache]
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for piece, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                cache[piece] = np.array(e.ids, self.dtype).tobytes()
        for piece, xs in new.items():
            cache[piece] = cache[xs[0]] if len(xs) == 1 else b"".join([cache[x] for x in xs])

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        if not self.keep:
            return [np.array(self.tok.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() for t in texts]
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_ENTRIES:  # the pieces met first are the frequent ones
            self.cache = dict(islice(self.cache.items(), CACHE_ENTRIES // 2))
        new = set().union(*cut).difference(self.cache)
        if new:
            self._learn(new)
        return [b"".join(map(self.cache.__getitem__, parts)) for parts in cut]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed little-endian integers of ``dtype``; texts share the look for new pieces."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t or "")
            size += len(t or "")
            if size >= GROUP_CHARS:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def id_dtype(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def encoder(path: str, pieces: str, special_as_text: bool = True) -> Encoder:
    """One encoder, with its cache, for the tasks of a Python worker until another operator comes."""
    return worker_state((path, pieces, special_as_text), lambda: Encoder(path, pieces, special_as_text))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

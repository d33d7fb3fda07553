"""Texts that hold a special token's string, against an untouched tokenizer."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from aspectra.llm.queries import queries
from aspectra.llm.tokens import encoder
from tests.llm import brute
from tests.llm.test_operators import BYTE, WORD
from tokenizers import Tokenizer

TEXTS = ["plain text", "a <|endoftext|> b", "x<|endoftext|>y  \n<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "last"]


@pytest.mark.parametrize("path,pieces", [(WORD, "words"), (BYTE, "spaced"), (WORD, "whole")])
def test_special_ids_are_those_of_the_library(path, pieces):
    tok, enc, rnd = Tokenizer.from_file(path), encoder(path, pieces, special_as_text=False), random.Random(4)
    alphabet = ["a", "B", "é", "é", "İ", " ", " ", "\n", "\t", "\r", "\x1c", "!", "'s", "12", "\0", "日", "<|", "|>", "endoftext", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]
    texts = TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 25))) for _ in range(3000)]
    for t, got in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_queries_give_the_special_id(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(WORD)
    want = {(i, len(ids), brute.crc(ids)) for i, ids in ((i, brute.ids_of(tok, t, 1)) for i, t in enumerate(TEXTS))}
    for pieces in (queries()["op1_packing"](spark, str(tmp_path)), corpus_pipeline.pack_windows(spark, docs, str(tmp_path))):
        assert {(r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in pieces.collect()} == want
    tok, at, rows = Tokenizer.from_file(BYTE), 0, []
    for i, t in enumerate(TEXTS):
        ids = brute.ids_of(tok, t, 2)
        rows.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries()["op4_token_files"](spark, str(tmp_path)).collect())) == rows

"""Merkle manifest, URL rules and cross-tokenizer alignment against brute force, on hard, hot and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import chain, combinations

import duckdb
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from aspectra.llm import alignment, merkle, queries, url_rules
from aspectra.llm.oracles import oracles
from aspectra.llm.tokens import vocabulary_path
from tests.conftest import SF001
from tests.llm.test_operators import HARD, empty_docs, hard_docs, local_docs, rows_of

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
NASTY = [(100, "▁ U+2581"), (101, " "), (102, "  "), (103, "\n"), (104, "a\r\nb }\r\n"), (105, "<s> </s> <|endoftext|>"), (106, "x\n\n y \n z  ")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- alignment ----


def byte_of():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {}, 0
    for b in range(256):
        table[chr(b) if b in keep else chr(256 + n)] = b
        n += b not in keep
    return table


def plain_alignment(docs):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] of (id, text) rows, from whole texts."""
    tok, sp, table = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_of()
    tok.encode_special_tokens = True
    found, counts = [], Counter()
    for i, t in docs:
        e = tok.encode(" " + t, add_special_tokens=False) if t else None
        a, b = (e.ids, sp.encode(t)) if t else ([], [])
        pa = [bytes(table[c] for c in x) for x in (e.tokens if t else [])]
        pb = [bytes([int(sp.id_to_piece(x)[1:-1], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(pa) != (" " + t).encode() or b"".join(pb) != (" " + t).encode():
            found.append((i, 0, 0, "", []))
            continue
        groups, links, ga, gb, ea, eb, ja = [], [], [], [], 0, 0, 0
        for x, y in zip(b, pb):
            gb.append(x)
            eb += len(y)
            while ea < eb:
                ga.append(a[ja])
                ea += len(pa[ja])
                ja += 1
            if ea == eb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        counts.update(links)
        found.append((i, len(a), len(b), ";".join(groups), links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((
        (i, na, nb, g.count(";") + 1 if g else 0, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha(g) if g else "")
        for i, na, nb, g, ls in found
    ), key=repr)


def test_alignment_of_the_given_documents(spark):
    assert rows_of(queries.queries()["op13_alignment"](spark, SF001)) == plain_alignment(local_docs(spark))


@pytest.mark.parametrize("broadcast_bytes", [0, alignment.BROADCAST_BYTES])
def test_alignment_of_hard_documents(spark, broadcast_bytes):
    docs = [*HARD, *NASTY, (1, "a row of a repeated id"), (None, None), (None, "no id")]
    df = spark.createDataFrame([(t, i, 0, "x") for i, t in docs], "text string, doc_id long, row long, pairs string").repartition(3)
    found, pairs = alignment.align(df, A, B, broadcast_bytes=broadcast_bytes)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    assert found.where(F.col("groups_sha256") != digest).count() == 0
    assert rows_of(found.drop("groups")) == plain_alignment(docs)
    assert pairs.groupBy("b").agg(F.max("n").alias("m"), F.max(F.when(F.col("best"), F.col("n"))).alias("k")).where("m <> k").count() == 0
    assert rows_of(alignment.align(empty_docs(spark), A, B)[0]) == []


def test_pieces_are_aligned_as_whole_texts_are(monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT_CHARS", 7)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 50)
    it, rnd = alignment.Aligner(A, B), random.Random(3)
    alphabet = ["a", "B", "é", "İ", " ", " ", "\n", "\t", "\r", " ", "\x1c", "　", "!", "'s", "12", "\0", "日", "́", "<|endoftext|>", "▁", "<s>", "}", "the"]
    texts = [t for _, t in HARD if t and len(t) < 1000] + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 25))) for _ in range(2000)]
    for t, parts in zip(texts, it.align_all(texts)):
        whole = it._align_whole(t)
        got = [(";".join(x[0] for x in parts), b"".join(x[1] for x in parts), sum(x[2] for x in parts))] if parts else []
        assert got == whole, repr(t)


def test_empty_tokens_at_an_end_are_all_linked():
    it = alignment.Aligner(A, B)
    it.bytes_a[7], it.bytes_b[9], it.bytes_b[5] = b"", b"", b"x"
    x = next(i for i, b in enumerate(it.bytes_a) if b == b"x")
    [(groups, links, tokens)] = it.aligned([[x, 7]], [[5, 9]], [b"x"])
    assert groups == f"{x},7|5,9" and tokens == 2 << 32 | 2
    assert [int.from_bytes(links[k : k + 8], "little") for k in range(0, len(links), 8)] == [x << 32 | 5, x << 32 | 9, 7 << 32 | 5, 7 << 32 | 9]


# ---- Merkle manifest ----


def plain_manifest(rows):
    """[(id, leaf, subroot, root, proof, folded, verified)] of (doc_id, source, lang, n_chars, text) rows."""

    def hashed(doc_id, source, lang, n_chars, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, hashed(*r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([k[2] for k, _ in sorted(groups[g], key=lambda x: x[0])]) for g in order}
    top, out = up([trees[g][-1][0] for g in order]), []
    for at, g in enumerate(order):
        for place, ((_, _, leaf), r) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            crc = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = hashed(*r[:3], r[3] + 1 if r[3] is not None else None, r[4]) if crc else leaf
            proof = ""
            for levels, p in ((trees[g], place), (top, at)):
                for level in levels[:-1]:
                    run = level[p // 2 * 2 : p // 2 * 2 + 2]
                    proof += "".join(x for k, x in enumerate(run) if k != p % 2)
                    run[p % 2] = node
                    node, p = sha("".join(run)), p // 2
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def spark_manifest(df, bits):
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    tampered = merkle.leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    made = merkle.manifest(df, "doc_id", "lang", FIELDS, {"claimed": F.when(changed, tampered)}, bits)
    path = F.col("path")
    out = made.proofs().select("id", "leaf", "subroot", "root", F.sha2(merkle.siblings(path), 256), merkle.folded(F.coalesce("claimed", "leaf"), path).alias("f"))
    return rows_of(out.withColumn("verified", F.col("f") == F.col("root")))


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest(spark, bits):
    rnd = random.Random(bits)
    langs = [None, "de", "en", "zh", "é", "日本", "lone"]
    rows = [(i, rnd.choice(["a", None]), rnd.choice(langs[:6]), rnd.choice([None, i]), rnd.choice(["", None, "text ü " * (i % 9)])) for i in range(140)]
    rows += [(7, "again", "en", 1, "x")] * 3 + [(None, None, "en", None, None)] * 2 + [(999, "s", "lone", 3, "y" * 50_000)]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place long, path string, root string")
    assert spark_manifest(df.repartition(4), bits) == plain_manifest(rows)
    assert spark_manifest(df.limit(0), bits) == []


def test_manifest_of_one_row_and_of_one_group(spark):
    for rows in ([(21, "s", None, 4, "text")], [(i, "s", "en", i, "t") for i in range(9)]):
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert spark_manifest(df, 2) == plain_manifest(rows)


# ---- URL rules ----

RULES = queries.URL_RULES
PAGES = "page_id long, url string, tokens string, row long, verdict string, html string"


def test_listed_rules(spark):
    cases = [
        ("http://a.org/x", "org/"), ("http://A.ORG/x", "org/"), ("http://org/", "org/"), ("http://norg/x", None), ("http://a.org", None),
        ("http://a.org?x/", None), ("http://example.org/es/1", "example.org/es/"), ("http://www.example.org/es", "org/"),
        ("http://myexample.org/es/", "org/"), ("http://m.example.org/en/12#top", "example.org/en/1"), ("http://example.org/en/2", "org/"),
        ("x://a.com/fr/", "com/fr/"), ("x://a.com/de/?q", "com/de/"), ("a.org/x", None), (None, None), ("", None), ("://", None),
        ("http://a.com:80/de/", None), ("http://b://c.org/", None),
    ]
    df = spark.createDataFrame([(i, u, "t", 1, "v", "h") for i, (u, _) in enumerate(cases)], PAGES)
    got = {r["page_id"]: r for r in url_rules.judge(df, RULES).collect()}
    assert [got[i]["rule"] for i in range(len(cases))] == [r for _, r in cases]
    assert (got[1]["host"], got[1]["path"]) == ("a.org", "/x") and (got[14]["host"], got[14]["path"]) == ("", "")
    assert got[5]["path"] == "" and got[18]["host"] == "b:" and got[14]["verdict"] == "allow"


def plain_verdicts(rows, min_support, min_confidence):
    """Verdicts of (verdict or None, tokens) rows by all combinations of the labelled rows' tokens."""
    labelled = [(v, frozenset(t)) for v, t in rows if v and t]
    every = lambda t: chain.from_iterable(combinations(sorted(t), n) for n in range(1, len(t) + 1))
    seen, both = Counter(), Counter()
    for v, t in labelled:
        for c in every(t):
            seen[c] += 1
            both[c, v] += 1
    found = [(n / seen[c], n, v == "block", v, set(c)) for (c, v), n in both.items() if n >= min_support * len(labelled) and n / seen[c] >= min_confidence]
    out = []
    for v, t in rows:
        fit = [r[:4] for r in found if r[4] <= set(t)]
        out.append(v or (max(fit)[3] if fit else "allow"))
    return out


@pytest.mark.parametrize("bytes_", [0, 32 << 20])
def test_mined_rules_decide_like_all_combinations(spark, monkeypatch, bytes_):
    monkeypatch.setattr(url_rules, "fits_broadcast", lambda df: bytes_ > 0)
    rnd, words = random.Random(5), ["a", "b", "c", "d", "e", "f", "g"]
    rows = []
    for k in range(400):
        have = rnd.sample(words, rnd.randint(0, 4))
        bad = "a" in have and "b" in have or "g" in have and rnd.random() < 0.9
        rows.append((None if k % 3 == 0 else "block" if bad else "allow", have))
    rows += [("block", ["h", "i"])] * 300 + [(None, ["i", "a"]), (None, ["h"])] * 5  # one hot url
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(rows)], "row long, verdict string, tokens array<string>").repartition(5)
    mined = url_rules.mine(df.where("verdict is not null"), 0.02, 0.8)
    found = {r["row"]: r["verdict"] for r in url_rules.decide(df.where("verdict is null").select("row", "tokens"), mined).collect()}
    assert [v or found.get(i, "allow") for i, (v, _) in enumerate(rows)] == plain_verdicts(rows, 0.02, 0.8)


def test_rules_of_many_telling_tokens(spark):
    """Urls have up to 17 frequent tokens; the two that decide together tell nothing alone, 13 others tell a little."""
    rnd, rows = random.Random(7), []
    for _ in range(400):
        x, y = rnd.random() < 0.5, rnd.random() < 0.5
        some = [f"t{j:02}" for j in range(13)] if rnd.random() < (0.7 if x == y else 0.4) else []
        rows.append(("block" if x == y else "allow", [*some, *["x"] * x, *["y"] * y, "all", "same"]))
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(rows)], "row long, verdict string, tokens array<string>")
    mined = url_rules.mine(df, 0.02, 0.8)
    assert (["x", "y"], "block", 1.0) in [(r["tokens"], r["verdict"], r["confidence"]) for r in mined.collect()]
    urls = spark.createDataFrame([(1, ["x", "y"]), (2, ["all"])], "row long, tokens array<string>")
    assert [tuple(r)[:2] for r in url_rules.decide(urls, mined).collect()] == [(1, "block")]


def test_url_rules_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "t", 1, "v", "h"), (1, None, None, None, None, None)], PAGES)
    assert rows_of(url_rules.judge(df, RULES).select("page_id", "host", "path", "rule", "verdict")) == [(1, "", "", None, "allow"), (1, "a.net", "/x", None, "allow")]
    assert rows_of(url_rules.judge(df.limit(0), RULES)) == []
    assert rows_of(url_rules.judge(df, {}).select("verdict")) == [("allow",), ("allow",)]


def test_very_long_urls(spark):
    long = "http://spam.net/" + "/".join(f"w{k}" for k in range(3000))
    rows = [(i, long + f"?{i}", "t", 1, "v", "h") for i in range(30)] + [(100 + i, f"http://x.org/{i}", "t", 1, "v", "h") for i in range(30)]
    df = spark.createDataFrame(rows, PAGES)
    rules = {"spam.net/w0": "block", "org/": "allow"}
    got = url_rules.judge(df.unionByName(df.limit(1).withColumn("url", F.lit("http://y.com/w1/w2"))), rules)
    assert got.where("verdict = 'block'").count() == 31


def test_sql_takes_the_rules_of_the_query():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF001}/pages.parquet'")
    assert set(RULES) >= {r[0] for r in con.sql(f"SELECT DISTINCT rule FROM ({oracles()['op12_url_rules']}) WHERE rule IS NOT NULL").fetchall()}

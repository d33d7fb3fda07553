"""Every operator against brute force or SQL: the given tables and a table of hard cases."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aspectra.llm import embedding_dedup, exact_topk, language_id, line_dedup, mixing, packing, simhash, substring_dedup, token_files, tokens, warc
from aspectra.llm.components import components
from aspectra.llm.oracles import oracles
from aspectra.llm.queries import mix_documents, queries
from aspectra.llm.tokens import encoder, vocabulary_path
from tests.conftest import SF001
from tests.llm import brute

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")
PASSAGE = "this passage of more than fifty bytes is found in several of the documents here. "
SHARED = "A line of text that several documents share\n"
HARD = [
    (1, PASSAGE + "first"), (2, "second " + PASSAGE + PASSAGE), (3, None), (4, ""), (5, " \t\n"), (6, "\n\n"),
    (7, SHARED + "own line of seven"), (8, "  " + SHARED.upper() + "own line of eight"), (9, SHARED), (10, SHARED + SHARED),
    (11, "word " * 30_000), (12, "word " * 29_999), (13, "été ñandú 日本語 ½ \x1c  a\t  b <|endoftext|>"), (14, PASSAGE + "first"),
    (15, "a  b \n c\n\n d "), (16, "123 456"), (17, PASSAGE[:50]), (18, PASSAGE[:49]), (19, "x" * 200), (20, "x" * 120 + "y"),
    (21, "\0 nul \0\0" + PASSAGE), (22, "don't we'll THEY'RE Ünïcode " * 9), (23, "é ́e İ ß ſ"),
]
CLASH = "part long, ids string, id long, text string, doc_id long, lang string, source string, start long, row long, doc string"


def hard_docs(spark):
    """Clashing extra columns, nulls in all of them, several partitions."""
    rows = [(None, None, None, t, i, random.Random(i).choice(["en", "de", None]), random.Random(i).choice(["a", None]), None, None, None) for i, t in HARD]
    return spark.createDataFrame(rows, CLASH).repartition(5)


def empty_docs(spark):
    return spark.createDataFrame([], CLASH)


def local_docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def cells(rows):
    return sorted(([round(x, 5) if isinstance(x, float) else x for x in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    got, want = queries()[name](spark, SF001), con.sql(oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert cells(got.select(order).collect()) == cells(want.select(*order).fetchall())


@pytest.mark.parametrize("path,pieces", [(WORD, "words"), (BYTE, "spaced")])
def test_pieces_of_texts_have_the_ids_of_whole_texts(path, pieces):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    enc, rnd = encoder(path, pieces), random.Random(1)
    alphabet = ["a", "B", "é", "é", "İ", " ", " ", "\n", "\t", "\r", " ", "\x1c", "　", "!", "'s", "12", "\0", "日", "́", "<|endoftext|>"]
    texts = [t for _, t in HARD if t] + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 25))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("path,pieces", [(WORD, "words"), (BYTE, "spaced")])
def test_texts_encoded_together_with_a_full_cache_keep_their_ids(path, pieces, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 200)
    enc, rnd = tokens.Encoder(path, pieces), random.Random(2)
    alphabet = ["ab", "C", "Éß", "À", "×", "ª", ".", "&&", "'", "'ll", "7", " ", " ", "\n", "\n\n", "_", "\u00a0"]
    texts = ["", None, *["".join(rnd.choices(alphabet, k=rnd.randint(1, 30))) for _ in range(2000)]]
    for t, got in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def check_packing(docs, pieces):
    tok = Tokenizer.from_file(WORD)
    tok.encode_special_tokens = True
    ids = {i: brute.ids_of(tok, t, 1) for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = ids[i][at : at + p["length"]]
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids[i]), brute.crc(part))
            at += p["length"]
        assert at == len(ids[i])
    sizes = []
    for _, ps in sorted(by_seq.items()):
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(sizes))) and all(s == 2048 for s in sizes[:-1])


def test_packing(spark):
    check_packing(local_docs(spark), queries()["op1_packing"](spark, SF001).collect())
    check_packing(HARD, packing.pack(hard_docs(spark), WORD, pieces="words").collect())
    assert packing.pack(empty_docs(spark), WORD).collect() == []


def check_files(docs, got):
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    at, want = 0, []
    for i, t in sorted(docs):
        ids = brute.ids_of(tok, t, 2)
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got)) == want


def test_token_files(spark):
    check_files(local_docs(spark), queries()["op4_token_files"](spark, SF001).collect())
    files = token_files.write_token_files(hard_docs(spark), BYTE, pieces="spaced", files=3)
    check_files(HARD, token_files.read_token_files(spark, files, with_ids=False).drop("ids").collect())
    assert token_files.read_token_files(spark, token_files.write_token_files(empty_docs(spark), BYTE)).collect() == []
    paths = [r["path"] for r in files.collect()]
    found = []
    for p in paths:
        with token_files.open_random(p) as f:
            found += [x.tolist() for x in token_files.FrameReader(f).find(2)]
    tok = Tokenizer.from_file(BYTE)
    assert found == [brute.ids_of(tok, dict(HARD)[2], 2)]


def test_a_damaged_frame_is_noticed(spark, tmp_path):
    files = token_files.write_token_files(hard_docs(spark).where("doc_id in (1, 2)"), BYTE, root=f"file://{tmp_path}", files=1)
    path = files.first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-5 - 4 - 1] ^= 1  # the last frame's stored checksum
    open(path, "wb").write(data)
    with token_files.open_random(path) as f, pytest.raises(ValueError):
        list(token_files.FrameReader(f).frame(0))


def test_warc(spark):
    same, rnd = "<p>" + "same " * 40 + "</p>", random.Random(3)
    big = "".join(rnd.choices("abcdefgh \r\n", k=3_000_000))
    data = [(1, None, "tiny"), (2, "u", None), (3, "http://x\r\ny", same), (9, None, same), (4, "u", same), (5, "u", "tiny"), (6, "u", big), (7, None, "\r\n\r\nWARC/1.1" * 20), (8, "u", big)]
    pages = spark.createDataFrame([(i, u, h, None) for i, u, h in data], "page_id long, url string, html string, id string").repartition(3)
    got = {r["page_id"]: r for r in warc.archive(pages, with_payload=True).collect()}
    assert len(got) == len(data)
    for i, _, h in data:
        b, r = (h or "").encode(), got[i]
        first = min(j for j, _, g in data if (g or "") == (h or ""))
        revisit = len(b) >= 100 and first != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
        assert bytes(r["payload"]) == (b"" if revisit else b)
    assert warc.archive(pages.limit(0)).collect() == []
    twice = warc.archive(spark.createDataFrame([(1, None, same), (1, None, same), (None, None, same)], "page_id long, url string, html string"))
    assert [r["record_type"] for r in twice.collect()] == ["response"] * 3


def test_substring_dedup(spark):
    docs = local_docs(spark)
    got = queries()["op3_suffix_dedup"](spark, SF001).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.removed(docs) and len(got) == len(docs)
    out = substring_dedup.remove_repeats(hard_docs(spark))
    got = out.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.removed(HARD)
    assert substring_dedup.remove_repeats(empty_docs(spark)).collect() == []
    odd = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE + "z"), (None, None)], "doc_id long, text string")
    got = rows_of(substring_dedup.remove_repeats(odd).select("id", "n_removed"))
    assert got == [(1, 0), (1, 0), (None, 0), (None, len(PASSAGE))]


def test_substring_dedup_random_texts_and_other_lengths(spark):
    rnd = random.Random(5)
    docs = [(i, "".join(rnd.choices("ab", k=rnd.randint(0, 400)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for length, anchor in ((12, 5), (20, 9), (9, 9)):
        out = substring_dedup.remove_repeats(df, length, anchor).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute.removed(docs, length)


def test_long_texts_are_cut_into_pieces_without_loss(spark, monkeypatch):
    rnd = random.Random(6)
    docs = [(i, "".join(rnd.choices("abc", k=3000))) for i in range(6)]
    docs += [(9, docs[2][1][500:1800] + docs[4][1][100:900])]
    monkeypatch.setattr(substring_dedup, "CHUNK", 257)
    rows = [(i, o, p) for i, t in docs for o, p in substring_dedup.chunks_of(t.encode(), 50)]
    for i, t in docs:
        starts = [o + k for j, o, p in rows if j == i for k in range(len(p) - 49)]
        assert sorted(starts) == list(range(len(t) - 49))


def test_simhash(spark):
    docs = local_docs(spark)
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("abcd ", k=40)) for _ in range(10)]
    docs += [(1000 + i, texts[i % 10]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fp = {i: brute.simhash(t) for i, t in docs}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    of = brute.unite(fp, links)
    assert got == {i: (fp[i], of[i]) for i in fp}
    out = simhash.near_duplicates(hard_docs(spark)).collect()
    assert {r["id"]: r["fp"] % (1 << 64) for r in out} == {i: brute.simhash(t) for i, t in HARD}
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []
    odd = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (5, "a")], "doc_id long, text string")
    assert rows_of(simhash.near_duplicates(odd).select("id", "component_id")) == [(3, 3), (3, 3), (5, 3), (None, None)]


@pytest.mark.parametrize("bits", [0, 1, 3, 4])
def test_ball_links_connect_what_all_pairs_connect(spark, bits):
    rnd = random.Random(8)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(6):
            y = x
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                y ^= 1 << b
            fps.add(y)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df, bits).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= bits for a, b in got)
    want = [(signed[x], signed[y]) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= bits]
    assert brute.unite(signed.values(), got) == brute.unite(signed.values(), want)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5050)] + [(1, 1)]
    df = spark.createDataFrame(edges + [(None, 4)], "a long, b long")
    want = brute.unite({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(df.limit(0)).collect() == []


def test_embeddings(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(300, 16))
    x = np.concatenate([base] + [base[:20] + rnd.normal(scale=s, size=(20, 16)) for s in (0.01, 0.1, 0.2, 0.3, 0.4) for _ in range(4)] + [base[:1]] * 30)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [-0.0] * 16]
    rows += [(10_000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<double>, id string").repartition(3)
    out = embedding_dedup.near_duplicates(df, shards=3).collect()
    assert len(out) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b] + [(10_006, 10_007)]
    of = brute.unite([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(n.values())
    assert all(got[i][0] <= n[i] for i in n)
    assert sum(got[i][1] != of[i] for i in n) <= 0.02 * len(n)
    assert all(got[10_000 + i] == (0, 10_000 + i, True) for i in (0, 1, 2, 3, 4, 5, 8, 9)) and got[10_007] == (1, 10_006, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_top_k(spark):
    rnd = np.random.default_rng(2)
    x = np.round(rnd.normal(size=(400, 10)), 1)
    x[50:60] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [None] * 10), (1100, [float("nan")] * 10), (1150, [1.0] * 4), (1151, [2.0] * 4), (1200, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int").repartition(3)
    ints = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, 400, 50):
        score = ints @ ints[q]
        order = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    want.append((1150, 1, 1151, 4 * 256 * 512))
    for block in (16_384, 3):
        got = exact_topk.top_k(df, df.where("vec_id % 50 = 0"), block=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert exact_topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(3)
    x = np.floor(256 * rnd.normal(size=(500, 64))).astype(np.int64)
    exact = x[:50] @ x.T
    before = None
    for n in exact_topk.SEGMENTS:
        up = exact_topk.bounds(exact_topk.statistics(x[:50], n), exact_topk.statistics(x, n))
        assert (up >= exact).all()
        assert before is None or (up <= before * (1 + 1e-6) + 1).all()
        before = up


def test_line_dedup(spark):
    docs = local_docs(spark)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (i, t), want in zip(docs, brute.drop_lines(docs)):
        assert out[i]["text"] == want
    got = line_dedup.dedup_lines(hard_docs(spark))
    assert got.columns[:-2] == hard_docs(spark).columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == dict(zip(dict(HARD), brute.drop_lines(HARD)))
    assert line_dedup.dedup_lines(empty_docs(spark)).collect() == []
    odd = [(None, SHARED), (None, SHARED + "x"), (2, SHARED), (2, SHARED + "y"), (2, SHARED + "y")]
    got = line_dedup.dedup_lines(spark.createDataFrame(odd, "doc_id long, text string"))
    assert rows_of(got.select("doc_id", "text")) == sorted(zip([i for i, _ in odd], brute.drop_lines(odd)), key=repr)


def test_perfect_hash():
    rnd = np.random.default_rng(4)
    lo, hi = rnd.integers(0, 1 << 63, 5000).astype(np.uint64), rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    lo[1] = lo[0]
    levels = line_dedup.Levels(line_dedup.build_levels(lo, hi))
    assert sorted(levels.index(lo, hi).tolist()) == list(range(5000))


def test_language_id(spark):
    out = language_id.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where(language_id.held_out("doc.doc_id"))
    n, right = out.agg(F.count("*"), F.sum((F.col("lang_pred") == F.col("doc.lang")).cast("int"))).first()
    assert n > 200 and right / n >= 0.97
    got = {r["doc"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(hard_docs(spark)).collect()}
    assert len(got) == len(HARD) and all(0 <= s <= 1 for _, s in got.values())
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 6, 16))
    assert language_id.identify(empty_docs(spark)).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(hard_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_are_those_of_the_definition(monkeypatch):
    from collections import Counter
    from math import log2

    train = {"a": [b"abracadabra", b"abc"], "b": [b"xyzzy xyz", b"abx"]}
    model = language_id.Model(train, order=3, min_context=2)
    in_all = Counter()
    counts = {k: {} for k in train}
    for lang, texts in train.items():
        for t in texts:
            for p in range(len(t)):
                for k in range(min(3, p) + 1):
                    counts[lang].setdefault(t[p - k : p], Counter())[t[p]] += 1
                    in_all[t[p - k : p]] += 1
    tree = {c for c, n in in_all.items() if n >= 2 or not c}

    def bits(lang, context, byte):
        if context in tree and context in counts[lang]:
            seen = counts[lang][context]
            n, d = seen.total(), len(seen)
            if byte in seen:
                return -log2(seen[byte] / (n + d))
            return -log2(d / (n + d)) + (bits(lang, context[1:], byte) if context else 8.0)
        return bits(lang, context[1:], byte)

    texts = [b"abracadabra", b"xyz", b"", b"qqq\xff", b"abxyzz abra", b"a"]
    want = [[sum(bits(k, t[max(0, p - 3) : p], t[p]) for p in range(len(t))) for k in ("a", "b")] for t in texts]
    assert np.allclose(model.lengths(texts), want, atol=1e-4)
    monkeypatch.setattr(language_id, "CHUNK", 4)
    assert np.allclose(model.lengths(texts), want, atol=1e-4)


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mix_documents(docs).cache()
    assert out.count() == docs.count()
    cells = out.groupBy("source", "lang", "topic").agg(F.max("weight").alias("w"), F.sum("tokens").alias("t"), F.max("probability").alias("p"))
    share = {r["lang"]: r["s"] for r in cells.groupBy("lang").agg(F.sum("w").alias("s")).collect()}
    assert all(abs(share[k] - w) < 0.02 for k, w in {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}.items())
    total = out.agg(F.sum("tokens")).first()[0]
    assert all(abs(r["p"] - min(1, 0.5 * total * r["w"] / r["t"])) < 1e-9 for r in cells.collect())
    hard = mix_documents(hard_docs(spark))
    assert hard.count() == len(HARD) and hard.where("source = '(null)'").count() > 0
    assert mix_documents(empty_docs(spark)).collect() == []
    assert mixing.ROUNDS > 1


def test_mixing_reaches_what_can_be_reached(spark):
    rows = [(s, l, t, float(n)) for s, l, t, n in (("a", "x", "p", 900), ("a", "y", "p", 300), ("b", "x", "q", 60), ("b", "y", "p", 500), ("c", "x", "p", 400), ("c", "y", "q", 40))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    wanted = {"source": {"a": 0.3, "b": 0.4, "c": 0.3}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.5, "q": 0.5}}
    raked, goals = mixing.rake(cells, wanted, keep=0.5, rounds=60)
    assert all(r["weight"] <= r["most"] * (1 + 1e-12) for r in raked.collect())
    found = {(r["marginal"], r["value"]): r for r in mixing.residuals(raked, goals).collect()}
    # Only 100 of 1100 tokens are of topic q: all of them, and p has the rest.
    assert abs(found["topic", "q"]["target"] - 100 / 1100) < 1e-12 and found["topic", "q"]["wanted"] == 0.5
    assert abs(sum(r["target"] for (m, _), r in found.items() if m == "topic") - 1) < 1e-12
    assert max(r["residual"] for r in found.values()) < 1e-3
    shuffled, _ = mixing.rake(cells, {**wanted, "lang": {"x": 1.0, "y": 0.0}}, keep=0.3, rounds=8)
    assert all(r["weight"] == 0 for r in shuffled.where("lang = 'y'").collect())


def test_mixing_with_many_cells(spark, monkeypatch):
    cells = spark.range(60).selectExpr("concat('s', id % 12) as source", "concat('l', id div 12) as lang", "cast(10 + id * id as double) as tokens")
    wanted = {"source": None, "lang": {"l0": 0.3, "l1": 0.3}}
    whole = {(r["source"], r["lang"]): r["weight"] for r in mixing.rake(cells, wanted)[0].collect()}
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 10)
    dealt = {(r["source"], r["lang"]): r["weight"] for r in mixing.rake(cells, wanted)[0].collect()}
    assert whole.keys() == dealt.keys() and all(abs(whole[k] - dealt[k]) < 1e-12 for k in whole)

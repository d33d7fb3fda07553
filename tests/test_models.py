"""Balancing, TF-IDF, Naive Bayes, scores and metrics against plain-Python references."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aspectra.functions import vectors as V
from aspectra.operators import balance as BL
from aspectra.operators import bayes as B
from aspectra.operators import features as FE
from aspectra.operators import metrics as ME

CORPUS = [
    (0, "good phone good price", 2),
    (1, "bad battery bad screen", 0),
    (2, "ok phone ok price", 1),
    (3, "good screen great battery", 2),
    (4, "bad price", 0),
    (5, "ok ok", 1),
    (6, "good good good", 2),
    (7, "", 1),
]


def _tokens(s):
    return re.findall(r"(?u)\b\w\w+\b", s.lower())


def _py_tfidf(docs, vocab_size=5000):
    tfs = [Counter(_tokens(d)) for d in docs]
    total = Counter()
    df = Counter()
    for tf in tfs:
        total.update(tf)
        df.update(tf.keys())
    vocab = sorted(sorted(total, key=lambda t: (-total[t], t))[:vocab_size])
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    rows = []
    for tf in tfs:
        w = {t: tf[t] * idf[t] for t in tf if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        rows.append({t: v / norm for t, v in w.items()} if norm else {})
    return vocab, idf, rows


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "id bigint, text string, label int")


def test_tfidf_matches_python(spark, corpus):
    tf = FE.term_counts(corpus, "text", ["id"], 1, 1, carry=["label"])
    n = corpus.select(F.count(F.lit(1))).scalar()
    vocab = FE.fit_vocabulary(tf, n, 5000)
    w = FE.tfidf(tf, vocab, ["id"])
    got = {(r["id"], r["term"]): r["weight"] for r in w.collect()}
    pv, pidf, prow = _py_tfidf([t for _, t, _ in CORPUS])
    assert sorted(r["term"] for r in vocab.collect()) == pv
    for i, row in enumerate(prow):
        for t, v in row.items():
            assert got[(i, t)] == pytest.approx(v, rel=1e-12)
    assert len(got) == sum(len(r) for r in prow)


def test_naive_bayes_matches_formulas(spark, corpus):
    alpha = 0.5
    tf = FE.term_counts(corpus, "text", ["id"], 1, 1, carry=["label"])
    n = corpus.select(F.count(F.lit(1))).scalar()
    vocab = FE.fit_vocabulary(tf, n, 5000)
    w = FE.tfidf(tf, vocab, ["id"], carry=["label"])
    model = B.fit(corpus, w, vocab, label="label", alpha=alpha)
    pv, _, prow = _py_tfidf([t for _, t, _ in CORPUS])
    labels = [c for _, _, c in CORPUS]
    classes = sorted(set(labels))
    fc = {c: Counter() for c in classes}
    for row, c in zip(prow, labels):
        for t, v in row.items():
            fc[c][t] += v
    lp = {(t, c): math.log(fc[c][t] + alpha) - math.log(sum(fc[c].values()) + alpha * len(pv)) for c in classes for t in pv}
    got = {(r["term"], r["cls"]): r["log_prob"] for r in model.term_lp.collect()}
    assert set(got) == set(lp)
    for k, v in lp.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    prior = {r["cls"]: r["log_prior"] for r in model.prior.collect()}
    for c in classes:
        assert prior[c] == pytest.approx(math.log(labels.count(c) / len(labels)))
    # Scores: prior + sum w * lp; the empty document scores its prior.
    scored = B.joint_log_likelihood(model, corpus, FE.tfidf(tf, vocab, ["id"]), ["id"])
    s = {r["id"]: list(r["scores"]) for r in scored.collect()}
    assert len(s) == len(CORPUS)
    for i, row in enumerate(prow):
        for j, c in enumerate(classes):
            assert s[i][j] == pytest.approx(prior[c] + sum(v * lp[(t, c)] for t, v in row.items()), rel=1e-9)
    probs = scored.select(V.softmax(F.col("scores")).alias("p")).collect()
    for r in probs:
        assert sum(r["p"]) == pytest.approx(1.0)


def test_shared_text_scoring_equals_direct(spark, corpus):
    tf = FE.term_counts(corpus, "text", ["id"], 1, 1, carry=["label"])
    n = corpus.select(F.count(F.lit(1))).scalar()
    vocab = FE.fit_vocabulary(tf, n, 5000)
    model = B.fit(corpus, FE.tfidf(tf, vocab, ["id"], carry=["label"]), vocab, label="label", alpha=0.1)
    heads = spark.createDataFrame([(0, "h1", "about good, "), (0, "h2", "about phone, "), (7, "h1", "about ok, ")],
                                  "id bigint, hk string, head string")
    shared = B.joint_log_likelihood_shared(model, vocab, heads, "head", ["id", "hk"], corpus, "text", ["id"])
    full = heads.join(corpus, "id").select("id", "hk", F.concat("head", "text").alias("doc"))
    ftf = FE.term_counts(full, "doc", ["id", "hk"], 1, 1)
    direct = B.joint_log_likelihood(model, full, FE.tfidf(ftf, vocab, ["id", "hk"]), ["id", "hk"])
    a = {(r["id"], r["hk"]): r["scores"] for r in shared.collect()}
    b = {(r["id"], r["hk"]): r["scores"] for r in direct.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


@pytest.mark.parametrize("bytes_", [0, B.BROADCAST_HEAD_BYTES])
def test_scoring_by_head_equals_direct(spark, corpus, monkeypatch, bytes_):
    monkeypatch.setattr(B, "BROADCAST_HEAD_BYTES", bytes_)
    tf = FE.term_counts(corpus, "text", ["id"], 1, 1, carry=["label"])
    vocab = FE.fit_vocabulary(tf, corpus.select(F.count(F.lit(1))).scalar(), 5000)
    model = B.fit(corpus, FE.tfidf(tf, vocab, ["id"], carry=["label"]), vocab, label="label", alpha=0.1)
    heads = spark.createDataFrame([("h1", "about good, "), ("h2", "good good phone, "), ("h3", "? "), ("h4", "never seen, ")], "hk string, head string")
    empty = spark.createDataFrame([(99, "", 0)], corpus.schema)
    texts = corpus.unionByName(empty)
    pairs = texts.select("id").crossJoin(heads.select("hk"))
    got = B.joint_log_likelihood_by_head(model, vocab, pairs, heads, "hk", "head", texts, "text", ["id"])
    full = pairs.join(heads, "hk").join(texts, "id").select("id", "hk", F.concat("head", "text").alias("doc"))
    ftf = FE.term_counts(full, "doc", ["id", "hk"], 1, 1)
    direct = B.joint_log_likelihood(model, full, FE.tfidf(ftf, vocab, ["id", "hk"]), ["id", "hk"])
    a, b = ({(r["id"], r["hk"]): r["scores"] for r in x.collect()} for x in (got, direct))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def test_bootstrap_is_exact_and_deterministic(spark):
    data = [(i, "x", 0 if i < 3 else (1 if i < 10 else 2)) for i in range(40)]
    df = spark.createDataFrame(data, "id bigint, t string, label int")
    boot = BL.bootstrap(df, "label", ["id"], n_buckets=4)
    counts = dict((r["label"], r["n"]) for r in boot.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
    assert counts == {0: 30, 1: 30, 2: 30}
    ids = {r["id"] for r in boot.collect()}
    assert ids <= set(range(40))
    again = BL.bootstrap(df.repartition(5), "label", ["id"], n_buckets=7)
    assert sorted(map(tuple, boot.select("label", "slot", "id").collect())) == sorted(
        map(tuple, again.select("label", "slot", "id").collect())
    )


def test_bootstrap_is_the_same_by_broadcast_and_by_shuffle(spark):
    data = [(i, "x" * i, 0 if i < 3 else (1 if i < 10 else 2)) for i in range(40)]
    df = spark.createDataFrame(data, "id bigint, t string, label int")
    drawn = [sorted(map(tuple, BL.bootstrap(df, "label", ["id"], broadcast_bytes=b).select("label", "slot", "id", "t").collect())) for b in (1 << 20, 200, 0)]
    assert len(drawn[0]) == 90 and drawn[0] == drawn[1] == drawn[2]


def test_range_buckets_follow_the_order_and_are_bounded(spark):
    for lo, hi in ((0, 0), (5, 104), (-50, 49), (0, 10**15)):
        ids = sorted({lo, hi, (lo + hi) // 2, lo + (hi - lo) // 3})
        df = spark.createDataFrame([(i,) for i in ids], "id bigint")
        got = [r["b"] for r in df.select("id", BL.range_bucket(F.col("id"), lo, hi, 10).alias("b")).orderBy("id").collect()]
        assert got == sorted(got) and 0 <= got[0] and got[-1] < 10


def test_ordered_index_is_dense(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    idx = BL.ordered_index(df, ["g"], (F.col("id") / 50).cast("bigint"), [F.col("id")])
    for g in range(3):
        got = [r["idx"] for r in idx.where(F.col("g") == g).orderBy("id").collect()]
        assert got == list(range(len(got)))
    sh = BL.shuffle_index(df, ["id"])
    assert sorted(r["row_index"] for r in sh.collect()) == list(range(1000))


def test_synonym_replace(spark):
    df = spark.createDataFrame([(0, "good  phone"), (1, ""), (2, "plain words")], "id bigint, s string")
    syn = spark.createDataFrame([("good", 0, "fine"), ("good", 1, "nice"), ("phone", 0, "handset")], "word string, set_no int, lemma string")
    out = {r["id"]: r["augmented"] for r in BL.synonym_replace(df, "s", ["id"], syn).collect()}
    assert out[1] == "" and out[2] == "plain words"
    first, second = out[0].split(" ")
    assert first in ("fine", "nice") and second == "handset"


def test_metrics(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2), (0, 0), (1, 1)]
    df = spark.createDataFrame(pairs, "label int, pred int")
    cm = {r["label"]: (r["c0"], r["c1"], r["c2"]) for r in ME.confusion_matrix(df).collect()}
    assert cm == {0: (2, 1, 0), 1: (0, 2, 0), 2: (0, 1, 2)}
    rep = {r["name"]: r for r in ME.class_report(df).collect()}
    assert rep["negative"]["precision"] == pytest.approx(1.0)
    assert rep["neutral"]["precision"] == pytest.approx(0.5)
    assert rep["positive"]["recall"] == pytest.approx(2 / 3)
    assert rep["accuracy"]["f1"] == pytest.approx(6 / 8)
    macro_f1 = sum(rep[n]["f1"] for n in ("negative", "neutral", "positive")) / 3
    assert rep["macro avg"]["f1"] == pytest.approx(macro_f1)
    # A class never predicted and never true still gets its row, with zeros.
    only = spark.createDataFrame([(0, 0), (0, 1)], "label int, pred int")
    rep2 = {r["name"]: r for r in ME.class_report(only).collect()}
    assert rep2["positive"]["support"] == 0 and rep2["positive"]["f1"] == 0.0


def test_losses_and_vote(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.1], 0), ([0.0, 0.0, 0.0], 2)], "s array<double>, y int")
    r = df.select(V.cross_entropy(F.col("s"), F.col("y")).alias("ce"), V.argmax(F.col("s")).alias("am")).collect()
    lse = math.log(sum(math.exp(x) for x in [2.0, 1.0, 0.1]))
    assert r[0]["ce"] == pytest.approx(lse - 2.0)
    assert r[1]["ce"] == pytest.approx(math.log(3))
    assert r[1]["am"] == 0  # first index on ties
    fl = df.select(V.focal_loss(V.cross_entropy(F.col("s"), F.col("y")), F.col("y"), (0.5, 2.0, 1.0), 2.0).alias("f")).collect()
    ce0 = lse - 2.0
    assert fl[0]["f"] == pytest.approx(0.5 * (1 - math.exp(-ce0)) ** 2 * ce0)
    v = spark.createDataFrame([(1, [0.1, 0.9, 0.0], 2), (1, [0.1, 0.5, 0.0], 2), (2, [0.0, 0.0, 1.0], 2)],
                              "a int, s array<double>, b int")
    got = [x["f"] for x in v.select(V.fuse_vote(F.col("a"), F.col("s"), F.col("b")).alias("f")).collect()]
    assert got == [1, 2, 2]


def test_batch_mean_weights_short_batch_equally(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 16 else 0.0) for i in range(20)], "pos int, v double")
    r = ME.batch_mean(df, "v", "pos", 16).first()
    assert r["n_batches"] == 2 and r["mean_loss"] == pytest.approx(0.5)


def _hf_longest_first(a, b, budget):
    a, b = list(a), list(b)
    for _ in range(max(0, len(a) + len(b) - budget)):
        if len(a) > len(b):
            a.pop()
        else:
            b.pop()
    return len(a), len(b)


def test_encode_pairs_truncation(spark):
    cases = [(3, 2), (300, 2), (2, 300), (200, 200), (127, 126), (126, 127), (0, 0), (260, 1)]
    data = [(i, " ".join(f"w{j}" for j in range(la)), " ".join(f"v{j}" for j in range(lb))) for i, (la, lb) in enumerate(cases)]
    df = spark.createDataFrame(data, "id bigint, a string, b string")
    vocab = spark.createDataFrame([("w0", 4)], "word string, token_id int")
    enc = {r["id"]: (list(r["input_ids"]), list(r["attention_mask"])) for r in FE.encode_pairs(df, "a", "b", ["id"], vocab).collect()}
    for i, (la, lb) in enumerate(cases):
        ka, kb = _hf_longest_first(range(la), range(lb), FE.MAX_LENGTH - 4)
        ids, mask = enc[i]
        assert len(ids) == FE.MAX_LENGTH and sum(mask) == ka + kb + 4
        assert ids[0] == FE.BOS_ID and ids[ka + 1:ka + 3] == [FE.EOS_ID, FE.EOS_ID]


def test_ml_naive_bayes_cross_check(spark, corpus):
    """Spark ML's multinomial NaiveBayes smooths the likelihood exactly like ours;
    its prior is smoothed too (ln(n_c + a) - ln(N + a C)), ours is not."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import array_to_vector

    alpha = 0.7
    tf = FE.term_counts(corpus, "text", ["id"], 1, 1, carry=["label"])
    n = corpus.select(F.count(F.lit(1))).scalar()
    vocab = FE.fit_vocabulary(tf, n, 5000)
    w = FE.tfidf(tf, vocab, ["id"], carry=["label"])
    ours = B.fit(corpus, w, vocab, label="label", alpha=alpha)
    v = vocab.count()
    dense = (
        corpus.select("id", "label")
        .join(w.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m")), "id", "left")
        .select(
            F.col("label").cast("double").alias("label"),
            array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(v - 1)),
                                        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))).alias("features"),
        )
    )
    ml = NaiveBayes(smoothing=alpha, modelType="multinomial").fit(dense)
    theta = ml.theta.toArray()
    idx = {r["term"]: r["idx"] for r in vocab.collect()}
    for r in ours.term_lp.collect():
        assert theta[r["cls"], idx[r["term"]]] == pytest.approx(r["log_prob"], rel=1e-9)
    counts = Counter(c for _, _, c in CORPUS)
    pi = ml.pi.toArray()
    for c in sorted(counts):
        assert pi[c] == pytest.approx(math.log(counts[c] + alpha) - math.log(len(CORPUS) + alpha * len(counts)))


def test_same_result_for_1_and_8_partitions(spark):
    from tests.conftest import SF001, rows
    import __spark_entry__ as E

    q = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = {n: rows(q[n](spark, SF001)) for n in ("prepare_triples", "bootstrap_balance", "nb_predict")}
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = {n: rows(q[n](spark, SF001)) for n in one}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight

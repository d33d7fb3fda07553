"""Learned synonym sets: against a brute-force version, on planted words, and the defined cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from aspectra.operators import balance, synonyms
from tests.conftest import rows

SCHEMA = "doc_id long, text string"


def brute(texts):
    """{word: [[lemma, ...], ...]}"""
    n, nw, nf = Counter(), Counter(), Counter()
    for t in texts:
        t = re.findall(r"\w+", (t or "").lower())
        for a, b in zip(t, t[1:]):
            n.update([(b, "l:" + a), (a, "r:" + b)])
    for (w, f), k in n.items():
        nw[w] += k
        nf[f] += k
    total, weight, own, of = sum(n.values()), {}, Counter(), defaultdict(list)
    for (w, f), k in n.items():
        if k >= synonyms.MIN_PAIR and nw[w] >= synonyms.MIN_COUNT:
            x = math.floor(1000.0 * math.log(k * total / (nw[w] * nf[f])) * (k / (k + 1.0)))
            if x > 0:
                weight[w, f] = x
                own[w] += x
                of[f].append((-x, w))
    common, shared = Counter(), Counter()
    for f, ws in of.items():
        kept = sorted(w for _, w in sorted(ws)[: synonyms.PER_FEATURE])
        for i, a in enumerate(kept):
            for b in kept[i + 1 :]:
                shared[a, b] += 1
                common[a, b] += min(weight[a, f], weight[b, f])
    near = defaultdict(list)
    for (a, b), s in common.items():
        sim = s / (own[a] + own[b] - s)
        if shared[a, b] >= synonyms.SHARED and sim >= synonyms.LEAST:
            near[a].append((-sim, b))
            near[b].append((-sim, a))
    near = {w: [v for _, v in sorted(vs)[: synonyms.NEIGHBOURS]] for w, vs in near.items()}
    out = {}
    for w, vs in near.items():
        seen, out[w] = set(), []
        for v in vs:
            members = [v] + [u for u in vs if u != v and u in near[v]]
            if frozenset(members) not in seen:
                seen.add(frozenset(members))
                out[w].append(members)
    return out


def learned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    out = defaultdict(dict)
    for w, s, i, lemma in rows(synonyms.learn_synonyms(df, "text"), "word", "set_no", "lemma_no", "lemma"):
        out[w].setdefault(s, []).append(lemma)
    assert all(sorted(sets) == list(range(len(sets))) for sets in out.values())
    return {w: [sets[i] for i in sorted(sets)] for w, sets in out.items()}


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [a + b for a in "bdfgk" for b in ("a", "e", "iu", "oÀ")]
    texts = [" ".join(rnd.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rnd.randint(0, 40))) for _ in range(150)]
    texts += texts[:20] + [None, "", "alone", "  ,;"]
    want = brute(texts)
    assert len(want) > 5 and any(len(s) > 1 for sets in want.values() for s in sets)
    assert learned(spark, texts) == want


def test_words_of_the_same_contexts_are_a_set_and_senses_stay_apart(spark):
    """``bank`` stands both where money words and where river words stand."""
    rnd = random.Random(6)
    money, river = ["bank", "broker", "lender"], ["bank", "shore", "coast"]
    texts = []
    for i in range(300):
        texts.append(f"{rnd.choice(['our', 'their', 'your'])} {rnd.choice(money)} {rnd.choice(['pays', 'lends', 'insures'])}")
        texts.append(f"{rnd.choice(['sandy', 'rocky', 'muddy'])} {rnd.choice(river)} {rnd.choice(['floods', 'erodes', 'dries'])}")
    sets = learned(spark, texts)
    assert [sorted(s) for s in sets["broker"] if "lender" in s and "bank" in s]
    assert sorted(sorted(s) for s in sets["bank"]) == [["broker", "lender"], ["coast", "shore"]]
    assert not any({"broker", "lender"} & set(s) for s in sets["shore"])


def test_one_hot_feature_gives_a_bounded_number_of_pairs(spark):
    """Thousands of words after the same word: the feature keeps its most telling ones, not all pairs."""
    texts = [f"the w{i} runs" for i in range(3000) for _ in range(6)] + ["filler text"] * 5000
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    weighed = synonyms.weights(synonyms.contexts(df, "text"))
    assert weighed.where("feature = 'l:the'").count() == 3000
    near = synonyms.neighbours(weighed)
    words = near.select("word").distinct().count()
    assert words == synonyms.PER_FEATURE
    assert near.count() == words * synonyms.NEIGHBOURS


def test_no_text_and_replacement(spark):
    assert learned(spark, []) == {} and learned(spark, [None, "", "one"]) == {}
    texts = [f"{a} {w} {b}" for w in ("cheap", "costly") for a in ("very", "too") for b in ("meal", "room") for _ in range(4)]
    sets = synonyms.first_lemmas(synonyms.learn_synonyms(spark.createDataFrame(list(enumerate(texts + ["other words here"] * 30)), SCHEMA), "text"))
    got = spark.createDataFrame([(1, "a cheap meal"), (2, ""), (3, None)], SCHEMA)
    out = dict(rows(balance.synonym_replace(got.where(F.col("text").isNotNull()), "text", ["doc_id"], sets), "doc_id", "augmented"))
    assert out[1].split()[1] == "costly" and out[2] == ""

"""The pipeline's stages against brute force, each on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from aspectra.llm import language_id
from pyspark.sql import functions as F
from tests.conftest import SF001
from tests.llm import brute
from tests.llm.test_operators import check_packing, empty_docs, hard_docs


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.keep_identified(spark, docs, SF001)
    scored = language_id.identify(docs).where("lang_pred <> 'und' and score >= 0.5").select("doc.doc_id")
    assert kept.columns == columns and sorted(map(tuple, kept.select("doc_id").collect())) == sorted(map(tuple, scored.collect()))
    assert kept.count() >= 0.97 * docs.count()

    lines = corpus_pipeline.drop_repeated_lines(spark, kept, SF001).cache()
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert lines.columns == columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()} == {i: (t, len(t)) for (i, _), t in zip(before, brute.drop_lines(before))}

    single = corpus_pipeline.keep_one_of_each_group(spark, lines, SF001).cache()
    fp = {r["doc_id"]: brute.simhash(r["text"]) for r in lines.collect()}
    of = brute.unite(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == set(of.values())

    mixed = corpus_pipeline.mix_sources(spark, single, SF001).cache()
    assert mixed.columns == columns and 0 < mixed.count() < single.count()

    pieces = corpus_pipeline.pack_windows(spark, mixed, SF001).collect()
    check_packing([(r["doc_id"], r["text"]) for r in mixed.collect()], pieces)
    ran = corpus_pipeline.run(spark, SF001)
    assert sorted(map(tuple, ran.drop("start", "offset", "sequence_id", "length", "ids_crc32").distinct().collect())) == sorted({(p["doc_id"], p["doc_tokens"]) for p in pieces})


def test_hard_and_empty_tables(spark):
    for docs in (hard_docs(spark), empty_docs(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF001)
            assert docs.columns == columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
        assert pieces.where(F.col("doc_tokens") < 1).count() == 0

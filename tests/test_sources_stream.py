"""File sources/sinks, the driver-table catalogue smoke run, and stream = batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.session import scratch_path
from aspectra.sources import files as S
from tests.conftest import SF001, rows


def test_three_line_reader_edge_cases(spark, tmp_path):
    p = tmp_path / "train.raw"
    # \r\n endings, $T$ twice, no $T$, empty aspect line, incomplete last group.
    p.write_bytes("a $T$ b $T$\r\nasp\r\n1\r\nno placeholder\r\n\r\n-1\r\nlast\r\nalone\r\n".encode("utf-8"))
    records, rejects = S.read_three_line(spark, str(p))
    got = rows(records, "rec_no", "sentence", "aspect", "sentiment")
    assert got == [(0, "a $T$ b $T$", "asp", "1"), (1, "no placeholder", "", "-1")]
    assert rows(rejects, "rec_no", "n_lines") == [(2, 2)]


def test_line_numbers_across_many_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    n = 60000
    p.write_text("".join(f"line {i}\n" for i in range(n)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = S.numbered_lines(spark, str(p))
        assert df.rdd.getNumPartitions() > 4
        bad = df.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count()
        assert bad == 0 and df.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tsv_round_trip_with_na_strings(spark):
    df = spark.createDataFrame([("s1", "NA", "1"), ("s2", "a", "null"), ("s3", "b", "0")], S.TRIPLE_SCHEMA)
    path = scratch_path(spark, "tsv-test")
    S.write_tsv(df, path)
    back = S.read_tsv(spark, path)
    assert rows(back) == sorted([("s1", None, "1"), ("s2", "a", None), ("s3", "b", "0")], key=lambda t: t[0])


def test_valid_triples_arity(spark):
    lines = spark.createDataFrame([("a\tb\tc",), ("\tb\tc",), ("a\tb\tc\td",), ("a\tb",), ("  a\tb\t1 \n",)], "value string")
    got = rows(S.valid_triples(lines))
    assert got == [("a", "b", "1"), ("a", "b", "c")]


def test_every_query_runs_on_smallest_tables(spark):
    import __spark_entry__ as E

    qs = E.queries()
    sql = E.oracle_sql()
    assert len(qs) >= 60
    missing = set(qs) - set(sql)
    assert {n for n in missing if n != "pipeline" and not n.startswith("op")} == {"lr_train_score", "pipeline_store_score"}
    for name in ("aspect_counts", "prepare_triples", "nb_report", "fuse_vote", "best_run", "bootstrap_balance"):
        assert qs[name](spark, SF001).count() >= 0
    assert E.entry(spark).count() > 0


def test_stream_equals_batch(spark):
    import __spark_entry__ as E

    qs = E.queries()
    batch = qs["infer_aspects"](spark, SF001)
    stream = qs["stream_infer"](spark, SF001)
    assert rows(batch) == rows(stream.select(*batch.columns))


TSV_ROWS = [
    ("  lead", "trail  ", "1"),
    ('say "hi"', "back\\slash", "0"),
    ("ünï", "#", "-1"),
    (None, "empty", None),
]


def test_plain_tsv_keeps_fields_as_they_are(spark, tmp_path):
    path = str(tmp_path / "plain")
    S.write_tsv(spark.createDataFrame(TSV_ROWS, S.TRIPLE_SCHEMA).coalesce(1), path)
    assert sorted(map(tuple, S.read_tsv(spark, path).collect()), key=repr) == sorted(TSV_ROWS, key=repr)


def test_quoted_tsv_is_that_of_data_frame_libraries(spark, tmp_path):
    import glob

    import pandas as pd

    rows = TSV_ROWS + [("a\tb", "line\nend", '"'), ("x", '""', "a\rb")]
    path = str(tmp_path / "quoted")
    S.write_tsv(spark.createDataFrame(rows, S.TRIPLE_SCHEMA).coalesce(1), path, quote=True)
    back = S.read_tsv(spark, path, quote=True)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    own = pd.read_csv(glob.glob(path + "/part-*")[0], sep="\t", header=None, lineterminator="\n", keep_default_na=False, dtype=str)
    assert sorted(map(tuple, own.values.tolist()), key=repr) == sorted((tuple(x or "" for x in r) for r in rows), key=repr)
    other = str(tmp_path / "theirs.tsv")
    pd.DataFrame(rows).to_csv(other, sep="\t", header=False, index=False)
    assert sorted(map(tuple, S.read_tsv(spark, other, quote=True).collect()), key=repr) == sorted(rows, key=repr)


def test_an_empty_stream_source_gives_an_empty_table(spark, tmp_path):
    from aspectra.streaming.infer_stream import run_available

    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "a long").schema
    out = run_available(spark, str(tmp_path / "in"), schema, lambda d: d.selectExpr("a + 1 as b"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert out.columns == ["b"] and out.collect() == []


def test_several_micro_batches(spark, tmp_path):
    from aspectra.streaming.infer_stream import run_available

    spark.range(40).repartition(4).write.parquet(str(tmp_path / "in"))
    schema = spark.range(1).schema
    out = run_available(spark, str(tmp_path / "in"), schema, lambda d: d.selectExpr("id * 2 as b"), str(tmp_path / "out"), str(tmp_path / "ck"), max_files_per_trigger=1)
    assert sorted(r["b"] for r in out.collect()) == list(range(0, 80, 2))
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch_id=")]) >= 2


def test_bootstrap_ignores_rows_without_a_class(spark):
    from aspectra.operators import balance as B

    df = spark.createDataFrame([(i, i % 2 if i < 9 else None) for i in range(12)], "id long, label int")
    out = B.bootstrap(df, "label", ["id"])
    assert sorted(r["n"] for r in B.class_counts(out).collect()) == [5, 5]

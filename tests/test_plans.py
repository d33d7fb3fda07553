"""Plan-shape guards: the exchanges and broadcasts the design relies on."""

from __future__ import annotations

from aspectra.operators import features as FE
from aspectra.plans import tables as D
from aspectra.plans import training as TR
from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_shape(spark):
    import __spark_entry__ as E

    plan = _plan(E.queries()["aspect_counts"](spark, SF001))
    assert "BroadcastHashJoin" in plan  # lexicon side broadcast, never shuffled
    assert "BroadcastNestedLoopJoin" not in plan
    # documents spread (small file) + lexicon term count + final per-aspect count
    assert plan.count("Exchange hashpartitioning") <= 3
    # the per-clause longest-hit aggregate reuses the document partitioning
    final, partial = plan.index("SortAggregate(key=[doc_id"), plan.rindex("SortAggregate(key=[doc_id")
    assert "Exchange" not in plan[final:partial]


def test_tfidf_needs_one_exchange_per_row_key(spark):
    tf = FE.term_counts(D.lines(spark, SF001), "sentence", ["doc_id", "line_no"], 1, 2)
    vocab = spark.createDataFrame([("the", 0, 1.0)], "term string, idx int, idf double")
    plan = _plan(FE.tfidf(tf, vocab, ["doc_id", "line_no"], vocab_bound=1))
    # the explicit repartition by the row key; count and norm window add none
    assert plan.count("Exchange hashpartitioning(doc_id") == 2  # spread of the documents + row key
    assert "Window" in plan and "BroadcastHashJoin" in plan


def test_cleaning_regexes_evaluated_once(spark):
    plan = _plan(TR.P.prepare_triples(D.raw_triples(spark, SF001), keys=["doc_id", "line_no"]))
    # one cleaning chain (four nested regexes) for the sentence and one for the
    # aspect; pushed-down filters must not repeat them
    assert plan.count("regexp_replace(f") == 2
    assert plan.count("\\*+") == 2

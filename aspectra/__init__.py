"""aspectra: aspect-level opinion mining as Spark DataFrame jobs.

Layout:
    functions/  column expressions (text classes, hashing, score vectors)
    sources/    readers and writers (three-line files, TSV, lexicon, model tables)
    operators/  DataFrame -> DataFrame steps (prepare, clauses, match, balance,
                features, bayes, scoring, metrics)
    plans/      end-to-end compositions and the query catalogue
    streaming/  the stateless inference path on Structured Streaming
"""

from aspectra.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]

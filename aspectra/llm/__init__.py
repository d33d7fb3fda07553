"""Training-data operators. Nothing outside this folder imports it; ``corpus_pipeline.py``
and ``__spark_entry__.py`` are its only users."""

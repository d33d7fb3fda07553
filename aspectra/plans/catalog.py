"""Query catalogue: one entry per operator of the inventory, each a function
(spark, sf_dir) -> DataFrame over the driver's tables.

Results are normalised for comparison with the SQL oracle: integral columns
become BIGINT and floating columns DOUBLE rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# Queries whose result has no SQL oracle (iterative fits); the driver checks rows only.
NO_ORACLE: set[str] = set()


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: bool = True):
    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if not oracle:
            NO_ORACLE.add(name)
        return run

    return register


def _load_all() -> None:
    # Importing the modules registers their queries.
    from aspectra.plans import queries_text  # noqa: F401
    from aspectra.plans import queries_model  # noqa: F401
    from aspectra.plans import queries_eval  # noqa: F401
    from aspectra.plans import queries_infer  # noqa: F401
    from aspectra.plans import queries_fit  # noqa: F401
    from aspectra.plans import queries_files  # noqa: F401


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)

"""The stateless inference path on Structured Streaming.

Arriving documents are processed micro-batch by micro-batch with
``foreachBatch``: each micro-batch is an ordinary DataFrame, so the batch
functions (clause split, broadcast lexicon join, per-clause aggregates, the
two models) apply unchanged and no streaming state is kept between batches;
every clause is complete inside the micro-batch that carries its document.
The sink is Parquet, one folder per batch id written in overwrite mode, so a
replayed batch after a failure rewrites the same folder (idempotent).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def run_available(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    sink_path: str,
    checkpoint_path: str,
    max_files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Process everything available under the ``source_path`` folder (files
    matching ``glob``) and return the sink as a table."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    # An empty source runs no batch; its result is the transform of no rows.
    out_schema = transform(spark.createDataFrame([], schema)).schema
    written: list[str] = []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
        written.append(str(batch_id))

    q = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink_path)
    if not written and not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], out_schema)
    return spark.read.schema(out_schema).parquet(sink_path).select(*out_schema.fieldNames())

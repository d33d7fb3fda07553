"""Session and scratch-space helpers.

Scratch output (round-trip files, model tables, stream sinks and checkpoints)
always goes below the shared folder the cluster names in
``spark.checkpoint.dir``. A folder of our own is only set when the session has
none, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "aspectra") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if none is configured."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="aspectra-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder name below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "aspectra-scratch", f"{label}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a small input by ``keys`` when it arrives in fewer
    partitions than there are task slots.

    Big inputs already come in many file splits and are left alone; a small
    file (often one split) would otherwise run regex-heavy text work in one task.
    The splits are estimated from the plan's size; nothing is run to find out.
    Partitioning by the row key also means later aggregations on keys that
    start with it need no further exchange.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    plan_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if plan_bytes >= slots * split_bytes:
        return df
    return df.repartition(slots, *keys)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (lineage cut) into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

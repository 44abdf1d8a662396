"""Cutting lineage through the shared folder the cluster names for checkpoints; sizes of tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_PARTITION = 400_000
BYTES_PER_TASK = BYTES_PER_SPLIT = "16m"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _application_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder among this application's tables, which ``drop_tables`` deletes with them."""
    return f"{_application_folder(spark)}/{uuid.uuid4()}"


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables and scratch folders of this application.

    For the end of a job: frames that still read them fail afterwards.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def size_tasks(spark: SparkSession, rows: int) -> None:
    """Bound what a task of this session's queries takes, for a largest table of ``rows`` rows.

    A shuffle starts from a partition for every ``ROWS_PER_PARTITION`` rows, and Spark joins small
    ones up to ``BYTES_PER_TASK``. With a fixed number of partitions, or the 64 MB and more of
    compressed rows that Spark gives a task by itself, sorts and hash tables of a task grow with
    the tables until they spill.
    """
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                   str(max(fixed, -(-rows // ROWS_PER_PARTITION))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", BYTES_PER_TASK)
    spark.conf.set("spark.sql.files.maxPartitionBytes", BYTES_PER_SPLIT)


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write a frame as a table in the checkpoint folder and go on from there.

    The table outlives any executor. Unlike a checkpointed RDD it is columnar, so later
    reads take only the columns they need, and its size is known to the planner. With
    ``drop_shuffles`` the shuffle files behind it go as soon as it is written, and not when
    the driver happens to collect garbage; no other job should run in the session meanwhile.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    if drop_shuffles:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)

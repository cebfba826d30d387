"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on: one time zone and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Keeps all cores busy on small inputs; large ones are split by parallelism anyway.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64kb")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode with the setting unset (tests). On a cluster a
    missing setting is an error, since a machine-local folder does not outlive an executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_roots.setdefault(
            context.applicationId, tempfile.mkdtemp(prefix="rivertrace-")
        )
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for results that several readers use in part:
    each reads only its columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitions a small table over all cores before each of its rows is expanded to many.

    The number is explicit, as adaptive execution would merge so little data into one task.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *columns)

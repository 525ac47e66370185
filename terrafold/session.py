"""Session helpers: where intermediate tables go and how they are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``; without it, work is refused."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before using this operator")


def use_local_folder(spark: SparkSession) -> None:
    """Give a one-machine session without a shared folder a temporary one; other sessions stay as they are.

    For entry points such as tests and benchmarks; operators never call it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured and re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrafold-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet.

    All paths of one application share a folder, so it can be removed when the
    application has ended.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/terrafold/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    The result survives executor loss, cuts the lineage, and carries its true
    size, so Spark broadcasts it in a later join only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise. As a
    plain scan it is also a join side whose hot keys adaptive execution can
    split, which the output of an aggregation is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    stored._stored_at = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned and nothing reads any more.

    The driver's JVM then collects its garbage, so that Spark's cleaner also drops
    the shuffle files of the finished steps; a long job's disk need is that of
    its largest step, not of all.
    """
    if not tables:
        return
    sc = tables[0].sparkSession.sparkContext
    for table in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sc._jvm.System.gc()

"""Intermediate tables in the folder that driver and executors share.

A staged table cuts the lineage: when an executor is lost, a later stage reads
the files again instead of recomputing everything before them. The folder is
``spark.checkpoint.dir`` of the session. Only a local master, where driver and
executors are one process, falls back to a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor and the driver can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    app = spark.sparkContext.applicationId  # the setting itself cannot be changed in a running session
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="docspark-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docspark-staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in dfs:
        spark = df.sparkSession
        if files := df.inputFiles():
            delete(spark, files[0].rsplit("/", 1)[0])


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

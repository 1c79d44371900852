"""A latest-wins table in buckets: batches rewrite the buckets they touch, and one manifest says which files count.

    <path>/files/<batch>/__bucket=<b>    rows of a bucket after a batch
    <path>/manifest/<batch>              JSON: the batch's number and the folder of each bucket

A reader takes the newest manifest and the files it names, so it sees a batch whole or not at all. A batch
that is given again (after a failure, with the same number) finds its manifest written and changes nothing; one that
failed before its manifest leaves files that no manifest names, which are overwritten. Manifests and files that are
older than the last ``keep`` batches are removed, so a reader between two batches keeps its files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark.plans.staging import delete
from docspark.streaming.state import latest_wins


def _list(spark: SparkSession, folder: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that a manifest is there whole or not at all."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent().getParent(), f"_writing-{target.getName()}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, target):
        raise OSError(f"could not write {path}")


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())  # one short file


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: batch (-1 before the first) and files by bucket."""
    names = _list(spark, f"{path}/manifest")
    return json.loads(_read_text(spark, f"{path}/manifest/{names[-1]}")) if names else {"batch": -1, "files": {}}


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    files = list(manifest(spark, path)["files"].values())
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, path: str, key: list[str], order: list[str], number: int, buckets: int = 64, keep: int = 2) -> bool:
    """Fold a batch into the table; False if it has been before. Only buckets with a key of the batch are read and written."""
    spark = batch.sparkSession
    held = manifest(spark, path)
    if number <= held["batch"]:
        return False
    own = batch.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    newest = latest_wins(own, ["__bucket", *key], order).persist()
    try:
        touched = [r[0] for r in newest.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = [f"{path}/{held['files'][str(b)]}" for b in touched if str(b) in held["files"]]
        both = newest.select("__bucket", *batch.columns)
        if old:
            before = spark.read.schema(batch.schema).parquet(*old).withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
            both = latest_wins(both.unionByName(before), ["__bucket", *key], order).select("__bucket", *batch.columns)
        folder = f"files/{number:012d}"
        if touched:
            both.repartition("__bucket").sortWithinPartitions("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/{folder}")
    finally:
        newest.unpersist()
    files = held["files"] | {str(b): f"{folder}/__bucket={b}" for b in touched}
    _write_text(spark, f"{path}/manifest/{number:012d}", json.dumps({"batch": number, "files": files}))
    _tidy(spark, path, keep)
    return True


def _tidy(spark: SparkSession, path: str, keep: int) -> None:
    names = _list(spark, f"{path}/manifest")
    named = {f for n in names[-keep:] for f in json.loads(_read_text(spark, f"{path}/manifest/{n}"))["files"].values()}
    for n in names[:-keep]:
        delete(spark, f"{path}/manifest/{n}")
    for batch in _list(spark, f"{path}/files"):
        if batch <= names[-1]:
            for bucket in _list(spark, f"{path}/files/{batch}"):
                if bucket.startswith("__bucket=") and f"files/{batch}/{bucket}" not in named:
                    delete(spark, f"{path}/files/{batch}/{bucket}")


def upsert_batches(path: str, key: list[str], order: list[str], buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of ``upsert``."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, path, key, order, number, buckets, keep)

    return write

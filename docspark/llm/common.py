"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract of this subpackage: ASCII white space only.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of other characters than ASCII white space."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def salted(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """Equi-join of many left rows with unique-key right rows, with every key dealt over ``salts`` tasks.

    The right side must hold one row a key; it is repeated ``salts`` times, so a
    key that a third of the left rows share is spread without copying those rows.
    ``by``: the left columns whose hash deals them, all by default. Null keys match each other.
    """
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*(by or left.columns)), F.lit(salts)).cast("int"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    names = {k: f"__r_{k}" for k in on}
    right = right.withColumnsRenamed(names)
    cond = left["__salt"] == right["__salt"]
    for k in on:
        cond = cond & left[k].eqNullSafe(right[names[k]])
    return left.join(right, cond, how).drop(*names.values()).drop("__salt")

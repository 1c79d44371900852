"""Recorded answers of remote services as a Python data source, for batch and stream reads.

A folder holds one file an answer, as it came: a page as JSON, a search result, or a body of server-sent
events. Files are named by the number that was asked for. The source gives the rows

    name, number, body, error

in partitions of consecutive files, so a folder of any size is read by many tasks; as a stream its offsets are numbers, and
each micro-batch takes what is newer. A file that cannot be read is a row with its error. Which numbers are missing
between the first and the last is told by ``gaps``. Nothing here asks a network.

Files are opened by path in the tasks, so the folder must be one that all executors see (``spark.read.text`` with
``wholetext`` serves stores that only Spark reads; ``from_text`` gives the same rows from it).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docspark.operators.scan import in_order, running

SCHEMA = "name string, number long, body string, error string"
_NUMBER = re.compile(r"(\d+)(?=\.[^.]*$|$)")


def _number(name: str) -> int | None:
    m = _NUMBER.search(name)
    return int(m[1]) if m else None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _numbered(folder: str) -> list[tuple[int, str]]:
    found = [(_number(e.name), e.name) for e in os.scandir(folder) if e.is_file() and not e.name.startswith((".", "_"))]
    return sorted((n, name) for n, name in found if n is not None)


def _rows(folder: str, names: list[str]) -> Iterator[tuple]:
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                yield name, _number(name), f.read(), None
        except (OSError, UnicodeDecodeError) as e:
            yield name, _number(name), None, f"{type(e).__name__}: {e}"


class _Reader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> list[InputPartition]:
        names = [name for _, name in _numbered(self.folder)]
        return [Files(names[at : at + self.size]) for at in range(0, len(names), self.size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, partition.paths)


class _StreamReader(DataSourceStreamReader):
    """An offset is the greatest number there; answers are recorded in the order of their numbers."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {"number": -1}

    def latestOffset(self) -> dict:
        found = _numbered(self.folder)
        return {"number": found[-1][0] if found else -1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [name for n, name in _numbered(self.folder) if start["number"] < n <= end["number"]]
        return [Files(names[at : at + self.size]) for at in range(0, len(names), self.size)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, partition.paths)

    def commit(self, end: dict) -> None:
        pass


class RecordedAnswers(DataSource):
    """Options: path, perPartition (files, 500)."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("perPartition", 500))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._size())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._size())


def read(spark: SparkSession, path: str, per_partition: int = 500) -> DataFrame:
    spark.dataSource.register(RecordedAnswers)
    return spark.read.format("recorded").option("path", path).option("perPartition", per_partition).load()


def read_stream(spark: SparkSession, path: str, per_partition: int = 500) -> DataFrame:
    spark.dataSource.register(RecordedAnswers)
    return spark.readStream.format("recorded").option("path", path).option("perPartition", per_partition).load()


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """The same rows by Spark's own reader."""
    raw = spark.read.option("wholetext", True).text(path).select("_metadata.file_name", "value")
    number = F.regexp_extract("file_name", "(\\d+)(?=\\.[^.]*$|$)", 1)
    return raw.where(number != "").select(F.col("file_name").alias("name"), number.cast("long").alias("number"), F.col("value").alias("body"), F.lit(None).cast("string").alias("error"))


def gaps(answers: DataFrame) -> DataFrame:
    """(first, last): runs of numbers that are missing, or failed, between the least and the greatest."""
    good = answers.where(F.col("error").isNull() & F.col("body").isNotNull()).select("number").distinct()
    every = answers.agg((F.min("number") - 1).alias("number"), (F.max("number") + 1).alias("after")).where("number is not null")
    edges = good.unionByName(every.select("number")).unionByName(every.select(F.col("after").alias("number"))).distinct()
    told = running(in_order(edges, ["number"], "numbers"), before={"previous": F.col("number")})
    return told.where("number > previous + 1").select((F.col("previous") + 1).alias("first"), (F.col("number") - 1).alias("last"))


def pages(answers: DataFrame, meta: str = "vol string, page int, headings array<string>") -> DataFrame:
    """(pg, text, meta) of recorded pages; ``meta`` may be JSON inside the JSON."""
    parsed = answers.where("body is not null").select("number", F.from_json("body", "text string, meta string").alias("p"))
    return parsed.select(F.col("number").cast("int").alias("pg"), "p.text", F.from_json("p.meta", meta).alias("meta"))


def search_passages(answers: DataFrame) -> DataFrame:
    """(number, rank, id, text) of recorded search results: a JSON-RPC body, plain or as server-sent events, whose result holds texts that are JSON lists of hits."""
    body = F.when(F.col("body").rlike("(?m)^data: ?"), F.array_join(F.regexp_extract_all("body", F.lit("(?m)^data: ?(.*)$"), F.lit(1)), "\n")).otherwise(F.col("body"))
    parsed = answers.where("body is not null").select("number", F.from_json(body, "result struct<content:array<struct<type:string,text:string>>>").alias("r"))
    texts = parsed.select("number", F.explode(F.filter("r.result.content", lambda c: c["type"] == "text")).alias("c"))
    hits = texts.select("number", F.posexplode(F.from_json("c.text", "array<struct<id:string,text:string>>")).alias("rank", "h"))
    return hits.select("number", (F.col("rank") + 1).alias("rank"), "h.id", "h.text")


def books_found(answers: DataFrame) -> DataFrame:
    """(id, name, author, hits) of recorded full-text searches: JSON lists of hits by book."""
    listed = answers.where("body is not null").select(F.explode(F.from_json("body", "array<struct<id:long,name:string,author:string>>")).alias("h"))
    return listed.select("h.*").groupBy("id", "name", "author").agg(F.count(F.lit(1)).alias("hits"))

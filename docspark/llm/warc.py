"""WARC archives: write records, read them back, resolve revisits.

An archive is a gzip file of WARC/1.1 records. Spark's text writer produces it
(a record is one value, the blank lines after it are the line separator), so
task commits, retries after a lost executor and any store that Spark can reach
come for free. Reading inflates each file as a stream, of one gzip member or
many, and walks it by Content-Length, so payloads may hold anything, record
separators and version lines included.

Defined cases
-------------
* A null payload is written as an empty one. An empty payload has a digest and
  a length of zero like any other.
* A record's id is made of its page's id and the row's number in the scan, so records of repeated
  or null page ids have ids of their own, and a revisit refers to one record: of those with the smallest page id the one with the smallest number.
* Rows whose id is null keep a null id; they never are the original of a group
  unless every id of the group is null, and then all of them are responses.
* Rows that share the smallest id of a group (repeated rows) are all responses.
* A null URL is written without WARC-Target-URI; blanks, tabs and line ends in
  a URL are percent-encoded, so a URL cannot forge a header.
* Further input columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import salted, table
from docspark.plans.staging import new_path, stage, unstage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
ID_PREFIX = "urn:x-page:"
RECORDS = "page_id long, record long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_to_record long, payload binary"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits are eight groups of 20 bits, each four base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def originals(headers: DataFrame, min_bytes: int = 0, salts: int = 16) -> DataFrame:
    """(record, refers_to, refers_to_record) of the records that revisit an earlier payload.

    ``headers``: page_id, record, payload_digest, payload_bytes. Only headers are
    shuffled by digest. Digests that occur once drop out in the aggregate; the
    rest meet their rows again dealt over ``salts`` tasks a digest.
    """
    long_enough = headers.where(F.col("payload_bytes") >= min_bytes).select("page_id", "record", "payload_digest")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record")))
    firsts = long_enough.groupBy("payload_digest").agg(first.alias("__f"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __f is not null")
    firsts = firsts.select("payload_digest", F.col("__f.page_id").alias("refers_to"), F.col("__f.record").alias("refers_to_record"))
    met = salted(long_enough, firsts, ["payload_digest"], salts)
    return met.where("page_id is null or page_id <> refers_to").select("record", "refers_to", "refers_to_record")


def records_of(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One record row a page row: a response with its payload or a revisit without one. A row meets its revisit by its own number."""
    return pages.join(revisits, "record", "left")


def _record(date: str) -> Column:
    """The record as a string, without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    urn = lambda page, row: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    url = F.col("url")
    for code in (9, 10, 13, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    body = F.when(revisit, "").otherwise(F.col("payload").cast("string"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id", "record")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to", "refers_to_record")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(CRLF),
        http,
        body,
    )


def file_classes(headers: DataFrame, file_bytes: int = 1 << 28, most_bytes: int = 1 << 30, heavy: int = 1 << 20, most_records: int = 20_000) -> list[tuple[Column, int]]:
    """(condition, records a file) of each class of payloads that occurs: up to ``heavy`` bytes, and larger ones.

    By the class's mean a file holds about ``file_bytes`` of payload, and by its
    largest payload never more than ``most_bytes``, unless one payload is larger.
    """
    is_heavy = F.coalesce(F.col("payload_bytes") > heavy, F.lit(False))
    sizes = headers.groupBy(is_heavy.alias("h")).agg(F.avg("payload_bytes").alias("mean"), F.max("payload_bytes").alias("most")).collect()  # two rows at most
    fits = lambda budget, size: int(budget // max(1, size or 0))
    return [(is_heavy if r["h"] else ~is_heavy, max(1, min(most_records, fits(file_bytes, r["mean"]), fits(most_bytes, r["most"])))) for r in sizes]


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """Write records (page_id, record, url, payload, payload_digest, payload_bytes, refers_to, refers_to_record) as gzip WARC files, adding to those under ``path``."""
    (
        records.select(_record(date).alias("value"))
        .write.mode("append")
        .option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _id(urn: bytes | None) -> tuple[int | None, int | None]:
    """Page id and row number of a record id."""
    if urn is None:
        return None, None
    page, _, row = urn.strip(b"<>").removeprefix(ID_PREFIX.encode()).partition(b":")
    return None if page == b"null" else int(page), int(row) if row else None


def _walk(archive: BinaryIO) -> Iterator[tuple]:
    """Records of one archive, by Content-Length, one record held at a time."""
    while line := archive.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record before byte {archive.tell()}")
        head = [line]
        while (line := archive.readline()) not in (b"\r\n", b""):
            head.append(line)
        f = _fields(b"".join(head))
        size = int(f[b"content-length"])
        block = archive.read(size)
        if len(block) < size or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"record before byte {archive.tell()} is cut or does not end where its length says")
        kind = f[b"warc-type"].decode()
        if kind not in ("response", "revisit"):
            continue
        page, row = _id(f[b"warc-record-id"])
        first, first_row = _id(f.get(b"warc-refers-to"))
        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        said = f[b"warc-payload-digest"].decode().rpartition(":")[2]
        if payload is not None and said != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"payload of {f[b'warc-record-id'].decode()} does not match its digest")
        url = f.get(b"warc-target-uri")
        yield (page, row, url and url.decode(), kind, said, None if payload is None else len(payload), first, first_row, payload)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path``; payload_bytes is null for revisits. Digests are checked."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                part, held = [], 0
                for r in _walk(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)):
                    part.append(r if payloads else (*r[:-1], None))
                    held += len(r[-1] or b"") if payloads else 0
                    if len(part) >= 5000 or held > 1 << 24:
                        yield _frame(part)
                        part, held = [], 0
                if part:
                    yield _frame(part)

    def _frame(part: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(part, columns=names, dtype=object)
        return out.astype(dict.fromkeys(["page_id", "record", "payload_bytes", "refers_to", "refers_to_record"], "Int64"))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, RECORDS)


def resolve_revisits(records: DataFrame, salts: int = 16) -> DataFrame:
    """Fill a revisit's payload_bytes from the response that it refers to.

    The distinct targets of the revisits meet the responses by record; the few rows that
    come out meet the revisits dealt over ``salts`` tasks a target.
    """
    heads = records.drop("payload")
    revisits, responses = heads.where("record_type = 'revisit'"), heads.where("record_type = 'response'")
    at = ["refers_to", "refers_to_record"]
    targets = revisits.select(*at).distinct()
    known = responses.select(F.col("page_id").alias("refers_to"), F.col("record").alias("refers_to_record"), F.col("payload_bytes").alias("__bytes")).join(targets, at, "left_semi")
    met = salted(revisits, known, at, salts, "left").withColumn("payload_bytes", F.col("__bytes")).drop("__bytes")
    return responses.unionByName(met.select(*responses.columns))


def deduplicate(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record a row of ``pages`` (page_id, url, payload; a scan, whose rows keep their numbers when it is read again) with equal payloads reduced to revisits."""
    full = pages.select("page_id", "url", F.monotonically_increasing_id().alias("record"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    full = full.withColumns({"payload_digest": digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    # Headers are staged, so payloads are read twice in all: once for their digests, once to be written (again for those over 1 MB, if any).
    headers = stage(full.select("page_id", "record", "payload_digest", "payload_bytes"), "warc-headers")
    # Staged so that its size is known: a short list is broadcast under Spark's threshold, a long one is joined by row number.
    revisits = stage(originals(headers, min_bytes), "revisits")
    records = records_of(full, revisits)
    classes = file_classes(headers)
    for chosen, most in classes or [(F.lit(True), 1)]:
        write_archives(records.where(chosen) if len(classes) > 1 else records, path, records_per_file=most)
    unstage(headers, revisits)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    deduplicate(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload")), path)
    back = stage(read_archives(spark, path, payloads=False).drop("payload"), "warc-heads")
    return resolve_revisits(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM h),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS dig FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, dig AS payload_digest,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN NULL ELSE first_id END AS refers_to
FROM d
"""

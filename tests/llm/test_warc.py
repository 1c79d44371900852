from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from docspark.llm import warc
from docspark.plans.staging import new_path


def brute(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((x for x in groups[data] if x is not None), default=None)
        is_first = first is None or i == first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if is_first else "revisit", None if is_first else first))
    return sorted(out, key=repr)


def test_round_trip_with_odd_rows(spark, tables):
    rows = [
        (5, "http://a/x y\r\nWARC-Type: forged", "<p>same</p>"),
        (2, None, "<p>same</p>"),
        (9, "http://b", "<p>same</p>"),
        (9, "http://b", "<p>same</p>"),
        (None, "http://c", "<p>same</p>"),
        (3, "http://d", None),
        (4, "http://e", ""),
        (7, "http://f", "a\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nend é 😀"),
        (8, "http://g", "x" * 300_000),
        (None, "http://h", "only null"),
        (None, "http://h", "only null"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as refers_to", "'x' as payload")
    got = warc.op1_warc(spark, tables(pages=pages)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_payloads_and_urls_come_back(spark):
    pages = spark.createDataFrame([(1, "http://a b", bytearray(b"\x00\xff\r\n\r\n")), (2, "http://c", bytearray(b"t"))], "page_id long, url string, payload binary")
    path = new_path(spark, "t")
    warc.deduplicate(pages, path)
    back = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert bytes(back[1]["payload"]) == b"\x00\xff\r\n\r\n" and back[1]["url"] == "http://a%20b"


def test_record_ids_are_unique_and_say_which_record(spark):
    rows = [(9, "u", b"x"), (4, "u", b"x"), (4, "v", b"x"), (None, "u", b"x"), (None, "w", b"y"), (None, "w", b"y"), (9, "z", b"q")]
    pages = spark.createDataFrame([(i, u, bytearray(b)) for i, u, b in rows], "page_id long, url string, payload binary").repartition(3)
    path = new_path(spark, "t")
    warc.deduplicate(pages, path)
    back = warc.read_archives(spark, path).collect()
    assert len({r["record"] for r in back}) == 7
    revisits = [r for r in back if r["record_type"] == "revisit"]
    first = min(r["record"] for r in back if r["page_id"] == 4)
    assert len(revisits) == 2 and {(r["refers_to"], r["refers_to_record"]) for r in revisits} == {(4, first)}
    resolved = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    assert len(resolved) == 7 and {r["payload_bytes"] for r in resolved} == {1}


def test_hot_payload_and_min_bytes(spark, tables):
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'hot', concat('p', id)) as html")
    got = warc.op1_warc(spark, tables(pages=pages)).groupBy("record_type").count().collect()
    assert {r[0]: r[1] for r in got} == {"revisit": 999, "response": 2001}
    headers = spark.createDataFrame([(1, 8, "d", 3), (2, 9, "d", 3)], "page_id long, record long, payload_digest string, payload_bytes long")
    assert warc.originals(headers, min_bytes=4).count() == 0


def test_empty_table(spark, tables):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.op1_warc(spark, tables(pages=pages)).count() == 0


def record(n, body):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + body
    said = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (n, said, len(http)) + http + b"\r\n\r\n"


def test_members_and_cut_archives():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    members = b"".join(map(gzip.compress, (info, record(1, b"a\r\n\r\nWARC/1.1\r\n\r\n"), record(2, b""))))
    walked = list(warc._walk(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(members)))))
    assert [(r[0], r[-1]) for r in walked] == [(1, b"a\r\n\r\nWARC/1.1\r\n\r\n"), (2, b"")]
    assert list(warc._walk(io.BytesIO(b""))) == []
    for cut in (record(1, b"abc")[:-6], record(1, b"abc")[:-2], b"no record", record(1, b"abc").replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            list(warc._walk(io.BytesIO(cut)))


def test_archives_are_bounded_by_bytes(spark):
    sizes = [100] * 6 + [40] * 6 + [5000, 7000]
    pages = spark.createDataFrame([(i, "u", bytearray(bytes([i]) * n)) for i, n in enumerate(sizes)], "page_id long, url string, payload binary").coalesce(1)
    headers = pages.selectExpr("page_id", "cast(octet_length(payload) as long) as payload_bytes")
    light, heavy = sorted(warc.file_classes(headers, file_bytes=300, most_bytes=8000, heavy=1000), key=lambda c: -c[1])
    assert light[1] == 4 and heavy[1] == 1  # 300 bytes at a mean of 70; a heavy payload fills a file
    assert warc.file_classes(headers, file_bytes=10**6, most_bytes=500, heavy=10**4)[0][1] == 1
    assert warc.file_classes(headers.limit(0)) == []
    path = new_path(spark, "t")
    records = pages.withColumns({"payload_digest": warc.digest(pages["payload"]), "payload_bytes": warc.F.octet_length("payload").cast("long"), "refers_to": warc.F.lit(None).cast("long"), "refers_to_record": warc.F.lit(None).cast("long"), "record": warc.F.monotonically_increasing_id()})
    for chosen, most in (light, heavy):
        warc.write_archives(records.where(chosen), path, records_per_file=most)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).count() == 5
    assert sorted((r["page_id"], len(r["payload"])) for r in warc.read_archives(spark, path).collect()) == list(enumerate(sizes))


def test_light_and_heavy_payloads(spark, tables):
    rows = [(1, "u", "x" * (1 << 20) + "y"), (2, "u", "x" * (1 << 20) + "y"), (3, "u", "small"), (4, "u", "small"), (5, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.op1_warc(spark, tables(pages=pages)).collect()), key=repr) == brute(rows)

"""The WARC archive against a brute-force reading, and round trips."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from orderlytics.llm import warc

SCHEMA = "page_id bigint, url string, html string"
BODY = "<p>é😀</p>"
PAGES = [
    (1, "http://a/1", BODY),
    (2, "http://a/2", BODY),
    (9, None, BODY),
    (3, "http://b/", ""),
    (4, "http://b/4", None),
    (5, "http://c/\r\nWARC-Type: evil", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "http://c/6", "ends with\r\n"),
    (7, "http://c/7", "\r\n\r\n"),
    (7, "http://c/7", "\r\n\r\n"),
    (7, "http://c/7", "\r\n\r\n"),
    (None, "http://d/", "no id"),
    (None, "http://d/", "no id"),
    (8, "http://d/8", "long " * 200_000),
    (8, "http://d/0", "long " * 200_000),
]


def written(spark, tmp_path, rows, least=0):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.select("*", *[F.lit("x").alias(n) for n in ("digest", "payload", "first", "n", "record", "header", "file")])
    warc.write_pages(df, f"{tmp_path}/files", least=least)
    return f"{tmp_path}/files"


def brute(rows, least=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for body, ids in groups.items():
        first = max(ids, key=lambda p: (p is not None, p or 0))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids = sorted(ids, key=lambda p: p != first)
        for k, page in enumerate(ids):
            response = not k or len(body) < least
            out.append((page, len(body), digest, *(("response", None) if response else ("revisit", first))))
    return sorted(out, key=str)


def result(found):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in warc.resolved(found).select(*columns).collect()), key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_pages_come_back_through_the_archive(spark, tmp_path, least):
    path = written(spark, tmp_path, PAGES, least)
    archive = warc.Archive.ingest(warc.records(spark, path), f"{tmp_path}/archive")
    assert result(archive.restored()) == brute(PAGES, least)
    if not least:
        stored = archive.payloads().collect()
        assert sorted(bytes(r.payload) for r in stored) == sorted({(p[2] or "").encode() for p in PAGES} - {b""})
        assert {r.record_id for r in archive.restored().select(warc.field("WARC-Record-ID").alias("record_id")).collect()}.__len__() == len(PAGES)


def test_records_are_restored_byte_for_byte(spark, tmp_path):
    path = written(spark, tmp_path, PAGES)
    archive = warc.Archive.ingest(warc.records(spark, path), f"{tmp_path}/archive")
    files = {f"file:{f}": gzip.open(f).read() for f in glob.glob(f"{path}/part-*")}
    made = {f: b"" for f in files}
    for r in archive.restored().orderBy("file", "offset").collect():
        assert len(made[r.file]) == r.offset
        made[r.file] += bytes(r.header) + bytes(r.payload) + b"\r\n\r\n"
    assert made == files
    warc.export(archive.restored(), f"{tmp_path}/again")
    again = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/again/part-*")))
    assert again == b"".join(files[f] for f in sorted(files))


def test_foreign_archive_with_copies_other_types_and_any_bytes(spark, tmp_path):
    def record(kind, block, *lines):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    binary = bytes(range(256)) + b"\r\n\r\n\r"
    parts = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", http + binary, "Content-Type: application/http; msgtype=response", "WARC-Record-ID: <urn:1>"),
        record("response", http + binary, "Content-Type: application/http; msgtype=response", "WARC-Record-ID: <urn:2>"),
        record("resource", binary, "Content-Type: image/png"),
        record("metadata", b"", "Content-Type: text/plain"),
    ]
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # a member for each record
    (folder / "b.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    archive = warc.Archive.ingest(warc.records(spark, str(folder)), f"{tmp_path}/archive")
    rows = archive.restored().orderBy("file", "offset").collect()
    assert [bytes(r.header) + bytes(r.payload) + b"\r\n\r\n" for r in rows] == parts * 2
    assert sorted(bytes(r.payload) for r in archive.payloads().collect()) == sorted([binary, b"software: x\r\n"])


def test_damage_is_found(spark, tmp_path):
    path = written(spark, tmp_path, PAGES[:1])
    archive = warc.Archive.ingest(warc.records(spark, path), f"{tmp_path}/archive")
    bad = archive.payloads().select("digest", F.lit(b"other").alias("payload"))
    bad.write.parquet(f"{tmp_path}/bad/payloads")
    archive.headers().write.parquet(f"{tmp_path}/bad/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.Archive(spark, f"{tmp_path}/bad").restored().collect()
    whole = gzip.open(glob.glob(f"{path}/part-*")[0]).read()
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(whole[:-20]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.records(spark, str(tmp_path / "cut.warc.gz")).collect()


def test_without_pages(spark, tmp_path):
    path = written(spark, tmp_path, [])
    archive = warc.Archive.ingest(warc.records(spark, path), f"{tmp_path}/archive")
    assert result(archive.restored()) == []


def test_most_pages_share_one_payload(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(300)]
    archive = warc.Archive.ingest(warc.records(spark, written(spark, tmp_path, rows)), f"{tmp_path}/archive")
    assert result(archive.restored()) == brute(rows)
    assert archive.payloads().count() == 101

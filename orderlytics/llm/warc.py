"""Content-addressed WARC archive.

`write_pages` writes compressed WARC files, one record per page: a response with
the payload, or a revisit that refers to the response with the same payload.
`records` reads WARC files back, byte for byte. `Archive` keeps what it read in
two tables: each payload once, under its SHA-256, and the exact header bytes of
every record with the digest of its payload. Joining the two gives the original
records again; the join recomputes the digest of every stored payload and fails
on a difference.

Only digests meet in a shuffle when response and revisit are told apart; a
payload moves when its record is rebuilt. Records of one payload may be most of
all records: they are rows of a joined side that Spark can split.

A NULL payload is empty, a NULL page id is the smallest, a NULL url has no
target line; line breaks in a url are percent-encoded. Among equal payloads of
at least `least` bytes the row with the largest (page id, url) is the response;
of rows that repeat it one is, the others revisit it. Other columns, whatever
their names, are not read. No pages: no records.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.session import cut_lineage

LINE, GAP = "\r\n", "\r\n\r\n"
#: Fixed values of RFC 4648: the digits of base 32, and those of the usual base-32 numbers.
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PAGE_FIELD = "Page-ID"
OUT_BYTES = 4 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times 40 bits are four times eight digits."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _uuid(*parts: Column) -> Column:
    """A record id that a repeated task gives again."""
    named = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(named, a, n) for a, n in cuts]), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE))


def _headers(kind: str, date: str) -> Column:
    """WARC header and HTTP head of a record, from page_id, url, payload_digest, n_bytes, record_id (and refers_to)."""
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"),
        _line("Content-Length", F.col("n_bytes")),
        F.lit(LINE),
    )
    size = F.octet_length(head) + (F.col("n_bytes") if kind == "response" else F.lit(0))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit(f"WARC/1.1{LINE}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", date),
        F.coalesce(_line("WARC-Target-URI", target), F.lit("")),
        F.coalesce(_line(PAGE_FIELD, F.col("page_id")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
    ]
    if kind == "revisit":
        lines += [_line("WARC-Profile", REVISIT_PROFILE), _line("WARC-Refers-To", F.col("refers_to"))]
    lines += [_line("Content-Type", "application/http;msgtype=response"), _line("Content-Length", size), F.lit(LINE), head]
    return F.concat(*lines)


def write_pages(
    pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = DATE
) -> None:
    """Write one record per row as gzip-compressed WARC files."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    addressed = rows.select(
        "page_id",
        "url",
        F.sha2("payload", 256).alias("digest"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        "payload",
    )
    name = ["page_id", "url", "digest", "payload_digest", "n_bytes"]
    counts = cut_lineage(addressed.groupBy(*name).agg(F.count(F.lit(1)).alias("n")), "addresses")
    repeated = (
        counts.where(F.col("n_bytes") >= least)
        .groupBy("digest")
        .agg(F.sum("n").alias("copies"), F.max(F.struct("page_id", "url")).alias("first"))
        .where("copies > 1")
    )
    # Known in size before the next join, so that few of them are broadcast and no payload is shuffled.
    repeated = cut_lineage(repeated, "repeated-payloads")
    first = (F.col("page_id").eqNullSafe(F.col("first.page_id"))) & (F.col("url").eqNullSafe(F.col("first.url")))
    aside = counts.join(repeated, "digest").select(*name, "n", "first", first.alias("is_first"))
    aside = cut_lineage(aside.where("n > 1 OR NOT is_first"), "revisits")

    own_id = lambda copy: _uuid(F.lit("page"), F.col("page_id"), F.col("url"), F.col("digest"), copy)
    first_id = _uuid(F.lit("page"), F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(0))
    same = [addressed[c].eqNullSafe(aside[c]) for c in ("page_id", "url", "digest")]
    alone = addressed.join(aside, same, "left_anti")
    once = (
        addressed.join(aside.where("is_first"), same, "left_semi")
        .groupBy(*name)
        .agg(F.first("payload").alias("payload"))
    )
    responses = alone.select(*name, "payload").unionByName(once)
    if least > 0:  # smaller payloads may repeat; each is a response of its own
        responses = responses.withColumn(
            "record_id", F.when(F.col("n_bytes") >= least, own_id(F.lit(0))).otherwise(own_id(F.expr("uuid()")))
        )
    else:
        responses = responses.withColumn("record_id", own_id(F.lit(0)))
    copies = F.explode(F.sequence(F.when(F.col("is_first"), 1).otherwise(0), F.col("n").cast("int") - 1))
    revisits = (
        aside.where("n > 1 OR NOT is_first")
        .select(*name, "first", copies.alias("copy"))
        .select(*name, own_id(F.col("copy") + 1).alias("record_id"), first_id.alias("refers_to"))
    )
    records = responses.select(F.concat(_headers("response", date), F.col("payload").cast("string")).alias("record"))
    records = records.unionByName(revisits.select(_headers("revisit", date).alias("record")))
    # The end of a record is the end of a line to Spark's writer.
    records.write.option("lineSep", GAP).option("compression", "gzip").text(path)


# --- reading


def _header_end(data: bytearray, kind_end: int) -> int:
    """Where the exact header ends: behind the HTTP head of a block that has one."""
    lines = bytes(data[:kind_end]).lower()
    if b"\r\ncontent-type: application/http" not in lines:
        return kind_end
    at = data.find(b"\r\n\r\n", kind_end)
    return kind_end if at < 0 else at + 4


def _block_size(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise ValueError(f"a WARC record without Content-Length: {head[:80]!r}")


_RECORD = "file string, offset bigint, header binary, payload binary"


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the pieces of a file between blank lines; holds one record at a time."""
    file, data, offset, need, out, size = None, bytearray(), 0, None, [], 0
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in _RECORD.split(", ")]
        )

    def end_of(name: str | None) -> None:
        if data.strip(b"\r\n"):
            raise ValueError(f"{name} ends within a record")

    for batch in batches:
        for piece, name in zip(batch.column(0), batch.column(1).to_pylist()):
            if name != file:
                end_of(file)
                file, data, offset, need = name, bytearray(), 0, None
            data += piece.as_buffer()
            data += b"\r\n\r\n"
            while True:
                if need is None:  # (end of the WARC header, end of the block)
                    at = data.find(b"\r\n\r\n")
                    if at <= 0:
                        break
                    need = at + 4, at + 4 + _block_size(bytes(data[:at]))
                if len(data) < need[1] + 4:
                    break
                kind_end, end = need
                cut = min(_header_end(data, kind_end), end)
                out.append((file, offset, bytes(data[:cut]), bytes(data[cut:end])))
                size += end
                offset, need = offset + end + 4, None
                del data[: end + 4]
                if size >= OUT_BYTES:
                    yield flush()
                    out.clear()
                    size = 0
    end_of(file)
    if out:
        yield flush()


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip-compressed WARC files: file, offset in the uncompressed file, header, payload.

    A compressed file is read by one task as a stream. (Spark would split plain
    files between records it cannot tell from payloads.)
    """
    pieces = spark.read.option("lineSep", GAP).text(path)
    return pieces.select(F.col("value").cast("binary"), "_metadata.file_path").mapInArrow(_parsed, _RECORD)


# --- the archive


@dataclass(frozen=True)
class Archive:
    """Two tables in a folder: `headers` (file, offset, header, digest, n_bytes) and `payloads` (digest, payload)."""

    spark: SparkSession
    folder: str

    @classmethod
    def ingest(cls, found: DataFrame, folder: str) -> Archive:
        """Keep records: headers as they are, every payload once."""
        archive = cls(found.sparkSession, folder)
        digest = F.sha2("payload", 256)
        size = F.octet_length("payload").cast("bigint")
        headers = found.select("file", "offset", "header", digest.alias("digest"), size.alias("n_bytes"))
        headers.write.option("compression", "zstd").parquet(f"{folder}/headers")
        full = archive.headers().where("n_bytes > 0")
        again = full.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "offset")).alias("kept"))
        again = cut_lineage(again.where("n > 1"), "payload-copies")
        later = full.join(again, "digest").where(F.struct("file", "offset") != F.col("kept")).select("file", "offset")
        later = cut_lineage(later, "later-copies")
        kept = found.where(size > 0).join(later, ["file", "offset"], "left_anti")
        kept.select(digest.alias("digest"), "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
        return archive

    def headers(self) -> DataFrame:
        schema = "file string, offset bigint, header binary, digest string, n_bytes bigint"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/headers")

    def payloads(self) -> DataFrame:
        """The stored payloads; reading one whose bytes do not have its digest fails."""
        rows = self.spark.read.schema("digest string, payload binary").parquet(f"{self.folder}/payloads")
        sound = F.sha2("payload", 256) == F.col("digest")
        broken = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
        return rows.select("digest", F.when(sound, F.col("payload")).otherwise(broken.cast("binary")).alias("payload"))

    def restored(self) -> DataFrame:
        """The original records: file, offset, header, payload."""
        return (
            self.headers()
            .join(self.payloads(), "digest", "left")
            .select("file", "offset", "header", F.coalesce("payload", F.lit(b"")).alias("payload"))
        )


def export(found: DataFrame, path: str) -> None:
    """Write records as WARC files again, those of one file together and in their order."""
    rows = found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    rows.select(F.concat("header", "payload").cast("string")).write.option("lineSep", GAP).option(
        "compression", "gzip"
    ).text(path)


def field(name: str) -> Column:
    """A field of the exact header; NULL where it has none."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?i)\r\n{name}: *([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def resolved(found: DataFrame) -> DataFrame:
    """One row per response and revisit; what a revisit refers to supplies its payload's size and digest."""
    own = found.select(
        field(PAGE_FIELD).cast("bigint").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("target"),
        F.octet_length("payload").cast("bigint").alias("own_bytes"),
        base32_sha1(F.col("payload")).alias("own_digest"),
    )
    own = cut_lineage(own, "resolved")
    full = own.where("record_type = 'response'").select(
        F.col("record_id").alias("target"),
        F.col("page_id").alias("refers_to"),
        F.col("own_bytes").alias("full_bytes"),
        F.col("own_digest").alias("full_digest"),
    )
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = own.where("record_type = 'response'").select(
        "*",
        F.col("own_bytes").alias("payload_bytes"),
        F.col("own_digest").alias("payload_digest"),
        F.lit(None).cast("bigint").alias("refers_to"),
    )
    revisits = (
        own.where("record_type = 'revisit'")
        .join(full, "target", "left")
        .withColumnsRenamed({"full_bytes": "payload_bytes", "full_digest": "payload_digest"})
    )
    return responses.select(*columns).unionByName(revisits.select(*columns))

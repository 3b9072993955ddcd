"""WARC archives with revisit resolution.

Only headers (payload digest, id) are shuffled by digest, pre-aggregated map-side, to find the original of each
group of equal payloads; they are digested once and stored. Later captures become `revisit` records that name the original and carry no payload.
Payloads move once, by page id, to meet that decision. Archives are written by Spark's own writer (its commit
protocol survives lost executors): a WARC record ends in CRLF CRLF, which is given as the line separator.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm.common import BASE32, let, shared_path, stored

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CUT = b"\r\n\r\n"
READ_SCHEMA = "page_id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text in UTF-8: 10 hexadecimal digits are 8 digits to the base 32."""
    digits = lambda h: F.concat(*[F.lpad(F.conv(F.substring(h, a, 10), 16, 32), 8, "0") for a in (1, 11, 21, 31)])
    return F.translate(let(F.sha1(payload), digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def revisit_plan(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of headers (page_id, payload_digest, payload_bytes): the records that revisit an earlier one, as
    `page_id, payload_digest, refers_to`. The smallest page_id of a digest stays; equal rows are taken once.

    The originals, one row per repeated digest, are written before they meet their revisits, so that both sides of the
    join are shuffles of their own and Spark can split a digest that most pages share."""
    large = headers.filter(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = large.select("page_id", "payload_digest").join(stored(first, "originals"), "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return later.select("page_id", "payload_digest", "refers_to").distinct()


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", records_per_file: int = 10_000) -> None:
    """Write one record per row of `pages` (page_id, url, html) to gzip archives below `path`.

    NULL html is the empty payload, a NULL url becomes `urn:page:<id>`, control characters of a url are dropped.
    Repeated rows give repeated records; a row without page_id never is an original unless no equal row has an id.
    An archive holds `records_per_file` records at most; readers take it as a stream, so its bytes need no bound.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("_body")).withColumns({"payload_digest": base32_sha1(F.col("_body")), "payload_bytes": F.octet_length("_body").cast("long")})
    plan = revisit_plan(stored(p.select("page_id", "payload_digest", "payload_bytes"), "headers"), min_bytes)
    plan = plan.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
    d = p.join(plan, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    again = F.col("_id").isNotNull() | (F.col("_digest").isNotNull())
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", ""), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("_body")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        F.when(again & F.col("refers_to").isNotNull(), line("X-Refers-To-Page", F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    record = F.concat(head, F.lit("\r\n"), block)
    d.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


class RecordStream:
    """Rows of READ_SCHEMA from an archive that comes in pieces; a payload that misses its digest raises."""

    def __init__(self, name: str | None):
        self.name, self.buffer, self.need = name, bytearray(), 0

    def feed(self, piece) -> Iterator[tuple]:
        self.buffer += piece
        while len(self.buffer) >= self.need and (end := self.buffer.find(CUT)) >= 0:
            head = dict(x.split(": ", 1) for x in self.buffer[:end].decode("utf-8").split("\r\n")[1:])
            if "Content-Length" not in head:
                return
            size = int(head["Content-Length"])
            self.need = end + 8 + size
            if len(self.buffer) < self.need:
                return
            yield self._row(head, bytes(self.buffer[end + 4 : end + 4 + size]))
            del self.buffer[: self.need]
            self.need = 0

    def _row(self, head: dict[str, str], block: bytes) -> tuple:
        digest, kind, body = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], None
        if kind == "response":
            body = block[block.index(CUT) + 4 :]
            if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(head["X-Payload-Length"]):
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        number = lambda k: int(head[k]) if k in head else None
        return number("X-Page"), head["WARC-Target-URI"], kind, number("X-Refers-To-Page"), digest, int(head["X-Payload-Length"]), body

    def close(self) -> None:
        if self.buffer.strip(b"\r\n"):
            raise ValueError(f"{self.name} ends inside a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives below `path`; every payload is checked against its digest.

    An archive is unpacked as a stream of the stretches between blank lines, put together record by record: a task
    holds one record and one batch of stretches, however large the archive."""
    cols = READ_SCHEMA if payloads else READ_SCHEMA.rpartition(",")[0]
    names = [c.split()[0] for c in cols.split(", ")]
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def rows(batches):
        stream, found, held = RecordStream(None), [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        for b in batches:
            for piece, name in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist()):
                if name != stream.name:
                    stream.close()
                    stream = RecordStream(name)
                for r in stream.feed(piece.as_py() + CUT):
                    found.append(r[: len(names)])
                    held += len(r[6] or b"") if payloads else 0
                if len(found) >= 2000 or held > 1 << 26:
                    yield batch()
                    found, held = [], 0
        stream.close()
        if found:
            yield batch()

    stretches = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "*.gz").text(path)
    return stretches.select("value", "_metadata.file_name").mapInArrow(rows, cols)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write `pages` to archives in the shared folder and return what reading them back gives, without payloads."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path, payloads=False)


SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, sha1(body) as hx from p),
b as (select page_id, payload_bytes, list_aggregate(list_transform(generate_series(0, 31), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hx, cast(1 + 5 * (k // 4) as int), 5))::bigint >> cast(15 - 5 * (k % 4) as int)) & 31)::int, 1)), 'string_agg', '') as payload_digest from h),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from b)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to from f
"""

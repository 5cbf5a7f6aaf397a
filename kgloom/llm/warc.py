"""Operator 11: WARC archives by way of a chunked record table.

A payload becomes rows ``page_id, chunk`` of at most ``CHUNK_BYTES`` bytes, each with the SHA-1 of the payload as far as it
goes, so that the last row's is the whole payload's and no Python worker, writer or reader ever holds more than a chunk.
A row is written as one WARC record: the first chunk as ``response`` behind its HTTP header, the others as
``continuation`` with their segment number. Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest page_id is the response; the others are ``revisit`` records without payload that refer to it.

Archives are gzip files that Spark's text writer commits, a record a line of line separator CRLF CRLF, so any store that
Spark reads will do and a lost executor leaves no half-written file. The reader takes the same lines as a stream: it counts
each block by its Content-Length, whatever separators the payload holds, checks segment order, length and digest, and
raises on damage. Payload bytes of a revisit are its header's.

Nulls: null html is an empty payload, a null url gives no target URI, a null page_id sorts before all others. Repeated rows
give a record each; where several have the group's largest page_id, all of these are responses. Empty tables give no record.
Extra columns are ignored. The input's own row is read whole by the scan, as its table stores it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import arrow_schema, forget, stored, work_dir

CHUNK_BYTES = 1 << 16
#: Groups of equal payloads that are looked up by broadcast: 28 bytes each and their overhead, a few MB. Beyond, rows meet by shuffle.
BROADCAST_GROUPS = 50_000
#: Groups with more than this part of all rows never shuffle; there are fewer of them than this.
HOT = 1000
_SEP = b"\r\n\r\n"
_ID, _PROFILE = "urn:x-page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _own(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return own.withColumn("digest", F.unhex(F.sha1("payload")))


def shared_payloads(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``digest, first, n`` of payloads that several rows have; ``first`` is the page_id that keeps the payload."""
    long = records.where(F.octet_length("payload") >= min_bytes)
    return long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")


def typed(records: DataFrame, shared: DataFrame, min_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each row is recorded as; responses have no ``refers_to``."""
    if shared.count() <= broadcast_groups:
        joined = records.join(F.broadcast(shared.select("digest", "first")), "digest", "left")
    else:
        total = records.count()
        hot = shared.where(F.col("n") * HOT > total).select("digest", "first")
        rest = shared.where(F.col("n") * HOT <= total).select("digest", "first")
        joined = records.join(F.broadcast(hot), "digest").unionByName(records.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest", "left"))
    first = F.when(F.octet_length("payload") >= min_bytes, F.col("first"))
    older = F.col("page_id").isNull() | (F.col("page_id") < first)
    return joined.select("page_id", "url", "payload", "digest", F.when(first.isNotNull() & older, first).alias("refers_to"))


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``page_id, url, refers_to, payload_bytes, payload_digest, chunk, chunks, data, digest_so_far`` of ``typed`` rows.

    Revisits have one row without data. Chunks of a record follow each other in one task, which carries the digest on.
    """
    length = F.octet_length("payload")
    parts = F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(length / chunk_bytes))).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    rows = records.withColumn("chunks", parts).select("*", at)
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    rows = rows.select("page_id", "url", "refers_to", length.cast("long").alias("payload_bytes"), "digest", "chunk", "chunks", data.alias("data"))
    schema = "page_id long, url string, refers_to long, payload_bytes long, payload_digest string, chunk int, chunks int, data binary, digest_so_far string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha1()
        for b in batches:
            whole, so_far = [], []
            for want, chunk, chunks, data, older in zip(*(b.column(c).to_pylist() for c in ("digest", "chunk", "chunks", "data", "refers_to")), strict=True):
                if chunk == 0:
                    state = hashlib.sha1()
                state.update(data)
                now = want if older is not None else state.digest()
                if chunk == chunks - 1 and now != want:
                    raise ValueError("chunks of a payload are out of order")
                whole.append(_base32(want))
                so_far.append(_base32(now))
            cols = {n: b.column(n) for n in b.schema.names} | {"payload_digest": pa.array(whole, pa.string()), "digest_so_far": pa.array(so_far, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _name(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit("null"))


def warc_lines(chunks: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``value``: each ``chunked`` row as a WARC/1.1 record without the separator behind it."""
    first, revisit, many = F.col("chunk") == 0, F.col("refers_to").isNotNull(), F.col("chunks") > 1
    page = _name(F.col("page_id"))
    http = _text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("payload_bytes").cast("string"), "\r\n\r\n")
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    none = F.lit("")
    head = _text(
        "WARC/1.1\r\nWARC-Type: ", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response"),
        f"\r\nWARC-Record-ID: <{_ID}", page, F.when(first, none).otherwise(_text(":", (F.col("chunk") + 1).cast("string"))), f">\r\nWARC-Date: {date}\r\n",
        F.when(first & uri.isNotNull(), _text("WARC-Target-URI: ", uri, "\r\n")).otherwise(none),
        F.when(first, _text("WARC-Payload-Digest: sha1:", F.col("payload_digest"), "\r\nX-Payload-Length: ", F.col("payload_bytes").cast("string"), "\r\nContent-Type: application/http;msgtype=response\r\n")).otherwise(none),
        F.when(revisit, _text(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <{_ID}", _name(F.col("refers_to")), ">\r\n")).otherwise(none),
        F.when(many, _text("WARC-Segment-Number: ", (F.col("chunk") + 1).cast("string"), "\r\nX-Digest-So-Far: sha1:", F.col("digest_so_far"), "\r\n")).otherwise(none),
        F.when(~first, _text(f"WARC-Segment-Origin-ID: <{_ID}", page, ">\r\n")).otherwise(none),
        F.when(many & (F.col("chunk") == F.col("chunks") - 1), _text("WARC-Segment-Total-Length: ", (F.octet_length(http) + F.col("payload_bytes")).cast("string"), "\r\n")).otherwise(none),
        "Content-Length: ", (F.octet_length("data") + F.when(first, F.octet_length(http)).otherwise(0)).cast("string"), "\r\n\r\n", F.when(first, http).otherwise(none),
    )
    return chunks.select(F.concat(head.cast("binary"), F.col("data")).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, broadcast_groups: int = BROADCAST_GROUPS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A gzipped WARC file for each task's records."""
    records = _own(pages, id_col, url_col, html_col)
    shared = stored(shared_payloads(records, min_bytes), "payloads")
    lines = warc_lines(chunked(typed(records, shared, min_bytes, broadcast_groups), chunk_bytes))
    lines.write.option("lineSep", _SEP.decode()).option("compression", "gzip").text(path)
    forget(shared)


class _Parser:
    """Records from pieces of a stream that was cut at each CRLF CRLF."""

    def __init__(self, with_data: bool):
        self.with_data, self.left, self.origin = with_data, 0, None
        self.http, self.data, self.head = b"", [], {}

    def feed(self, piece: bytes) -> Iterator[dict]:
        if self.left:
            data = piece + _SEP
            take = data[: self.left]
            self.left -= len(take)
            self._body(take)
        else:
            text = piece.lstrip(b"\r\n")
            if not text:
                return
            self._open(text)
        if not self.left:
            yield from self._close()

    def _open(self, text: bytes) -> None:
        lines = text.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one should begin: {lines[0][:60]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        if not {"WARC-Type", "WARC-Record-ID", "Content-Length"} <= head.keys():
            raise ValueError(f"damaged header: {text[:200]!r}")
        number = int(head.get("WARC-Segment-Number", 1))
        if head["WARC-Type"] != "continuation":
            self.done()
        self.head, self.left, self.data = head, int(head["Content-Length"]), []
        if head["WARC-Type"] != "continuation":
            self.origin, self.number, self.sha, self.size, self.http = self.head, 1, hashlib.sha1(), 0, b""
            self.in_http = self.head.get("Content-Type", "").startswith("application/http")
        elif self.origin is None or self.head["WARC-Segment-Origin-ID"] != self.origin["WARC-Record-ID"] or number != self.number + 1:
            raise ValueError(f"segment out of order: {self.head['WARC-Record-ID']}")
        else:
            self.number = number

    def _body(self, data: bytes) -> None:
        if self.in_http:
            self.http += data
            head, sep, rest = self.http.partition(_SEP)
            if not sep:
                return
            self.in_http, data = False, rest
        self.sha.update(data)
        self.size += len(data)
        if self.with_data and data:
            self.data.append(data)

    def _close(self) -> Iterator[dict]:
        o, revisit = self.origin, self.origin["WARC-Type"] == "revisit"
        last = "WARC-Segment-Number" not in o or "WARC-Segment-Total-Length" in self.head
        own = o["WARC-Payload-Digest"].removeprefix("sha1:")
        now = own if revisit else _base32(self.sha.digest())
        length = int(o["X-Payload-Length"])
        if "X-Digest-So-Far" in self.head and self.head["X-Digest-So-Far"] != f"sha1:{now}" or last and (now != own or not revisit and self.size != length):
            raise ValueError(f"damaged payload: {self.head['WARC-Record-ID']}")
        if self.with_data or last:
            yield {
                "page_id": _page(o["WARC-Record-ID"]), "url": o.get("WARC-Target-URI"), "record_type": o["WARC-Type"], "refers_to": _page(o.get("WARC-Refers-To")),
                "chunk": self.number - 1, "last": last, "data": b"".join(self.data), "payload_bytes": length if revisit else self.size, "payload_digest": now,
            }
        if last:
            self.origin = None

    def done(self) -> None:
        if self.left or self.origin is not None:
            raise ValueError(f"record without its end: {self.head['WARC-Record-ID']}")


def _page(record_id: str | None) -> int | None:
    text = (record_id or "null").strip("<>").removeprefix(_ID)
    return None if text == "null" else int(text)


def _read(spark: SparkSession, path: str, with_data: bool, schema: str) -> DataFrame:
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(with_data)
        for b in batches:
            held, size = [], 0
            for piece in b.column(0).to_pylist():
                for row in parser.feed(piece):
                    held.append(row)
                    size += len(row["data"])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
        parser.done()

    lines = spark.read.schema("value string").option("lineSep", _SEP.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record, checked while it streams by."""
    return _read(spark, path, False, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: ``payload_bytes`` and ``payload_digest`` are those up to and with the chunk."""
    return _read(spark, path, True, "page_id long, chunk int, last boolean, data binary, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_dir(spark: SparkSession) -> str:
    return work_dir(spark, "archives")


#: Base32 of SHA-1's 40 hexadecimal digits: five digits are 20 bits, four characters.
ORACLE_SQL = """
with payloads as (select page_id, encode(coalesce(html, '')) as payload from pages
), digests as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h from payloads
), based as (
  select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast(('0x' || substr(h, 5 * (i // 4) + 1, 5)) as bigint) >> (5 * (3 - i % 4))) & 31), 1)), 'string_agg', '') as payload_digest
  from digests
), grouped as (select *, max(page_id) over (partition by payload_digest) as first from based)
select page_id, payload_bytes, payload_digest, case when page_id < first then 'revisit' else 'response' end as record_type,
       case when page_id < first then first end as refers_to
from grouped
"""

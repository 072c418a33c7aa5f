"""WARC archives with revisit resolution.

Writing: headers (payload digest, id, place), never payloads, are shuffled by digest; each digest's first record is its
response, the others are joined to it as revisits. Revisit records have no payload, so they are made from headers alone.
Response records are the rows that are no revisit: most are told by a bitmap of the revisits' places, of a fixed size at most,
and written as they are read; the others meet the revisits in a join. Records are lines of Spark's text writer with the
separator that ends a WARC record, so the archives go wherever Spark writes.

Reading: parts split at the same separator are put together again by Content-Length, so a payload may hold anything.
Revisits are joined to the responses that they refer to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm.common import discard, materialise, without

# Fixed values of the format.
END = "\r\n\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 or of a binary: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _HEX32, _BASE32)


def record_id(place: Column, page_id: Column) -> Column:
    """The same for each run over the same table: from the row's id and its place in the table."""
    h = F.md5(F.concat_ws(":", F.lit("record"), F.coalesce(page_id.cast("string"), F.lit("null")), place["file"], place["row"].cast("string")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks inside a value would end it and become spaces."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), F.translate(value, "\r\n", "  ")), F.lit(""))


def placed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(place, page_id, url, html, digest, bytes) of each row; place is the row's file and number in it, the same in every scan."""
    of = pages.metadataColumn("_metadata")  # also where the table has a column of that name
    place = F.struct(of["file_path"].alias("file"), of["row_index"].alias("row"))
    rows = pages.select(place.alias("place"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))


def revisits_among(heads: DataFrame, min_bytes: int) -> DataFrame:
    """Of headers (place, page_id, url, digest, bytes) those that revisit another one, with its first_place and first_id.

    Of headers with equal digests and min_bytes or more the one with the smallest id is the response (null ids come last, ties
    go to the earlier row); all others are responses.
    """
    long = heads.where(F.col("bytes") >= min_bytes)
    head = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "place")
    first = long.groupBy("digest").agg(F.min(head).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", F.col("f.place").alias("first_place"), F.col("f.page_id").alias("first_id"))
    return long.join(first, "digest").where("place != first_place")


def _record(*parts: tuple[str, Column], block: Column | None = None) -> Column:
    block = F.lit("") if block is None else block
    return F.concat(F.lit(VERSION), *[_line(k, v) for k, v in parts], _line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block).alias("value")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row of pages, a frame over Parquet files, as WARC files below `path`, with fresh headers, and one warcinfo record; see revisits_among() for what becomes a revisit.

    A null html is an empty payload; a null url gives a record without WARC-Target-URI; a null id one without X-Page-Id. An
    empty table gives the warcinfo record only. Other columns are not written. Each file is one gzip stream.
    """
    rows = placed(pages, id_col, url_col, html_col)
    heads = materialise(rows.drop("html"), "heads")
    revisits = materialise(revisits_among(heads, min_bytes), "revisits")
    own, of = record_id(F.col("place"), F.col("page_id")), record_id(F.col("first_place"), F.col("first_id"))
    both = [
        ("WARC-Record-ID", own),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("X-Page-Id", F.col("page_id").cast("string")),
    ]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END), "html")
    full = without(rows, revisits, ("place",)).select(_record(("WARC-Type", F.lit("response")), *both, ("Content-Type", F.lit("application/http; msgtype=response")), block=http))
    again = revisits.select(_record(("WARC-Type", F.lit("revisit")), *both, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", of)))
    one = pages.sparkSession.range(1)
    info = one.select(_record(("WARC-Type", F.lit("warcinfo")), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/warc-fields")), block=F.lit("format: WARC File Format 1.1\r\n")))
    info.unionByName(full).unionByName(again).write.option("lineSep", END).option("compression", "gzip").text(path)
    discard(heads, revisits)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of gzip files below `path` as (record_id, record_type, url, page_id, refers_to, stated_digest, payload, bytes, digest); the last two from the payload itself, that of an HTTP response being its body.

    Without payloads that column is null: they are hashed where they are read, and stay there. A file is read by one task from
    its start, part by part; nothing but one record is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file = None, None
        for batch in batches:
            out: list[tuple] = []
            for part, source in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if source != file:
                    if stream is not None:
                        out += stream.close()
                    stream, file = _Stream(source, payloads), source
                out += stream.feed(part)
            yield _records(out)
        if stream is not None:
            yield _records(stream.close())

    parts = spark.read.option("lineSep", END).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parts.mapInArrow(run, "record_id string, record_type string, url string, page_id long, refers_to string, stated_digest string, payload string, bytes long, digest string")


class _Stream:
    """The records of one file, given part by part; parts were split at END wherever it stood, also across a payload's end."""

    def __init__(self, file: str, payloads: bool = True):
        self.file, self.payloads, self.held, self.head, self.begun = file, payloads, bytearray(), None, False

    def feed(self, part: str) -> list[tuple]:
        if self.begun:
            self.held += END.encode()
        self.begun = True
        self.held += part.encode("utf-8", "surrogatepass")
        return list(self._whole())

    def close(self) -> list[tuple]:
        """The writer ends each record with END, which the last split has taken."""
        self.held += END.encode()
        out = list(self._whole())
        if self.head is not None or self.held not in (b"", END.encode()):
            raise ValueError(f"{self.file}: the last record is cut off")
        return out

    def _whole(self) -> Iterator[tuple]:
        end = END.encode()
        while True:
            if self.head is None:
                at = self.held.find(end)
                if at <= 0:
                    return
                lines = self.held[:at].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{self.file}: no record begins with {lines[0][:40]!r}")
                self.head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
                del self.held[: at + len(end)]
            size = int(self.head["content-length"])
            if len(self.held) < size + len(end):
                return
            payload, head = bytes(self.held[:size]), self.head
            if self.held[size : size + len(end)] != end:
                raise ValueError(f"{self.file}: {head.get('warc-record-id')} does not end after {size} bytes")
            del self.held[: size + len(end)]
            self.head = None
            if head.get("content-type", "").startswith("application/http"):
                payload = payload[payload.index(end) + len(end) :]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            page = head.get("x-page-id")
            stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
            yield head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), None if page is None else int(page), head.get("warc-refers-to"), stated, payload.decode("utf-8", "surrogatepass") if self.payloads else None, len(payload), digest


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record_id", "record_type", "url", "page_id", "refers_to", "stated_digest", "payload", "bytes", "digest"]
    kinds = [pa.int64() if n in ("page_id", "bytes") else pa.string() for n in names]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def resolve_read(records: DataFrame) -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id); revisits take what belongs to the payload from the response that they refer to."""
    kept = records.select("record_id", "page_id", "bytes", "digest", "record_type", F.col("refers_to").alias("target"), "stated_digest")
    revisits = kept.where("record_type = 'revisit'")
    wanted = revisits.groupBy(F.col("target").alias("wanted")).agg(F.lit(1).alias("one")).select("wanted")
    originals = kept.where("record_type = 'response'").join(wanted, F.col("record_id") == F.col("wanted"), "left_semi")
    originals = originals.select(F.col("record_id").alias("original"), F.col("page_id").alias("original_page"), F.col("bytes").alias("original_bytes"), F.col("digest").alias("original_digest"))
    found = revisits.join(originals, F.col("target") == F.col("original"), "left")
    found = found.select("page_id", F.col("original_bytes").alias("payload_bytes"), F.col("original_digest").alias("payload_digest"), "record_type", F.col("original_page").alias("refers_to"))
    own = kept.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found)

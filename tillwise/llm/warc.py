"""WARC archives, one gzip member per record, and a reader that splits them.

Files are written by Spark's text writer and so committed like any of its output: a
lost executor leaves no half record. That writer ends each row with a separator, which
here is an empty gzip member; other tools decode the files as they are.

To read, files are cut into byte ranges. A task looks for the bytes that begin a gzip
member, takes a place for a record only if it inflates to a WARC header, and owns the
records that start inside its range. From the first one on it goes from member to
member, and past its end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.plans.durable import written_once

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000 0000".replace(" ", ""))
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_READ = 1 << 18
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with response_id: of pages with equal payloads of at
    least ``min_bytes`` bytes, the largest page_id. A page is written in full if that is
    its own page_id, if its payload is smaller, or if no page of the group has an id;
    otherwise it is a revisit.

    A null html is empty. Only digests and ids are shuffled for the groups; then pages join
    them by digest, where a very common payload can be split.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(body).alias("_sha1"), F.length(body).alias("_bytes"))
    largest = pages.filter(F.col("_bytes") >= min_bytes).groupBy("_sha1").agg(F.max("page_id").alias("response_id"))
    largest = largest.join(pages.groupBy("_sha1").count().filter("count > 1").select("_sha1"), "_sha1", "left_semi")
    kept = F.when(F.col("page_id").isNotNull(), F.col("response_id"))
    return pages.join(largest, "_sha1", "left").select("page_id", "url", "html", kept.alias("response_id"))


def _header_value(value: str) -> str:
    """A value on one line: control characters and space are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP header alone and names its response."""
    digest = payload_digest(payload)
    revisit = response_id is not None and response_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
              ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _header_value(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    fields += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(response_id, digest)),
                   ("X-Refers-To-Page-ID", str(response_id))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, html, response_id in zip(*(c.to_pylist() for c in batch.columns)):
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(squeeze.compress(record(page_id, url, (html or "").encode(), response_id, date)) + squeeze.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes ``pages`` (page_id, url, html, response_id) as gzipped WARC files to ``path``,
    a folder of any file system that Spark writes to. A null response_id means in full."""
    members = pages.select("page_id", "url", "html", "response_id").mapInArrow(
        lambda batches: _members(batches, date), "member binary")
    # The text writer copies the bytes of a row as they are.
    members.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


# -- reading ----------------------------------------------------------------------

class _Window:
    """A file's bytes from some place on, read as needed."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def fill(self, upto: int) -> None:
        """Has at least the bytes before ``upto``, or all there are."""
        while self.at + len(self.data) < min(upto, self.size):
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(min(max(_READ, upto - self.at - len(self.data)), self.size - self.at - len(self.data)))

    def drop(self, before: int) -> None:
        if before - self.at >= 4 * _READ:
            self.data, self.at = self.data[before - self.at:], before

    def find(self, start: int, end: int) -> int | None:
        """The next place in [start, end) where a gzip member may begin."""
        while start < end:
            self.fill(min(start + _READ, end) + len(MAGIC))
            found = self.data.find(MAGIC, start - self.at, min(start + _READ, end) - self.at + len(MAGIC) - 1)
            if found >= 0:
                return self.at + found
            start = min(start + _READ, end)
            self.drop(start)
        return None

    def inflate(self, start: int, probe: bool = False) -> tuple[bytes, int] | None:
        """The member at ``start`` and where the next begins; null if there is none. A
        probe stops after a few bytes."""
        inflater, out, place = zlib.decompressobj(31), [], start
        try:
            while not inflater.eof:
                self.fill(place + (512 if probe else _READ))
                piece = self.data[place - self.at:place - self.at + (512 if probe else _READ)]
                if not piece:
                    return None
                out.append(inflater.decompress(piece))
                place += len(piece)
                if probe:
                    break
        except zlib.error:
            return None
        return b"".join(out), place - len(inflater.unused_data)


def _parsed(raw: bytes) -> dict | None:
    """A record's fields, lower-cased, and its payload; null if it is none."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    http, _, payload = rest[:int(length)].partition(b"\r\n\r\n")
    return fields | {"payload": payload}


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records of a file that start in [start, end)."""
    window = _Window(file, size, start)
    place: int | None = start
    aligned = False
    while place is not None and place < end:
        if not aligned:
            place = window.find(place, end)
            if place is None:
                return
            probe = window.inflate(place, probe=True)
            if probe is None or not probe[0].startswith(b"WARC/1."):
                place += 1
                continue
        member = window.inflate(place)
        found = _parsed(member[0]) if member is not None else None
        if found is not None:
            yield place, found
        elif member is None or member[0]:
            aligned, place = False, place + 1  # neither a record nor an empty member: look on
            continue
        aligned, place = True, member[1]
        window.drop(place)


def _opened(path: str):
    """A file of any store that pyarrow knows by its address."""
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


_FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                    ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("header_digest", pa.string()),
                    ("payload_digest", pa.string()), ("payload", pa.binary())])


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _read(batches: Iterator[pa.RecordBatch], rows_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            rows, held = [], 0
            with _opened(path) as file:
                for _, r in records_in(file, size, start, end):
                    kind, payload = r.get("warc-type"), r["payload"]
                    header = r.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((_number(r.get("x-page-id")), r.get("warc-target-uri"), r.get("warc-record-id"), kind,
                                 r.get("warc-refers-to"), _number(r.get("x-refers-to-page-id")), header,
                                 None if kind == "revisit" else payload_digest(payload), None if kind == "revisit" else payload))
                    held += len(payload)
                    if held >= rows_bytes:
                        yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, row)) for row in rows], schema=_FOUND)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, row)) for row in rows], schema=_FOUND)


def warc_records(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """Every record of the WARC files in ``path``: page_id, url, record_id, record_type,
    refers_to_record, refers_to, header_digest, payload_digest, payload. The last two are
    read from the record and null for revisits. Files are listed by Spark and read in
    ranges of ``range_bytes``, so one large file is many tasks. Bytes that are no WARC
    record are passed over; an empty folder gives no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.withColumn("start", start).select(
        "path", "length", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    spread = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "start")
    return spread.mapInArrow(_read, "page_id long, url string, record_id string, record_type string, refers_to_record string, "
                                    "refers_to long, header_digest string, payload_digest string, payload binary")


def read_warc(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes and
    payload_digest of the full payload. Those of a revisit come from the response that it
    names, found by record id among all files; null if that is missing."""
    # Kept without payloads: the archives are read once, and the sizes of both sides of
    # the join are known rather than guessed from the list of ranges.
    found = written_once(
        warc_records(spark, path, range_bytes).withColumn("bytes", F.length("payload").cast("long")).drop("payload"), "records")
    is_revisit = F.col("record_type").eqNullSafe(F.lit("revisit"))
    full = found.filter(~is_revisit)
    responses = full.groupBy(F.col("record_id").alias("of")).agg(
        F.first("bytes").alias("of_bytes"), F.first("payload_digest").alias("of_digest"))
    named = found.filter(is_revisit).join(responses, F.col("refers_to_record") == F.col("of"), "left").withColumns(
        {"bytes": F.col("of_bytes"), "payload_digest": F.col("of_digest")})
    return full.unionByName(named.select(*full.columns)).select(
        "page_id", "url", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), "payload_digest",
        (F.col("payload_digest") == F.col("header_digest")).alias("digest_agrees"))

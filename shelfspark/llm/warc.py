"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: equal payloads are found by digest and length over narrow rows; payloads themselves go to a writer once. Each
task writes gzip members, one for a record, into files of its own in the shared folder and returns a manifest row per
file. A file of a task that failed or ran twice is in no manifest and never read.

Reading: a task takes a byte range, looks for gzip magic from its start, accepts a candidate if it decodes to a WARC
header and its member is followed by another or by the end of the file, and owns the records that start inside its
range; it reads past the end of the range to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_schema, materialize, shared_path

MAGIC = b"\x1f\x8b\x08"
#: A record is a page's; the identifier is in the record's URI.
RECORD_URI = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
#: Tasks of a read at most, each with several ranges; records that a task gives to Spark together.
READ_TASKS, RECORDS_AT_ONCE = 20_000, 64
FILE_BYTES, SPLIT_BYTES, READ_BYTES, HEADER_BYTES = 64 << 20, 4 << 20, 256 << 10, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode()


def clean(value: str | None) -> str:
    """A header's value on one line."""
    return " ".join((value or "").split())


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed: a response, or a revisit of the page refers_to without the payload."""
    http = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{RECORD_URI}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    block = http
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD_URI}{refers_to}>")]
    return head("WARC/1.1", [*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


PAYLOAD = ["payload_sha", "payload_xx", "payload_n"]


def digested(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with two digests and the length of the payload."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.withColumns(dict(zip(PAYLOAD, (F.sha1(html), F.xxhash64(html), F.octet_length(html)))))


def revisits(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """(page_id, digests and length of the payload, refers_to) where another page with a larger page_id has that payload.

    pages: digested(). Only payloads of at least `smallest` bytes count. Pages of one page_id are told apart by payload.
    """
    narrow = materialize(pages.select("page_id", *PAYLOAD), "digests")
    groups = narrow.where(F.col("payload_n") >= smallest).groupBy(*PAYLOAD).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return narrow.join(groups, PAYLOAD).where("page_id != refers_to").select("page_id", *PAYLOAD, "refers_to").distinct()


def write(pages: DataFrame, folder: str, smallest: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into folder; gives the manifest (path, bytes, records).

    Null html or url count as empty. Rows with the same page_id and payload are all written; they are responses or
    revisits alike. Rows with the same page_id and different payloads are records of their own, each with its payload or
    a revisit of an equal one. A null page_id is an empty one, and its page a response. Extra columns are ignored.
    """
    fields = digested(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    linked = fields.join(revisits(fields, smallest), ["page_id", *PAYLOAD], "left")

    def run(batches):
        import pyarrow as pa

        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        out, path, written, records, rows = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                rows.append((path, written, records))
                out = None

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path, written, records = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                data = member(record(page_id, url, (html or "").encode(), refers_to))
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= file_bytes:
                    close()
        close()
        if rows:
            names, sizes, counts = zip(*rows)
            prefix = folder[: folder.index(root)] if root in folder else ""
            yield pa.RecordBatch.from_arrays([pa.array([prefix + n for n in names]), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"])

    return materialize(linked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class Range:
    """Bytes of a file from a place on, read as they are needed, in one buffer that grows at its end."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.ended = file, start, bytearray(), False
        file.seek(start)

    def need(self, at: int, n: int) -> bool:
        """Whether n bytes from at on are there, after reading more if they aren't."""
        while len(self.data) < at + n - self.start and not self.ended:
            more = self.file.read(READ_BYTES)
            self.ended = not more
            self.data += more
        return len(self.data) >= at + n - self.start

    def find(self, at: int, stop: int) -> int:
        """The first place of gzip magic from at on and before stop, or -1."""
        while at < stop:
            self.need(at, min(READ_BYTES, stop - at + 2))
            found = self.data.find(MAGIC, at - self.start, stop - self.start + 2)
            if found >= 0:
                return found + self.start
            reached = self.start + len(self.data) - 2
            if self.ended or reached >= stop:
                return -1
            at = max(at, reached)
        return -1

    def drop(self, at: int) -> None:
        del self.data[: at - self.start]
        self.start = at

    def read(self, at: int) -> tuple[bytes, int] | None:
        """The content and the end of the WARC member at a place, or None if there is none."""
        unpack, parts, seen, valid = zlib.decompressobj(31), [], at, False
        try:
            while not unpack.eof:
                if not self.need(seen, 1):
                    return None
                piece = self.data[seen - self.start : seen - self.start + READ_BYTES]
                parts.append(unpack.decompress(piece))
                seen += len(piece)
                if not valid:
                    began = b"".join(parts)[:7]
                    if len(began) == 7 and began != b"WARC/1.":
                        return None
                    valid = len(began) == 7
        except zlib.error:
            return None
        end = seen - len(unpack.unused_data)
        follows = self.need(end, 3) and self.data[end - self.start : end - self.start + 3] == MAGIC or not self.need(end, 1)
        return (b"".join(parts), end) if valid and follows else None


def records_in(uri: str, start: int, stop: int) -> Iterator[bytes]:
    """The records whose member starts in a byte range of a file."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        view, at = Range(file, start), start
        while (at := view.find(at, stop)) >= 0:
            got = view.read(at)
            if got is None:
                at += 1
                continue
            yield got[0]
            at = got[1]
            view.drop(at)


def parsed(data: bytes) -> dict:
    """Fields of a record; payload of a response, and its length and digest in either case."""
    top, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode().split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    stated = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].partition(":")[2] if revisit else base32_sha1(payload)
    if not revisit and (stated != len(payload) or fields["warc-payload-digest"] != f"sha1:{digest}"):
        raise ValueError(f"record {fields['warc-record-id']}: the payload isn't the one that was written")
    refers = fields.get("warc-refers-to")
    number = lambda uri: uri.strip("<>").removeprefix(RECORD_URI)
    page = lambda uri: int(number(uri)) if number(uri) else None
    return {
        "page_id": page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": page(refers) if refers else None,
        "payload": None if revisit else payload,
    }


def read(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """The records of the files of a manifest (path, bytes), split into byte ranges; payload (binary) if asked for."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches):
        import pyarrow as pa

        target, rows = arrow_schema(schema), []
        for batch in batches:
            for place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for data in records_in(*place):
                    record = parsed(data)
                    rows.append({n: record[n] for n in target.names})
                    if len(rows) == RECORDS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, target)
                        rows.clear()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, target)

    return ranges.repartition(min(READ_TASKS, max(1, ranges.count()))).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, smallest: int = 0, folder: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages as WARC archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of pages with equal payloads of at least `smallest` bytes, that with the largest page_id is the response and the
    others revisit it; smaller ones are all responses. An empty table gives no rows.
    """
    manifest = write(pages, folder or shared_path(spark, "warc"), smallest)
    return read(spark, manifest, split_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives: written by tasks with one gzip member per record, read by byte ranges.

Reading is splittable: a task gets a range of a file, looks for the gzip magic bytes in it, checks each
place by inflating the first bytes and reading a record's header there, and owns the records that start
inside its range, however far they go on beyond it. Places that only look like a member fail that check.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.files import created, opened
from tallyloom.llm.shared import ddl, new_folder, slices, written

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: The time of every record: a fixed one, so that equal pages give equal archives.
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are always written whole.
LEAST = 1000
RANGE = 8 << 20
_READ = 1 << 20
_HEADER_LIMIT = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member: an HTTP message, of a page that was found. A revisit has the message's head alone."""
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        body += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head = VERSION + "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + body + b"\r\n\r\n") + pack.flush()


def references(pages: DataFrame) -> DataFrame:
    """(digest, size, refers_to): for payloads of at least LEAST bytes, the largest page id that has them."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"))
    large = keyed.where((F.col("size") >= LEAST) & F.col("page_id").isNotNull())
    first = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"))
    return (
        large.join(written(first, "payloads"), ["digest", "size"])
        .where(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html) as archives and returns their list (file, bytes)."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with created(folder, name) as out:
            for batch in slices(batches, "html"):
                html = pc.fill_null(batch.column("html"), "").cast(pa.binary()).to_pylist()
                ids, urls, own, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
                for page, url, payload, digest, to in zip(ids, urls, html, own, refers):
                    member = record(page, url, payload, hashlib.sha1(payload).hexdigest() if digest is None else digest, to)
                    out.write(member)
                    size += len(member)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size])], ["file", "bytes"])

    again = written(references(pages), "revisits").withColumnRenamed("digest", "known")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("digest", F.sha1(payload))
    # Revisits are found by page and digest: rows that repeat a page id may have other payloads.
    joined = rows.join(again, (rows.page_id == again.page_id) & (rows.digest == again.known), "left").select(
        rows.page_id, "url", "html", "digest", "refers_to"
    )
    listed = joined.mapInArrow(write, ddl("file string, bytes bigint"))
    listed.write.parquet(f"{folder}/list")
    return pages.sparkSession.read.schema(listed.schema).parquet(f"{folder}/list")


class _Window:
    """Bytes of an open file from a moving position on, read as they are asked for."""

    def __init__(self, source, at: int):
        self.source, self.at, self.data = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        got = self.source.read(_READ)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(window: _Window, skip: int) -> tuple[bytes, int] | None:
    """The inflated member at `skip` bytes into the window and its compressed length; None if there is no record."""
    unpack, out, used, checked = zlib.decompressobj(31), bytearray(), skip, False
    while True:
        if used >= len(window.data) and not window.more():
            return None
        chunk = window.data[used : used + (4096 if not checked else _READ)]
        try:
            out += unpack.decompress(chunk)
        except zlib.error:
            return None
        used += len(chunk)
        if not checked:
            if not out.startswith(VERSION[: len(out)]):
                return None
            checked = b"\r\n\r\n" in out
            if not checked and (len(out) > _HEADER_LIMIT or unpack.eof):
                return None
        if unpack.eof:
            return bytes(out), used - len(unpack.unused_data) - skip


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    size = int(fields["content-length"])
    return (fields, rest[:size]) if len(rest) >= size else None


def records(source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of the records of an open archive that start in [start, end)."""
    window, skip = _Window(source, start), 0
    while window.at + skip < end:
        found = window.data.find(MAGIC, skip)
        if found < 0 or window.at + found >= end:
            # A magic number may lie across the bytes read so far.
            if found >= 0 or (window.at + len(window.data) >= end + len(MAGIC)) or not window.more():
                return
            skip = max(skip, len(window.data) - _READ - len(MAGIC))
            if skip > _READ:
                window.drop(skip)
                skip = 0
            continue
        member = _member(window, found)
        parsed = member and _parsed(member[0])
        if parsed:
            yield parsed
            window.drop(found + member[1])
            skip = 0
        else:
            skip = found + 1


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(listed: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of archives listed as (file, bytes)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for file, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end"))):
                system, path = opened(file)
                rows, size = [], 0
                with system.open_input_file(path) as source:
                    for fields, content in records(source, start, end):
                        kind = fields["warc-type"]
                        if fields.get("content-type", "").startswith("application/http"):
                            content = content.partition(b"\r\n\r\n")[2]
                        whole = kind == "response"
                        rows.append((
                            _page(fields.get("warc-record-id")), fields.get("warc-target-uri"),
                            len(content) if whole else int(fields["x-payload-length"]),
                            hashlib.sha1(content).hexdigest() if whole else fields["warc-payload-digest"].removeprefix("sha1:"),
                            kind, _page(fields.get("warc-refers-to")), content if whole else None,
                        ))
                        size += len(content)
                        if size > (8 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    ranges = listed.where("bytes > 0").select("file", F.explode(starts).alias("start")).withColumn("end", F.col("start") + range_bytes)
    n = max(1, ranges.count())
    return ranges.repartitionByRange(n, "file", "start").mapInArrow(
        read,
        ddl("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"),
    )


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """Writes the pages as archives and reads them back, columns as in `read_archives`.

    Of equal payloads of at least LEAST bytes, the record with the largest page id is the response and the
    others revisit it; of rows that repeat that id with that payload each is a response. A null
    html is an empty payload, a null url an empty one. A null page id is always a response. White space in
    a url becomes a space. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return read_archives(write_archives(rows, folder or new_folder(pages.sparkSession, "warc")), range_bytes)

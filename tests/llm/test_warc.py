import gzip
import hashlib
import io

import pytest

from tallyloom.llm import warc as W
from tallyloom.llm.shared import new_folder


def expected(rows):
    last = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if page is not None and len(body) >= 1000:
            last[body] = max(page, last.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = last.get(body) if page is not None and len(body) >= 1000 else None
        to = None if to == page else to
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def rows_of():
    same, other = "é<p>same</p>" * 100, "<p>other</p>" * 200
    rows = [(i, f"http://x/{i}", same if i % 3 == 0 else f"<p>{i}</p>" * (i * 7)) for i in range(60)]
    rows += [(70, None, other), (71, "a\r\nb", other), (72, "u", None), (73, "u", ""), (74, "u", "x" * 999), (75, "u", "x" * 999), (76, "u", "x" * 1000), (77, "u", "x" * 1000)]
    rows += [(78, "u", "\x1f WARC/1.1\r\n\r\n" * 20), (79, "u", "y" * 3_000_000), (70, None, other), (71, "a\r\nb", other), (None, "u", other)]
    return rows


@pytest.mark.parametrize("size", [200, 4096, W.RANGE])
def test_agrees_with_rules_for_any_ranges(spark, size):
    df = spark.createDataFrame(rows_of(), "page_id long, url string, html string").repartition(3)
    assert result(W.archived(df, range_bytes=size)) == expected(rows_of())


def test_payloads_come_back(spark):
    df = spark.createDataFrame(rows_of(), "page_id long, url string, html string")
    html = {p: h for p, _, h in rows_of()}
    for r in W.archived(df).where("record_type = 'response' and page_id is not null").collect():
        assert bytes(r["payload"]).decode() == (html[r["page_id"]] or "")


def test_archives_are_gzip_members(spark):
    folder = new_folder(spark, "warc-test")
    listed = W.write_archives(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), folder)
    row = listed.where("bytes > 0").collect()[0]
    raw = gzip.decompress(open(row["file"].removeprefix("file://"), "rb").read())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: response") == 2 and b"Content-Length: 1\r\n\r\na\r\n\r\n" in raw
    assert raw.count(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n") == 2 == raw.count(b"\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")


def test_a_record_is_as_long_as_its_message():
    for payload, to in ((b"", None), (b"x\r\n\r\ny", None), (b"z" * 2000, 7)):
        head, _, block = gzip.decompress(W.record(1, "u", payload, "0" * 40, to)).partition(b"\r\n\r\n")
        size = int(head.rsplit(b"Content-Length: ", 1)[1])
        message, end = block[:size], block[size:]
        assert end == b"\r\n\r\n" and message.partition(b"\r\n\r\n")[2] == (payload if to is None else b"")


def test_every_range_owns_the_records_that_start_in_it():
    # Bytes in front that look like a member, and stored members inside of a payload, are no records.
    inner = W.record(9, "u", b"inner", "0" * 40, None)
    parts = [b"\x1f\x8b\x08\x00junk", W.record(1, "u", b"x" * 5000, "0" * 40, None)]
    parts += [gzip.compress(b"no record"), W.record(2, "u", inner, "1" * 40, None), W.record(3, "u", b"", "2" * 40, None)]
    raw = b"".join(parts)
    for step in (1, 7, 64, 1000, len(raw)):
        found = [f["warc-record-id"] for a in range(0, len(raw), step) for f, _ in W.records(io.BytesIO(raw), a, a + step)]
        assert found == [f"<urn:page:{i}>" for i in (1, 2, 3)], step


def test_agrees_on_the_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert result(W.archived(pages)) == expected([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "x", "d")], "page_id long, url string, html string, digest string")
    assert result(W.archived(df)) == expected([(1, "u", "x")])
    assert W.archived(df.limit(0)).collect() == []

"""Web archives: exact round trips, validation, revisits."""

import base64
import hashlib
import io

import pytest
import zstandard

from termwell.llm.common import scratch_dir
from termwell.llm.warc import EMPTY_FRAME, frames_of, parse_record, read_archives, write_archives

PAGES = [
    (5, "http://a.example/x", "<p>one</p>"), (3, "http://b.example/", "<p>one</p>"), (9, None, "<p>two é</p>"),
    (1, "http://c.example/ \r\nX: y", None), (2, "http://d.example/", ""), (7, "http://e.example/", "long " * 300000),
    (8, "u", "a\x00b\r\n\r\nc"), (8, "u", "a\x00b\r\n\r\nc"), (None, "http://f.example/", "<p>one</p>"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def written(spark):
    path = scratch_dir(spark, "test-warc")
    rows = PAGES + [(100 + k, f"http://h.example/{k}", f"<html><body>page {k} " + "filler text " * (k % 50) + "</body></html>") for k in range(700)]
    df = spark.createDataFrame([(a, b, c, "x", "y", 1) for a, b, c in rows], "page_id long, url string, html string, sha1 string, n string, first_id int")
    write_archives(df.repartition(3), path)
    return path, rows


def test_round_trip(spark, written):
    path, rows = written
    got = read_archives(spark, path).collect()
    assert all(r.error is None for r in got) and len(got) == len(rows)
    firsts = {}
    for i, _, html in rows:
        if i is not None:
            firsts[digest(html)] = min(firsts.get(digest(html), i), i)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for i, url, html in rows:
        for r in by_id[i]:
            raw = (html or "").encode()
            first = firsts.get(digest(html))
            revisit = i is not None and first < i
            assert (r.payload_bytes, r.payload_digest) == (len(raw), digest(html))
            assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (first if revisit else None)
            assert r.payload == (None if revisit else raw)
            assert (r.uri is None) == (url is None) and "\n" not in (r.uri or "")


def test_files_are_standard_archives(spark, written):
    """Each file starts with its dictionary; a plain streaming reader decodes the rest, one frame per record."""
    path, _ = written
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    trained = 0
    for f in files:
        content = bytes(f.content)
        size = int.from_bytes(content[4:8], "little")
        assert content[:4] == bytes.fromhex("5d2a4d18")
        words = zstandard.ZstdDecompressor().decompressobj().decompress(content[8:8 + size]) if size else b""
        trained += bool(words)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).stream_reader(
            io.BytesIO(content[8 + size:]), read_across_frames=True)
        whole = reader.read()
        records = [r for r, _ in frames_of(content)]
        assert whole == b"".join(records) and whole.startswith(b"WARC/1.1\r\n")
    assert trained


def test_faults_are_reported():
    frame = zstandard.ZstdCompressor().compress(b"WARC/1.1\r\n\r\n")
    assert list(frames_of(b"")) == []
    assert list(frames_of(EMPTY_FRAME.encode())) == []
    assert list(frames_of(frame[:-3]))[-1][1] in ("truncated frame",) or "bad frame" in list(frames_of(frame[:-3]))[-1][1]
    assert list(frames_of(b"garbage that is no frame"))[-1][0] is None
    assert list(frames_of(b"P*M\x18\xff\x00\x00\x00"))[-1] == (None, "truncated skippable frame")
    good = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nWARC-Date: x\r\nWARC-Payload-Digest: sha1:"
            + digest("hi").encode() + b"\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    good = good.replace(b"Content-Length: 40", b"Content-Length: %d" % len(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"))
    assert parse_record(good)["payload"] == b"hi"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"Length: 2", b"Length: 3"),
                good.replace(b"hi\r\n", b"ho\r\n"), good.replace(b"WARC-Date: x\r\n", b""), b"", b"WARC/1.1\r\nbroken"):
        with pytest.raises(ValueError):
            parse_record(bad)


def test_empty_table(spark):
    path = scratch_dir(spark, "test-warc")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0


def test_short_payloads_below_a_minimum_are_responses(spark):
    path = scratch_dir(spark, "test-warc")
    write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                                         "page_id long, url string, html string"), path, min_bytes=5)
    assert {r.page_id: r.record_type for r in read_archives(spark, path).collect()} == {
        1: "response", 2: "response", 3: "response", 4: "revisit"}

"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` writes one archive per partition through Spark's text writer:
a line is the dictionary frame or one record's frame, and the line separator is
an empty skippable frame, so every file is a valid Zstandard stream and a valid
archive. ``read_archives`` loads the dictionary from the leading frame, decodes
record after record, and validates version line, headers, lengths and digests;
a record that fails is returned with its ``error`` and does not end the read.

A dictionary is trained per archive on its first records, at most
``TRAIN_RECORDS`` of ``TRAIN_CLIP`` bytes each; all others stream. An archive
with too few records for training has an empty dictionary frame.

Defined cases: a null payload is empty; a null address leaves its header out;
control characters in addresses are percent-encoded; of records with equal
payloads the smallest identifier is the response (several rows with that same
identifier are all responses) and a null identifier is always a response; an
empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.llm.common import read_table, scratch_dir
from termwell.llm.registry import query

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame of no bytes
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
TRAIN_RECORDS = 256
TRAIN_CLIP = 8192
DICTIONARY_BYTES = 32768
LEVEL = 6
READ_STEP = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = ("archive string, page_id long, uri string, record_type string, refers_to long, payload_bytes long, "
                 "payload_digest string, payload binary, error string")


def _with_roles(pages: DataFrame, page_id: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Add ``sha1`` and ``refers_to``: the smallest identifier with an equal payload, null for that one itself.

    Payloads below ``min_bytes`` are never revisits. Counts are combined before
    the shuffle and only digests seen twice are joined back.
    """
    keyed = pages.withColumn("sha1", F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary")))
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    firsts = (keyed.filter(size >= min_bytes).groupBy("sha1")
              .agg(F.min(page_id).alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = keyed.join(firsts.hint("shuffle_hash"), "sha1", "left")
    return joined.withColumn("refers_to", F.when(F.col("first_id") < F.col(page_id), F.col("first_id"))).drop("first_id")


def _record(page_id, uri, payload: bytes, sha1: str, refers_to) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = b"\r\n".join(head) + b"\r\n\r\n" + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _records(batches) -> Iterator[bytes]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _record(row["page_id"], row["uri"], row["payload"], row["sha1"], row["refers_to"])


def _trained(sample: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:TRAIN_CLIP] for r in sample]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        return b""


def _archive(batches):
    """The frames of one archive, as one row each."""
    records, sample = _records(batches), []
    for record in records:
        sample.append(record)
        if len(sample) == TRAIN_RECORDS:
            break
    if not sample:
        return
    trained = _trained(sample)
    content = zstandard.ZstdCompressor(level=LEVEL).compress(trained) if trained else b""
    packer = zstandard.ZstdCompressor(
        level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    frames, held = [struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content], 0
    for part in (sample, records):
        for record in part:
            frames.append(packer.compress(record))
            held += len(frames[-1])
            if held > 4_000_000:
                yield pa.record_batch({"value": pa.array(frames, pa.binary())})
                frames, held = [], 0
        sample = None
    if frames:
        yield pa.record_batch({"value": pa.array(frames, pa.binary())})


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", payload: str = "html",
                   min_bytes: int = 0) -> None:
    """Write every row as a record; one archive per partition below ``path``."""
    rows = _with_roles(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(uri).alias("uri"),
                                   F.coalesce(F.col(payload), F.lit("")).alias("payload")),
                      payload="payload", min_bytes=min_bytes)
    frames = rows.select("page_id", "uri", F.col("payload").cast("binary").alias("payload"), "sha1", "refers_to")
    frames.mapInArrow(_archive, "value binary").select(F.col("value").cast("string")).write.option(
        "lineSep", EMPTY_FRAME).option("compression", "none").text(path)


def frames_of(content) -> Iterator[tuple[bytes | None, str | None]]:
    """The decoded frames after the dictionary; (None, reason) once where the stream breaks off."""
    view = memoryview(content)
    size = len(view)
    at, loaded, opener = 0, None, None
    while at < size:
        if size - at < 8:
            yield None, "truncated frame head"
            return
        magic, length = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + length > size:
                yield None, "truncated skippable frame"
                return
            if magic == DICTIONARY_MAGIC and at == 0 and length:
                inner = bytes(view[8:8 + length])
                try:
                    loaded = zstandard.ZstdCompressionDict(
                        zstandard.ZstdDecompressor().decompressobj().decompress(inner)
                        if inner.startswith(FRAME_MAGIC) else inner)
                except zstandard.ZstdError as error:
                    yield None, f"bad dictionary: {error}"
                    return
            at += 8 + length
            continue
        opener = opener or zstandard.ZstdDecompressor(dict_data=loaded)
        unpacker = opener.decompressobj()
        parts = []
        try:
            while not unpacker.eof and at < size:
                step = min(READ_STEP, size - at)
                parts.append(unpacker.decompress(bytes(view[at:at + step])))
                at += step
        except zstandard.ZstdError as error:
            yield None, f"bad frame: {error}"
            return
        if not unpacker.eof:
            yield None, "truncated frame"
            return
        at -= len(unpacker.unused_data)
        yield b"".join(parts), None


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d{1,19}", value) else None


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", value or "")
    return int(found[1]) if found else None


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first of a name counts."""
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields


def parse_record(record: bytes) -> dict:
    """The fields of one record; raises ValueError where it is not valid."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not record.startswith(b"WARC/1."):
        raise ValueError("no version line")
    if not found:
        raise ValueError("headers do not end")
    fields = _fields(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    length = _number(fields["content-length"])
    if length is None or length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block does not have the length stated")
    kind = fields["warc-type"]
    out = {"page_id": _page(fields["warc-record-id"]), "uri": fields.get("warc-target-uri"), "record_type": kind,
           "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": None, "payload_digest": None,
           "payload": None, "error": None}
    if kind not in ("response", "revisit"):
        return out
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("no message head")
    stated = _number(_fields(http).get("content-length"))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if payload or out["refers_to"] is None or not digest or stated is None:
            raise ValueError("a revisit needs its response, its digest and length, and no payload")
        return out | {"payload_bytes": stated, "payload_digest": digest}
    if stated != len(payload):
        raise ValueError("the payload does not have the length stated")
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("the payload does not have the digest stated")
    return out | {"payload_bytes": stated, "payload_digest": digest, "payload": payload}


def read_archives(spark: SparkSession, path: str, glob: str = "part-*", payloads: bool = True) -> DataFrame:
    """The records of all archives below a path: ``RECORD_SCHEMA``. Archives are read one per row, whole."""
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for record, error in frames_of(content.as_buffer() or b""):
                    try:
                        if error:
                            raise ValueError(error)
                        row = parse_record(record)
                    except ValueError as wrong:
                        row = dict.fromkeys(names) | {"error": str(wrong)}
                    row["archive"] = archive.as_py()
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(read, RECORD_SCHEMA)


@query("op9_warc", """
    WITH bytes AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    firsts AS (SELECT hex, min(page_id) AS first_id FROM bytes GROUP BY hex),
    digits AS (SELECT hex, first_id, list_transform(range(8), lambda g: ('0x' || substr(hex, (g * 5 + 1)::INT, 5))::BIGINT) AS parts FROM firsts)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + ((parts[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
      CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first_id < page_id THEN first_id END AS refers_to
    FROM bytes JOIN digits USING (hex)
""")
def op9_warc(spark, sf_dir):
    """Write all pages as archives and read them back."""
    path = scratch_dir(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path, payloads=False)
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("error")))
    return records.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")

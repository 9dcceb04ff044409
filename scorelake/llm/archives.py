"""WARC archives of page files, compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of its records. Writing goes through
Spark's own text writer, so files are committed once and on any file system that Spark reaches: a row is a
whole archive, and the line separator is an empty skippable frame, which every reader of Zstandard passes over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.exchange import written

DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", SKIPPABLE_MAGIC, 0)
#: Bytes of records in an archive, of records a dictionary is trained on, and of the dictionary.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 8 << 20, 1 << 20, 16 << 10
ID = "<urn:page:{}>"


class ArchiveError(ValueError):
    """An archive that isn't well formed."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _encoded(text: str) -> str:
    """``text`` in one header line: blanks, control characters and what ends an id are percent-encoded, and so are per cent signs."""
    return re.sub(r"[\x00-\x20\x7f-\x9f%<>\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record(page_id, url: str | None, body: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or with ``refers_to`` a revisit record, which keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {ID.format(_encoded(str(page_id)))}")
    head += [f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(body)}"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {ID.format(_encoded(str(refers_to)))}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    """One archive. Too few or too equal records train no dictionary; then its frame is left out."""
    samples, size = [], 0
    for x in records:
        if size > TRAIN_BYTES:
            break
        samples.append(x[: 64 << 10])
        size += len(samples[-1])
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples, k=256, d=8)
    except zstandard.ZstdError:
        trained = None
    head = b""
    if trained is not None:
        head = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained.as_bytes()
    press = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    return head + b"".join(press.compress(x) for x in records)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its header and block headers."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    place = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if place + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        head = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ArchiveError("a block has no valid type")
        place += 3 + (1 if kind == 1 else size)
        if last:
            break
    place += 4 * bool(params.has_checksum)
    if place > len(data):
        raise ArchiveError("a frame is cut off")
    return place


def read_archive(data) -> Iterator[bytes]:
    """The records of an archive, one for each frame."""
    data, at, plain = memoryview(data), 0, zstandard.ZstdDecompressor()
    reader = plain
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError("bytes are left over")
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = bytes(data[8 : 8 + size])
            if len(raw) != size:
                raise ArchiveError("the dictionary is cut off")
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may be compressed itself
                raw = plain.decompress(raw)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = _frame_end(data, at)
            yield reader.decompress(data[at:end])
            at = end
        else:
            raise ArchiveError(f"no frame begins at byte {at}")


def parse_record(raw: bytes) -> dict:
    """Type, page, target, payload, its size and digest of a record; lengths and digests are checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError("a record has no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ArchiveError(f"a header line has no name: {line!r}")
        fields[name.lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("a record's length isn't what its header says")
    block = rest[:-4]
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise ArchiveError("a block doesn't match its digest")
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"a record of type {kind!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not size:
        raise ArchiveError("an HTTP header has no length")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(size[1]) or digest(payload) != said):
        raise ArchiveError("a payload doesn't match its length or digest")
    page = lambda name: (m := re.fullmatch(r"<urn:page:(.*)>", fields.get(name, ""), re.S)) and unquote(m[1])
    return {
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(size[1]),
        "payload_digest": said,
        "record_type": kind,
        "refers_to": page("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


def archive_pages(
    page_files: DataFrame, folder: str, revisit_bytes: int = 0, page_col: str = "page_id", url_col: str = "url", body_col: str = "body"
) -> None:
    """Write the files of all pages as WARC records into Zstandard archives below ``folder``.

    ``page_files``: (``page_id``, ``url``, ``body`` text or binary), one row per page; other columns are dropped. Of rows
    with equal bodies of ``revisit_bytes`` or more, that with the largest ``page_id`` becomes the response record and the
    others revisit it; all smaller ones are responses. Null bodies are empty payloads, null URLs become about:blank.
    Ids of any text are percent-encoded where a header needs it and read back as they were; a row without ``page_id`` makes a record without
    an id. Rows that repeat page and body are responses each. An empty table writes no archive. ``folder`` must not exist.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = page_files.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "n": F.octet_length("body")})
    groups = (
        rows.filter(F.col("n") >= revisit_bytes)
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    owner = F.when(F.col("owner") == F.col("page_id"), None).otherwise(F.col("owner"))
    # written, as AQE splits a hot body (on the left side) only beside a plain scan
    groups = written(groups, "archives-groups")
    named = rows.join(groups, ["digest", "n"], "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "body", owner.cast("string").alias("owner")
    )

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "body", "owner")]
            for page, url, data, ref in zip(*columns, strict=True):
                records.append(record(page.as_py(), url.as_py(), data.as_py(), ref.as_py()))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(records)], pa.binary())], names=["value"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(records)], pa.binary())], names=["value"])

    out = named.mapInArrow(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", 1).text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``folder``.

    Returns (page_id string, url, payload_bytes, payload_digest, record_type, refers_to string, payload binary); a revisit
    has no payload, and ``payloads=False`` leaves the column out. A damaged frame, header, length or digest fails the job.
    """
    kinds = {"payload_bytes": T.LongType(), "payload": T.BinaryType()}
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [parse_record(x) for x in read_archive(content.as_buffer())]
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], t) for n, t in zip(names, types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(records, schema)

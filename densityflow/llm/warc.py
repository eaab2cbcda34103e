"""Operator 1: WARC archives in Zstandard with a dictionary, written and read on Spark.

An archive begins with a skippable frame that holds the compression dictionary; then each record
is a Zstandard frame of its own. Spark's text writer puts frames one after the other: its line
separator is an empty skippable frame, which decoders pass over, so that the archives go through
the ordinary commit protocol to any file system. An archive is as large as a task's share.

Records of equal payloads of at least MIN_REVISIT bytes are stored once: that with the smallest
page_id (nulls last) is a response, others are revisits that carry its record id and the payload's
digest and length. Readers validate frame and record boundaries, header syntax, lengths and
digests; what is wrong is told in the column ``error``, and the record's other columns are null.

Defined results: a null html is an empty payload; a null url gives no target header; a null page_id
is written as an empty id; several rows with a payload's smallest page_id are all responses; an
empty table gives no archive and no record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densityflow.llm.common import cut, if_small, scratch_dir

MIN_REVISIT = 100
#: Pages from which the dictionary is trained, and how much of each; only compression depends on it.
#: Compressed bytes of an archive: it is read as one row.
ARCHIVE_BYTES = 64 << 20
SAMPLE_PAGES = 256
SAMPLE_CHARS = 32_768
DICTIONARY_BYTES = 65_536
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame, all ASCII.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:x-page:"
FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


class WarcError(ValueError):
    pass


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; where they are too few, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def skippable(payload: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(payload)) + payload


def _record(kind: str, page_id: int | None, url: str | None, refers_to: int | None, payload: bytes, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID_PREFIX}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frames_of(dictionary: bytes, most: int):
    """Rows (archive, at, frame): a task's archives, each begun by the dictionary and ended at most bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        context = TaskContext.get()
        task, number, size, at = context.partitionId() if context else 0, 0, 0, 0
        for batch in batches:
            archives, out = [], []
            for page_id, url, html, kind, refers_to, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= most:
                    number, size = number + 1, 0
                frame = packer.compress(_record(kind, page_id, url, refers_to, (html or "").encode(), digest))
                new = [frame] if size else [skippable(dictionary), frame]
                out += new
                archives += [f"{task}-{number}"] * len(new)
                size += sum(map(len, new))
            yield pa.RecordBatch.from_arrays([pa.array(archives, pa.string()), pa.array(range(at, at + len(out)), pa.int64()), pa.array(out, pa.binary())], names=["archive", "at", "frame"])
            at += len(out)

    return write


def split_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, frame) for each frame; the payload alone if it is skippable."""
    at, view, end = 0, memoryview(data), len(data)
    while at < end:
        if end - at < 8:
            raise WarcError("the archive ends inside a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > end:
                raise WarcError("the archive ends inside a skippable frame")
            yield magic, bytes(view[at + 8 : at + 8 + size])
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame begins at byte {at}")
        flags = data[at + 4]
        single = flags >> 5 & 1
        p = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if p + 3 > end:
                raise WarcError("the archive ends inside a frame")
            block = int.from_bytes(view[p : p + 3], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            p += 3 + (1 if kind == 1 else block >> 3)
        p += 4 * (flags >> 2 & 1)
        if p > end:
            raise WarcError("the archive ends inside a frame")
        yield magic, bytes(view[at:p])
        at = p


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not value.isdigit():
        raise WarcError("no valid Content-Length")
    return int(value)


def _page(value: str | None) -> int | None:
    inner = (value or "").removeprefix("<").removesuffix(">")
    if not inner.startswith(ID_PREFIX):
        raise WarcError(f"bad record id {value!r}")
    inner = inner.removeprefix(ID_PREFIX)
    return int(inner) if inner else None


def parse_record(record: bytes) -> tuple:
    """The values of FIELDS without error."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC header")
    h = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in h:
            raise WarcError(f"no {name}")
    n = _length(h)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the frame holds {len(rest) - 4}")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    status, *fields = http.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    size = _length(_headers(fields))
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = h["warc-type"]
    if kind == "response":
        if len(payload) != size:
            raise WarcError(f"the payload has {len(payload)} bytes instead of {size}")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload's digest differs")
        return _page(h["warc-record-id"]), h.get("warc-target-uri"), kind, None, size, digest, payload
    if kind != "revisit" or payload or len(digest) != 64:
        raise WarcError(f"bad {kind} record")
    return _page(h["warc-record-id"]), h.get("warc-target-uri"), kind, _page(h.get("warc-refers-to")), size, digest, None


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The values of FIELDS for each record; a broken archive ends with an error."""
    opener = None
    try:
        for k, (magic, frame) in enumerate(split_frames(data)):
            if magic != FRAME_MAGIC:
                if k == 0 and magic == DICTIONARY_MAGIC:
                    if frame[:4] == struct.pack("<I", FRAME_MAGIC):
                        frame = zstandard.ZstdDecompressor().decompress(frame)
                    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frame))
                continue
            if opener is None:
                opener = zstandard.ZstdDecompressor()
            try:
                yield *parse_record(opener.decompressobj().decompress(frame)), None
            except (WarcError, zstandard.ZstdError, UnicodeDecodeError, ValueError) as e:
                yield *[None] * 7, str(e)
    except WarcError as e:
        yield *[None] * 7, str(e)


def _parse(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for row in parse_archive(data.as_py()):
                    rows.append(row if with_payload else (*row[:6], None, row[7]))
                    size += len(row[6] or b"") if with_payload else 1
                    if size > 1 << 23 or len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return parse


def write_archives(pages: DataFrame, path: str, most: int = ARCHIVE_BYTES) -> None:
    """pages: (page_id, url, html). Archives of at most bytes and a record, whatever a task's rows hold."""
    pages = pages.select("page_id", "url", "html")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    first = digests.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = if_small(cut(first.where("copies > 1").select("digest", "first")))
    sample = [r[0].encode() for r in pages.select(F.substring("html", 1, SAMPLE_CHARS)).where("html IS NOT NULL").limit(SAMPLE_PAGES).collect()]
    rows = pages.withColumn("digest", F.sha2(body, 256)).join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"), "digest")
    frames = rows.mapInArrow(_frames_of(train(sample), most), "archive string, at long, frame binary")
    # a task's rows are in this order already; the sort says so to the writer, which must not sort by archive alone
    frames = frames.sortWithinPartitions("archive", "at").select(F.col("frame").cast("string").alias("value"), "archive")
    frames.write.partitionBy("archive").option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 0).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record: see FIELDS."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_parse(with_payload), FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads these back."""
    path = scratch_dir(pages.sparkSession)
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

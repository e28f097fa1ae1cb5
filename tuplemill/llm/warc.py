"""WARC archives with dictionary-compressed records (operator 4).

Each archive is a ``.warc.zst`` stream: a leading skippable frame (magic
0x184D2A5D) holds a Zstandard dictionary built from all records of that
archive, and each WARC/1.1 record is a Zstandard frame of its own, compressed
with the dictionary, so any record can be read alone.  Spark's file committer
writes the archives (one row is one file), whence any file system will do and
repeated tasks leave nothing behind; the line end that it appends is an empty
skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, record_batch, work_path, written

# Fixed values of the Zstandard and WARC formats.
DICT_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
SKIP_FIRST, SKIP_LAST = 0x184D2A50, 0x184D2A5F
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes after which an archive is closed, and the largest dictionary.
ARCHIVE_BYTES, DICT_BYTES = 16 << 20, 64 << 10
READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, record_id string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    """A header value can hold no line end; such characters become %XX."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\n" in value or "\r" in value else value


def record_id(page_id: int | None, copy: str = "") -> str:
    """A record's id; rows that share an id, or have none, are told apart by ``copy``."""
    return f"<urn:x-page:{'none' if page_id is None else page_id}{copy and ':' + copy}>"


def record(page_id: int | None, uri: str | None, payload: bytes, revisit: bool, refers_to: int | None, copy: str = "", named: bool = True, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response with its payload, or a revisit without it.

    A revisit names the record it refers to unless several have that page's id.
    """
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if uri is not None:
        head.append(f"WARC-Target-URI: {_one_line(uri)}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
            if named:
                head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], dict_bytes: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary of an archive's records.

    Where the trainer refuses (few, tiny or unlike records), the dictionary is
    raw content: the beginnings of all records, to equal parts.
    """
    import zstandard

    room = min(dict_bytes, sum(map(len, records)) // 8)
    try:
        return zstandard.train_dictionary(room, records, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join([r[: max(8, room // len(records))] for r in records])[:dict_bytes]


def archive(records: list[bytes], level: int = 3, dict_bytes: int = DICT_BYTES) -> bytes:
    """A whole archive but for the trailing empty frame."""
    import zstandard

    data = dictionary(records, dict_bytes)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(data)), data, *(packer.compress(r) for r in records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order."""
    import zstandard

    view, at, shared = memoryview(data), 0, None
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if SKIP_FIRST <= magic <= SKIP_LAST:
            (n,) = struct.unpack_from("<I", data, at + 4)
            if magic == DICT_MAGIC and n:
                shared = zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + n]))
            at += 8 + n
            continue
        unpacker = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        parts, step, size = [], at, 1 << 16
        while not unpacker.eof:
            if step >= len(data):
                raise ValueError("an archive ends within a record")
            parts.append(unpacker.decompress(view[step : step + size]))
            step += size
        at = min(step, len(data)) - len(unpacker.unused_data)
        raw = b"".join(parts)
        end = raw.index(b"\r\n\r\n")
        lines = raw[:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
        if not lines[0].startswith("WARC/") or raw[end + 4 + len(block) :] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield headers, block


def _page(number: str | None) -> int | None:
    return None if number is None else int(number)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Mark which pages repeat the payload of a page with a smaller id.

    Payloads are equal if their SHA-256 is.  The smallest id of a group comes
    from partial aggregates, so a group of any size moves one row per task;
    pages then meet their group's row in a sort-merge left join, whose skewed
    partitions Spark splits.  ``alone`` says whether no other row has the
    page's id, ``first_alone`` the same of the page that a revisit refers to.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_key", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1").drop("n").withColumn("first_alone", F.lit(True))
    rows = rows.withColumn("alone", F.col("page_id").isNotNull())
    again = rows.where("alone").groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id", F.lit(True).alias("again"))
    if not again.isEmpty():
        again = written(again, "warc-again")
        rows = rows.join(again.hint("merge"), "page_id", "left").withColumn("alone", F.col("alone") & F.col("again").isNull()).drop("again")
        groups = groups.join(again.withColumnRenamed("page_id", "first_id").hint("merge"), "first_id", "left").withColumn("first_alone", F.col("again").isNull()).drop("again")
    both = rows.join(groups.hint("merge"), "payload_key", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"), "alone", F.coalesce("first_alone", F.lit(True)).alias("first_alone"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives.

    A null html is an empty payload, a null url leaves its header out.  Of
    equal payloads the smallest id is the response; rows that repeat that very
    id with that payload are responses too.  Rows without an id revisit the
    response if there is one and are responses otherwise.  Record ids are
    unique even where page ids are null or repeated.  A task holds the
    records of one archive at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, number, partition = [], 0, 0, TaskContext.get().partitionId()
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["value"])
        for b in batches_of(batches):
            for *values, alone, first_alone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                number += 1
                held.append(record(*values, "" if alone else f"{partition}-{number}", first_alone))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield whole()
                    held, size = [], 0
        if held:
            yield whole()

    rows = with_revisits(pages, min_bytes)
    rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Read every record of the archives below ``path``, digests checked."""
    schema = arrow_schema(READ_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for headers, block in records_of(data.as_py()):
                    digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if sha1_base32(payload) != digest or len(payload) != n:
                            raise ValueError(f"{headers['WARC-Record-ID']}: payload and digest differ")
                    rows.append((_page(headers.get("X-Page-ID")), n, digest, headers["WARC-Type"], _page(headers.get("X-Refers-To-Page-ID")), headers.get("WARC-Target-URI"), headers["WARC-Record-ID"]))
                yield record_batch(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 8")
    return files.select("content").mapInArrow(read, READ_SCHEMA)


def warc_table(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back, one row per record.

    The archives stay in the shared work folder, or at ``path``.  An empty
    table gives no archive and no row.
    """
    path = path or work_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

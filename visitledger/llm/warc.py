"""WARC archives: writing them, and reading them back in byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from math import ceil
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.sources.staging import owned_path, stage

#: Equal payloads of at least this many bytes are written once.
REVISIT_BYTES = 1000
#: Bytes of a range, of which a reading task gets so many bytes together, and bytes read at a time.
RANGE_BYTES = 8 << 20
TASK_BYTES = 32 << 20
BLOCK = 1 << 18
#: Payload bytes of a batch that a reader hands on.
BATCH_BYTES = 4 << 20

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORDS = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_RECORDS_DDL = (
    "path string, offset long, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and path of a URI in a store that all executors reach."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + press.flush()


def _page_record(page: int | None, url: str | None, body: bytes, refers_to: int | None) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page}"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is None:
        return _record(headers, http + body)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _record(headers, http)


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Rows to write: page, url, body (binary), refers_to.

    Of equal bodies of at least REVISIT_BYTES the page with the largest id is the
    response and the others refer to it. Only groups of two and more are looked
    up. Smaller bodies get a key of their own, so that the many empty pages do not
    meet in one task; large groups are left to Spark's splitting of skewed joins.
    """
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), body.alias("body")
    ).withColumn("large", F.octet_length("body") >= REVISIT_BYTES)
    keyed = rows.withColumn(
        "key", F.when(F.col("large"), F.sha2("body", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page", "url").cast("string")))
    )
    groups = (
        keyed.where("large")
        .groupBy("key")
        .agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("many"))
        .where("many > 1")
        .select(F.col("key").alias("_key"), "first")
    )
    groups = stage(groups, "warc-groups")
    joined = keyed.join(groups, keyed["key"] == groups["_key"], "left")
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page", "url", "body", refers.alias("refers_to"))


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> DataFrame:
    """Write one record per page into archives under `folder`; returns path and size of each.

    Every task writes one archive, each record a gzip member. An attempt has a
    file name of its own and the returned table, which is stored, names those of
    the attempts that counted; so a task that is repeated does no harm.

    Null bodies are empty, null urls are written as `urn:page:<id>`, a null id as
    "null". Rows with the largest id of a group that repeat are all responses. An
    empty table gives no archives.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out, path = None, f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, place = _place(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place, compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", DATE)]
                    out.write(_record(info, b"format: WARC File Format 1.1\r\n"))
                out.write(_page_record(row["page"], row["url"], row["body"], row["refers_to"]))
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    rows = plan_revisits(pages, id_col, url_col, body_col)
    return stage(rows.mapInArrow(work, "path string, size long"), "warc-files")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Path and size of the archives under any folder that Spark can list."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz")
    return found.load(folder).select("path", F.col("length").alias("size"))


class _Bytes:
    """A file read block by block, as far ahead as someone asks."""

    def __init__(self, file: pa.NativeFile, start: int) -> None:
        self.file, self.start, self.size = file, start, file.size()
        self.data = bytearray()

    def drop_before(self, at: int) -> None:
        if at - self.start >= BLOCK:
            del self.data[: at - self.start]
            self.start = at

    def more(self) -> bool:
        at = self.start + len(self.data)
        block = self.file.read_at(min(BLOCK, self.size - at), at) if at < self.size else b""
        self.data += block
        return bool(block)

    def chunks(self, at: int) -> Iterator[bytes]:
        while True:
            if at >= self.start + len(self.data) and not self.more():
                return
            block = bytes(self.data[at - self.start : at - self.start + BLOCK])
            at += len(block)
            yield block


def _member(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The decoded record that starts at `at` and its length in the file; None if none does.

    It has to begin like a WARC record, decode to its end with the right checksum
    and be followed by another gzip member or the end of the file.
    """
    press, parts, got, used = zlib.decompressobj(31), [], 0, 0
    try:
        for block in source.chunks(at):
            part = press.decompress(block)
            parts.append(part)
            got += len(part)
            used += len(block) - len(press.unused_data)
            if got >= 7 and parts and not b"".join(parts[:2])[:7].startswith(b"WARC/1."):
                return None
            if press.eof:
                break
    except zlib.error:
        return None
    if not press.eof or got < 7:
        return None
    after = b""
    for block in source.chunks(at + used):
        after += block
        if len(after) >= len(MAGIC):
            break
    if after and not MAGIC.startswith(after[: len(MAGIC)]):
        return None
    return b"".join(parts), used


def _parsed(record: bytes) -> dict | None:
    """The fields of a record; None if its header does not fit its length."""
    head, split, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not split or not length.isdigit() or len(rest) != int(length) + 4:
        return None
    block = rest[: int(length)]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        size = int(stated[1]) if stated else len(payload)
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_digest": digest or None,
        "payload_bytes": size,
        "payload": payload,
    }


def range_records(path: str, start: int, end: int) -> Iterator[dict]:
    """The records that start in bytes `start` to `end` of an archive.

    Gzip magic is looked for; a candidate counts if it decodes as a WARC record.
    After a record the search goes on behind it, however far into the next range
    it reaches.
    """
    store, place = _place(path)
    with store.open_input_file(place) as file:
        source, at = _Bytes(file, start), start
        while at < end:
            found = source.data.find(MAGIC, at - source.start)
            if found < 0:
                at = max(at, source.start + len(source.data) - len(MAGIC) + 1)
                source.drop_before(at)
                if not source.more():
                    return
                continue
            if source.start + found >= end:
                return
            at = source.start + found
            member = _member(source, at)
            fields = member and _parsed(member[0])
            if not fields:
                at += 1
                continue
            yield {"path": path, "offset": at} | fields
            at += member[1]
            source.drop_before(at)


def read_warc(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of `archives` (path, size), one row each.

    Columns path, offset, record_type, record_id, target_uri, refers_to,
    payload_digest (hex), payload_bytes (of the full payload, for revisits as
    stated) and payload. Archives are cut into byte ranges, so one large archive
    is read by many tasks; a record belongs to the range it starts in. Whatever
    is not a WARC record is passed over. No archives give an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for record in range_records(row["path"], row["start"], row["end"]):
                    rows.append(record)
                    size += len(record["payload"])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = archives.where("size > 0").select("path", "size", starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("size"), F.col("start") + range_bytes).alias("end"))
    size = archives.agg(F.sum("size"), F.sum(F.ceil(F.col("size") / range_bytes))).first()
    tasks = max(ceil((size[0] or 0) / TASK_BYTES), min(size[1] or 1, archives.sparkSession.sparkContext.defaultParallelism))
    # a stated count: adaptive execution would merge these few small rows into one task
    return ranges.repartition(tasks, "path", "start").mapInArrow(work, _RECORDS_DDL)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` to archives under `folder` and read their records back."""
    folder = folder or owned_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder))

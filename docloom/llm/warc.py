"""WARC archives: one gzip member a record, and a reader that splits files.

Writing.  Rows are keyed by payload digest (tiny payloads by themselves); of equal payloads the
row with the least id is written whole (``response``), the others as ``revisit`` records that name
it and repeat its digest and length, without the payload.  Every task writes one file of its
own, under a name no other attempt bears, and returns its name and size; readers take the
names from that list, so what a lost attempt leaves behind is never read.

Reading.  A file is cut into byte ranges, and each range is a task's row.  A task looks for the
gzip magic from its range's start, tries each place by decoding a few bytes of the member, which
must begin with a WARC version line, and then the whole member, whose checksum must hold.  It owns
the records that start inside its range and reads on past the end to finish the last.  A payload
may itself hold archives, and a range may begin inside it; such finds are told by their offsets:
what starts before an earlier record of its file ends is part of that record (``owned``).

Files are opened through ``pyarrow.fs`` by URI, so the folder may be any store it knows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import stage, stage_path

REVISIT_BYTES = 100
RANGE_BYTES = 8 << 20
MAX_TASKS = 100_000  # beyond it a task reads several ranges
_BLOCK = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace(":/", ":///", 1))


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    data = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _clean(value: str) -> str:
    """A header value is one line."""
    return re.sub(r"[\r\n]+", " ", value)


def page_record(name: str, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """``response`` with its payload, or ``revisit`` with the headers only."""
    kind = "revisit" if refers_to is not None else "response"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", _DATE)]
    if url:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record(fields, http if refers_to is not None else http + (payload or b""))


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name = f"{path}/pages-{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                data = page_record(row["name"], row["url"], row["payload"], row["digest"], row["size"], row["refers_to"])
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "size", "records"]
            )

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write (id long, url, payload binary) rows; returns the folder and the list (path, size, records).

    Rows of equal payloads of at least ``REVISIT_BYTES`` bytes: the least id is the response, all
    others revisit it.  A null payload is empty.  A null id is written as a response of its own, as
    nothing can name it; rows that repeat the least id with that payload are responses too.
    """
    spark = pages.sparkSession
    folder = folder or stage_path(spark, "warc")
    payload = F.coalesce("payload", F.lit(b""))
    digest, size = F.sha2(payload, 256), F.octet_length(payload).cast("long")
    shared = (size >= REVISIT_BYTES) & F.col("id").isNotNull()
    # rows that cannot be shared get a key of their own, so they are no hot group
    alone = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.substring(digest, 1, 16))
    keyed = pages.select("id", "url", payload.alias("payload"), digest.alias("digest"), size.alias("size"), F.when(shared, digest).otherwise(alone).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"))
    rows = keyed.join(firsts, "key").select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("name"), "url",
        F.when(F.col("id").eqNullSafe(F.col("first")), F.col("payload")).alias("payload"), "digest", "size",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"),
    )
    return folder, stage(rows.mapInArrow(_written(folder), "path string, size long, records long"), "warc-files")


class _Window:
    """Bytes of a file from an offset on, read block by block and dropped as the reader moves on."""

    def __init__(self, source, size: int, start: int):
        self.source, self.size, self.start, self.data = source, size, start, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes at an offset (fewer at the end of the file)."""
        if at < self.start or at > self.start + len(self.data):
            self.start, self.data = at, b""
        need = min(at + n, self.size) - (self.start + len(self.data))
        if need > 0:
            more = self.source.read_at(min(max(need, _BLOCK), self.size - self.start - len(self.data)), self.start + len(self.data))
            self.data = self.data[max(0, at - self.start) :] + more
            self.start = max(self.start, at)
        return self.data[at - self.start : at - self.start + n]


def _starts_record(view: _Window, at: int) -> bool:
    """Whether a gzip member that begins with a WARC version line starts here."""
    head = view.bytes_at(at, 512)
    if head[:3] != _MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(view: _Window, at: int) -> tuple[bytes, int] | None:
    """A whole member's content and where it ends; None if it is damaged."""
    unpacker, parts, here = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            data = view.bytes_at(here, _BLOCK)
            if not data:
                return None
            parts.append(unpacker.decompress(data))
            here += len(data) - len(unpacker.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), here


def _next_magic(view: _Window, at: int, end: int) -> int:
    """The first magic at or after ``at`` that starts before ``end``, else ``end``."""
    while at < end:
        data = view.bytes_at(at, min(_BLOCK, end - at) + 2)
        found = data.find(_MAGIC)
        if 0 <= found and at + found < end:
            return at + found
        at += max(1, len(data) - 2)
        if not data:
            break
    return end


def records_in(source, size: int, start: int, end: int) -> list[tuple[int, int, bytes]]:
    """(offset, end, content) of the records that start in [start, end)."""
    view, out = _Window(source, size, start), []
    at = _next_magic(view, start, end)
    while at < end:
        found = _member(view, at) if _starts_record(view, at) else None
        if found is None:  # no record, or a damaged one: look on behind its first byte
            at = _next_magic(view, at + 1, end)
        else:
            out.append((at, found[1], found[0]))
            at = _next_magic(view, found[1], end)
    return out


def parsed(content: bytes) -> dict:
    """Fields of a record, its HTTP length, and its payload (None where there is no block)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {"fields": fields, "http_length": int(length[1]) if length else None, "payload": payload}


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


_RECORDS = (
    "path string, offset long, ends long, record_type string, id long, url string, refers_to long, digest string, "
    "length long, payload binary"
)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    found = records_in(source, row["size"], row["start"], row["stop"])
                for k in range(0, len(found), 256):
                    yield pa.RecordBatch.from_pylist(
                        [_row(row["path"], *one) for one in found[k : k + 256]], schema=_SCHEMA
                    )

    return run


_SCHEMA = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("ends", pa.int64()), ("record_type", pa.string()), ("id", pa.int64()),
    ("url", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("payload", pa.binary()),
])


def _row(path: str, offset: int, ends: int, content: bytes) -> dict:
    one = parsed(content)
    fields, kind = one["fields"], one["fields"].get("warc-type")
    payload = one["payload"] if kind == "response" else None
    return {
        "path": path, "offset": offset, "ends": ends, "record_type": kind, "id": _page_of(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"), "refers_to": _page_of(fields.get("warc-refers-to")),
        # what was read counts, not what the header says
        "digest": hashlib.sha256(payload).hexdigest() if payload is not None else fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        "length": len(payload) if payload is not None else one["http_length"], "payload": payload,
    }


def read_archives(files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the listed files (path, size): see ``_RECORDS``.

    Damaged members are skipped; the records around them are read.
    """
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start")).select(
        "path", "size", F.col("start").cast("long").alias("start"), F.least(F.col("start") + range_bytes, "size").cast("long").alias("stop")
    )
    # the rows are tiny, the work is not: a stated number of tasks, which adaptive execution leaves alone
    count = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    return ranges.repartition(min(int(count), MAX_TASKS)).mapInArrow(_read(folder), _RECORDS)


def owned(records: DataFrame) -> DataFrame:
    """Records without those that start inside an earlier one of their file (archives within payloads)."""
    places = records.select("path", "offset", "ends")
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    inner = places.withColumn("reach", F.max("ends").over(before)).where("offset < reach").select("path", "offset")
    return records.join(inner, ["path", "offset"], "left_anti")


def resolved(records: DataFrame) -> DataFrame:
    """Length and digest of every record's full payload: a revisit takes them from the response it names.

    Where several responses bear that id, the one with the revisit's digest is meant.  A revisit
    whose response is not among the records has neither.
    """
    wholes = records.where("record_type = 'response' and id is not null").groupBy(
        F.col("id").alias("refers_to"), F.col("digest").alias("named")
    ).agg(F.struct(F.first("digest").alias("digest"), F.first("length").alias("length")).alias("whole"))
    own = records.where("record_type = 'response'").select("id", "length", "digest", "record_type", "refers_to")
    again = records.where("record_type = 'revisit'").select(
        "id", "record_type", "refers_to", F.col("digest").alias("named")
    ).join(wholes, ["refers_to", "named"], "left").select(
        "id", F.col("whole.length").alias("length"), F.col("whole.digest").alias("digest"), "record_type", "refers_to"
    )
    return own.unionByName(again)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write (id, url, payload) rows and read all records back from the archives, each decoded once."""
    folder, files = write_archives(pages)
    return owned(stage(read_archives(files, folder), "warc-records"))

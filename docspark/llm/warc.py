"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Each record is a gzip member of its own. The reader's tasks get byte ranges of the archives. A task looks for gzip's magic
number in its range, takes a place as a record if the member decodes to a WARC record with a sound header, length and
checksum, and if a member or the end follows; it owns the records that start inside its range and reads the last one to
its end. Records that follow one another are read without a search.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.cluster import ship
from docspark.llm.common import Tables, scratch, stored, texts_of

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one task reads, of an archive at most (about), and of a read.
SPLIT_BYTES, FILE_BYTES, PIECE = 8 << 20, 1 << 30, 1 << 14
LEVEL = 1
#: Payloads of fewer bytes are stored each time.
LEAST_BYTES = 0
#: Digests that occur twice or more, of about 60 bytes each, are broadcast up to this number; else joined by shuffle.
BROADCAST_ROWS = 300_000
#: Bytes of a record's header, at most, and bytes that are unpacked at once.
HEAD_BYTES, MOST_UNPACKED = 1 << 20, 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record without the payload; gzipped."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {len(payload)}"]
    block = HTTP + payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = HTTP
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Archives of pages(page_id, url, html) in a shared folder, and the stored table of them: path, bytes, records.

    Of records with equal payloads of at least `least` bytes the one with the smallest page_id is the response, and the
    others revisit it. A null html is an empty payload. A null page_id is written as `null` and revisits a page that has
    an id; without one it is a response. Rows that repeat the smallest id are responses all. Other columns are not read.
    An empty table gives no archive. A task that is run again writes new files; only those of the successful run are in
    the table, and the others go when the folder goes.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    tables = Tables(spark)
    first = tables.stored(own.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha1", "first"), "digests")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first.hint("merge")
    rows = own.join(first, "sha1", "left").select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        path, out, size, records = "", None, 0, 0
        done = []
        for batch in batches:
            ids, urls, sha1, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for i, payload in enumerate(texts_of(batch.column(2))):
                if out is None:
                    where.create_dir(base, recursive=True)
                    path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(path, compression=None)
                name = "null" if ids[i] is None else str(ids[i])
                data = record(name, urls[i], payload, base64.b32encode(bytes.fromhex(sha1[i])).decode(), None if refers[i] is None else str(refers[i]))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        if done:
            name = folder.rstrip("/")
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{p.rpartition('/')[2]}" for p, _, _ in done]), pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64())], ["path", "bytes", "records"])

    ship(spark)
    with tables:
        return stored(rows.mapInArrow(put, "path string, bytes long, records long"), "archives")


class Range:
    """A byte range of an archive, read in pieces; reads may pass its end."""

    def __init__(self, source, size: int, start: int, end: int):
        self.source, self.size, self.start, self.end = source, size, start, min(end, size)
        source.seek(start)
        self.data = source.read(self.end - start)
        self.at = start  # of data

    def bytes(self, at: int, n: int) -> bytes:
        lo = at - self.at
        if at + n > self.at + len(self.data) and self.at + len(self.data) < self.size:
            self.source.seek(self.at + len(self.data))
            self.data += self.source.read(max(n, 1 << 20))
        return self.data[lo : lo + n]

    def head(self, at: int) -> bool:
        """Whether a member at a place begins like a record."""
        try:
            return self.bytes(at, 3) == MAGIC and zlib.decompressobj(31).decompress(self.bytes(at, PIECE), 7) == b"WARC/1."
        except zlib.error:
            return False

    def record(self, at: int, searched: bool) -> tuple[dict[str, str], bytes, int] | None:
        """Header, block and end of the record at a place. searched: it was not reached from a record before it.

        A member is unpacked by pieces, and no further than its header says that its block is long.
        """
        if not self.head(at):
            return None
        z, content, pos, header, least = zlib.decompressobj(31), bytearray(), at, None, 0
        try:
            while not z.eof:
                piece = z.unconsumed_tail or self.bytes(pos, PIECE)
                if not z.unconsumed_tail:
                    pos += len(piece)
                if not piece:
                    return None
                content += z.decompress(piece, MOST_UNPACKED)
                if header is None:
                    mark = content.find(b"\r\n\r\n")
                    if mark < 0 and len(content) > HEAD_BYTES:
                        return None
                    if mark >= 0:
                        lines = content[:mark].decode("utf-8", "replace").split("\r\n")
                        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                        if not header.get("content-length", "").isdigit():
                            return None
                        least = mark + 4 + int(header["content-length"])
                if header is not None and len(content) > least + 4:
                    return None
        except zlib.error:
            return None
        if header is None or len(content) != least + 4 or content[least:] != b"\r\n\r\n":
            return None
        end = pos - len(z.unused_data)
        if searched and end < self.size and not self.head(end):
            return None
        return header, bytes(content[mark + 4 : least]), end

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        at, searched = self.start, self.start > 0
        while at < self.end:
            found = self.record(at, searched)
            if found:
                header, block, at = found
                searched = False
                yield header, block
                continue
            searched = True
            while True:  # a magic number may lie across the range's end
                k = self.data.find(MAGIC, at + 1 - self.at)
                if k >= 0 or len(self.data) >= min(self.end + 2, self.size) - self.at:
                    break
                if not self.bytes(self.at + len(self.data), 1):
                    break
            at = self.at + k if k >= 0 else self.end


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, record_id string"
_PAGE = re.compile(r"<urn:page:(-?[0-9]{1,19})>")


def _fields(path: str, header: dict[str, str], block: bytes, payloads: bool) -> tuple | None:
    """A row of SCHEMA for a record; None for one that holds no page (warcinfo, request, metadata and the like)."""
    kind = header.get("warc-type", "").lower()
    if kind not in ("response", "resource", "revisit"):
        return None
    page = lambda urn: int(m[1]) if (m := _PAGE.fullmatch(urn or "")) else None
    stated, text = header.get("warc-payload-digest", ""), None
    sha1 = stated[5:].upper() if stated.lower().startswith("sha1:") else None
    if sha1 and re.fullmatch("[0-9A-F]{40}", sha1):
        sha1 = base64.b32encode(bytes.fromhex(sha1)).decode()
    size = header.get("warc-payload-length", "")
    n = int(size) if size.isdigit() else None
    if kind != "revisit":
        http = header.get("content-type", "").lower().startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        own = digest(payload)
        if (sha1 or own) != own or (len(payload) if n is None else n) != len(payload):
            raise ValueError(f"{path}: {header.get('warc-record-id')} does not meet its digest")
        n, sha1 = len(payload), own
        text = payload.decode("utf-8", "replace") if payloads else None
    return page(header.get("warc-record-id")), header.get("warc-target-uri"), "revisit" if kind == "revisit" else "response", page(header.get("warc-refers-to")), n, sha1, text, header.get("warc-record-id")


def read(archives: DataFrame, payloads: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives(path, bytes): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record_id.

    payload is null for revisits, or for all if payloads is False. A response whose payload does not meet its digest or
    length raises. Of archives that others wrote: records of other types than response, resource (a response here) and
    revisit are skipped; page_id and refers_to are null for ids that are not of write()'s form; length and digest are taken
    from the payload, and for revisits from the header, null where it has none; bytes that are not UTF-8 are replaced; a
    member that is no record is passed over. An archive of 0 bytes has no records. The number of ranges, not of records,
    is what the driver counts.
    """
    spark = archives.sparkSession
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("start"))
    many = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split)), F.lit(0)).alias("n")).first().n

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "record_id"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                rows, room = [], 0
                with where.open_input_file(name) as source:
                    for header, block in Range(source, size, start, start + split).records():
                        row = _fields(path, header, block, payloads)
                        if row is None:
                            continue
                        rows.append(row)
                        room += len(block) if payloads else 0
                        if len(rows) == 4096 or room > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, room = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ship(spark)
    return ranges.repartition(max(1, int(many))).mapInArrow(get, SCHEMA)


def archive(spark: SparkSession, pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages written to new archives in the shared folder; path, bytes and records of each."""
    return write(pages, scratch(spark, "warc"), least)

"""Web archives packaged in ZIP files: written by Spark tasks, read by directory and byte range.

A package holds one stored member ``archive/data.warc.gz`` (one gzip member per WARC record) and one stored member
``indexes/index.cdxj`` with the offset and length of each record. The reader parses the end record, the ZIP64 records
and the central directory, finds the stored members and reads single records by range; nothing is unpacked.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.lookup import fits_broadcast
from gridloom.session import cut_lineage, scratch_path

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64_000_000
RECORDS_AT_ONCE = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Signatures and the marker for sizes kept in the ZIP64 records.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header begins


def open_store(path: str):
    """(file system, path in it) for a path or URI that Arrow's file systems know: local, HDFS, S3 and others."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def members(source) -> list[Member]:
    """The entries of the central directory of an open file, in its order; of any size, with any comment at the end."""
    size = source.size()
    tail_at = max(0, size - 22 - _FULL16)
    tail = source.read_at(size - tail_at, tail_at)
    at = len(tail) - 22
    while at >= 0 and not (tail[at : at + 4] == _END and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at = tail.rfind(_END, 0, at + 3)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= 20:
        locator = source.read_at(20, end_at - 20)
        if locator[:4] == _LOCATOR64 and (count == _FULL16 or length == _FULL32 or begin == _FULL32):
            record = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if record[:4] != _END64:
                raise ValueError("broken ZIP64 end record")
            count, length, begin = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = source.read_at(length, begin), 0, []
    for _ in range(count):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full = struct.unpack_from("<II", directory, at + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8")
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        wide = _extra64(extra)
        if full == _FULL32:
            wide = wide[8:]
        if packed == _FULL32:
            packed, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        if header == _FULL32:
            header = struct.unpack_from("<Q", wide)[0]
        found.append(Member(name, method, packed, header))
        at += 46 + name_n + extra_n + comment_n
    return found


def _extra64(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return extra[at + 4 : at + 4 + n]
        at += 4 + n
    return b""


def data_offset(source, member: Member) -> int:
    """Where the bytes of a stored member begin. Only stored members can be read by range."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed by the package; only stored members are read by range")
    local = source.read_at(30, member.header)
    if local[:4] != _LOCAL:
        raise ValueError("broken local header")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_n + extra_n


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit that keeps the HTTP header of it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> dict:
    """The fields of one unpacked record. The payload of a response is digested anew and must match its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_headers(http)["content-length"])
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError("payload does not match its digest")
    return {
        "page_id": _key(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _key(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }


def _key(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


class _Package:
    """Writes one package; records are streamed, only the index is kept until the end."""

    def __init__(self, folder: str, name: str):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        self.path, self.records, self.at, self.index = f"{folder}/{name}", 0, 0, []
        self.sink = store.open_output_stream(f"{root}/{name}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True)

    def add(self, raw: bytes, page_id: int | None, digest: str) -> None:
        packed = gzip.compress(raw, compresslevel=1, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"page": page_id, "digest": digest, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return self.path, self.records, self.at


def _originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, original): for each payload that several pages share, the largest page key. Only digests are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sums = pages.where(F.length(payload) >= least_bytes).select("page_id", F.sha1(payload).alias("digest"))
    grouped = sums.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original"))
    return grouped.where((F.col("n") > 1) & F.col("original").isNotNull()).select("digest", "original")


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per page into packages under ``folder``; returns the manifest (path, records, bytes), written.

    Needs the columns page_id, url and html. Of the pages whose payload (null: empty) is equal and has at least
    ``least_bytes`` bytes, the one with the largest page_id is a response, and so are all rows that repeat that page_id; the
    others are revisits of it. Payloads of rows without any page_id are all responses. Each attempt of a task writes files
    of its own; the manifest lists those of the attempts that counted, so lost executors leave no trace in it.
    """
    originals = cut_lineage(_originals(pages, least_bytes))
    small = fits_broadcast(originals)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    chosen = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    joined = chosen.join(F.broadcast(originals) if small else originals, "digest", "left").select("page_id", "url", "html", "original")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    body = (row["html"] or "").encode("utf-8", "surrogatepass")
                    again = row["original"] is not None and row["page_id"] != row["original"]
                    package = package or _Package(folder, f"part-{uuid.uuid4().hex}.wacz")
                    package.add(record(row["page_id"], row["url"], body, row["original"], again), row["page_id"], payload_digest(body))
                    if package.at >= package_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]},
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut_lineage(joined.mapInArrow(write, "path string, records long, bytes long"))


def read_packages(manifest: DataFrame, payloads: bool = False, at_once: int = RECORDS_AT_ONCE) -> DataFrame:
    """One row per record of the packages in ``manifest`` (column path), read by range through their indexes.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and payload (of responses) if asked for.
    Indexes are cut into ranges of ``at_once`` records, which are dealt out evenly, so a large package is read by many tasks.
    """

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = open_store(path)
                with store.open_input_file(where) as source:
                    found = {m.name: m for m in members(source)}
                    begin = data_offset(source, found[DATA_MEMBER])
                    index = source.read_at(found[INDEX_MEMBER].size, data_offset(source, found[INDEX_MEMBER])).decode()
                lines = [json.loads(x) for x in index.split("\n") if x]
                cuts = range(0, len(lines), at_once)
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(cuts),
                    "offsets": [[begin + x["offset"] for x in lines[c : c + at_once]] for c in cuts],
                    "lengths": [[x["length"] for x in lines[c : c + at_once]] for c in cuts],
                }, schema=pa.schema([("path", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]))

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, where = open_store(row["path"])
                found = []
                with store.open_input_file(where) as source:
                    for offset, length in zip(row["offsets"], row["lengths"], strict=True):
                        parsed = parse_record(gzip.decompress(source.read_at(length, offset)))
                        found.append({n: parsed[n] for n in names})
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    dealt = manifest.select("path").repartition(tasks, "path").mapInArrow(ranges, "path string, offsets array<long>, lengths array<long>")
    schema = ", ".join(f"{n} {({'payload': 'binary'} | dict.fromkeys(('page_id', 'payload_bytes', 'refers_to'), 'long')).get(n, 'string')}" for n in names)
    return dealt.repartition(F.xxhash64("path", F.element_at("offsets", 1))).mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the pages into packages (in the shared folder unless one is named) and read every record back.

    One row per input row; null html is an empty payload, null page_id and url stay null; an empty table gives none.
    """
    folder = folder or scratch_path(pages.sparkSession, "packages")
    return read_packages(write_packages(pages, folder, least_bytes))

"""WARC records in ZIP packages, written and read by ranges without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz`` (WARC
1.1, one gzip member per record) and ``indexes/index.cdxj`` (one line per record
with its offset and length in the archive). The reader parses the end of the
package, the ZIP64 records where there are any, and the central directory; finds the stored
archives and their indexes; and reads records by their byte ranges. Archives without an index are
walked record by record.

Of pages with equal payloads (of ``min_bytes`` or more) the one with the least id
is a response and the others are revisits that refer to it.

Scaling: the payloads are shuffled once, dealt by digest and a salt, so that a
payload shared by a third of all pages is spread; each task streams into packages of about
``package_bytes``; reading is one task per package, in windows of a few MB.

Defined cases: a null payload counts as empty; a page without id is always a response and has a null id
when read; rows that repeat the least id are responses too; a null url has no target header;
an empty table gives no packages; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyst.llm.common import new_folder, per_key, written
from tabulyst.llm.files import create, own_name, reader

DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
WINDOW = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail not in ("", "none") else None


def record(page, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) leaves the payload out and keeps its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha1:" + payload_digest(payload)))
    if refers_to is not None:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"record {fields['warc-record-id']}: payload differs from its digest")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
            "payload_bytes": len(payload) if kind == "response" else int(said["content-length"]), "refers_to": _page(fields.get("warc-refers-to")),
            "payload": payload if kind == "response" else None}


class Package:
    """Writes one ZIP package."""

    def __init__(self, path: str, level: int):
        self.out = create(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.level, self.at, self.lines = level, 0, []

    def add(self, page, url, payload: bytes, refers_to):
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        raw = packer.compress(record(page, url, payload, refers_to)) + packer.flush()
        self.member.write(raw)
        entry = {"offset": self.at, "length": len(raw), "type": "response" if refers_to is None else "revisit"}
        self.lines.append(f"{_urn(page)} {DATE} {json.dumps(entry)}\n")
        self.at += len(raw)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.out.close()
        return len(self.lines)


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    packed: int
    size: int
    header: int


def _at(file, offset: int, n: int) -> bytes:
    file.seek(offset)
    return file.read(n)


def directory(file, size: int) -> Iterator[Member]:
    """Members by the central directory, through the ZIP64 records where the short fields are full."""
    tail_at = max(0, size - 65_557)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # these bytes stood in the comment
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = _at(file, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        big = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", big, 32)
    at, stop, held, base = start, start + length, b"", start
    for _ in range(count):
        need = 46
        for _ in range(2):  # the fixed part tells how long the whole is
            if at + need > base + len(held):
                base, held = at, _at(file, at, min(stop - at, max(need, 1 << 16)))
            fixed = struct.unpack_from("<4s6H3L5H2L", held, at - base)
            need = 46 + fixed[10] + fixed[11] + fixed[12]
        if fixed[0] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method, packed, full, header = fixed[3], fixed[4], fixed[8], fixed[9], fixed[16]
        body = at - base + 46
        name = held[body: body + fixed[10]].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = held[body + fixed[10]: body + fixed[10] + fixed[11]], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # holds, in this order, those fields that are full
                j = k + 4
                values = []
                for v in (full, packed, header):
                    if v == 0xFFFFFFFF:
                        v, j = struct.unpack_from("<Q", extra, j)[0], j + 8
                    values.append(v)
                full, packed, header = values
            k += 4 + n
        yield Member(name, method, flags, packed, full, header)
        at += need


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin; its local header may have other extra fields than the directory."""
    if member.method or member.flags & 1:
        raise ValueError(f"{member.name} is not stored plainly")
    local = _at(file, member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    names, extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + names + extra


def _inflate(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


def indexed(file, start: int, index: bytes) -> Iterator[bytes]:
    """Records by the index's ranges, in windows of WINDOW bytes."""
    held, base = b"", 0
    for line in index.decode().splitlines():
        entry = json.loads(line[line.index("{"):])
        a, n = start + entry["offset"], entry["length"]
        if a < base or a + n > base + len(held):
            base, held = a, _at(file, a, max(n, WINDOW))
        yield _inflate(held[a - base: a - base + n])


def walked(file, start: int, size: int) -> Iterator[bytes]:
    """Records of an archive without index, one gzip member after the other."""
    at, rest = start, b""
    while at < start + size or rest:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = _at(file, at, min(WINDOW, start + size - at))
                at += len(rest)
                if not rest:
                    raise ValueError("archive ends inside a record")
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def records(path: str) -> Iterator[dict]:
    """All records of all stored archives in a package."""
    with reader(path) as file:
        members = list(directory(file, file.size()))
        indexes = [m for m in members if m.name.startswith("indexes/") and m.name.endswith(".cdxj") and not m.method]
        archives = [m for m in members if m.name.startswith("archive/") and m.name.endswith(".warc.gz")]
        for m in archives:
            start = data_start(file, m)
            if len(archives) == 1 and len(indexes) == 1:
                at = data_start(file, indexes[0])
                raws = indexed(file, start, _at(file, at, indexes[0].size))
            else:
                raws = walked(file, start, m.size)
            for raw in raws:
                yield parse(raw)


def write_packages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
                   package_bytes: int = 256 << 20, package_records: int = 50_000, level: int = 1) -> DataFrame:
    """Write ``pages`` as packages; manifest ``path, records``."""
    folder = new_folder(pages.sparkSession, "warc-packages")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, path = None, ""

        def done():
            return pa.record_batch([pa.array([path]), pa.array([package.close()], pa.int64())], ["path", "records"])

        for b in batches:
            for page, where, payload, refers in zip(b.column("page").to_pylist(), b.column("url").to_pylist(), b.column("payload"), b.column("refers_to").to_pylist()):
                if package is None:
                    path = own_name(folder, ".zip")
                    package = Package(path, level)
                package.add(page, where, payload.as_py(), refers)
                if package.at >= package_bytes or len(package.lines) >= package_records:
                    yield done()
                    package = None
        if package is not None:
            yield done()

    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    rows = per_key(rows, ["digest"], F.col("page"), {"least": F.min("page")}, {"least": F.min("least")})
    again = (F.length("payload") >= min_bytes) & (F.col("page") != F.col("least"))
    rows = rows.select("page", "url", "payload", F.when(again, F.col("least")).alias("refers_to"))
    return written(rows.mapInArrow(save, "path string, records long"), "warc-manifest")


def read_packages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """``page_id, url, record_type, payload_digest, payload_bytes, refers_to`` and, if wanted, ``payload`` of every record."""
    fields = [("page_id", "long"), ("url", "string"), ("record_type", "string"), ("payload_digest", "string"), ("payload_bytes", "long"), ("refers_to", "long")]
    fields += [("payload", "binary")] * payload
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            return pa.record_batch([pa.array([r[n] for r in held], kinds[k]) for n, k in fields], [n for n, _ in fields])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                held = []
                for r in records(path):
                    held.append(r if payload else r | {"payload": None})
                    if len(held) == (64 if payload else 4096):
                        yield flush(held)
                        held = []
                if held:
                    yield flush(held)

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(load, ", ".join(f"{n} {k}" for n, k in fields))

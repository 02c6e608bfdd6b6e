"""WARC archives in ZIP packages: written by Spark tasks, read record by record without extraction.

A package is a ZIP file of stored (uncompressed) members: `archive/data.warc.gz`, in which every record is a gzip
member of its own, `indexes/index.cdxj`, one line per record with its place and length, and `datapackage.json`.
The reader finds the end-of-central-directory record from the end of the file, follows ZIP64 records where counts,
sizes or places need them, takes each member's place from its local header, reads the index and then reads
exactly the bytes of each record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import frugal
from siltstone.llm.storage import filesystem, worker_folder, written

#: Fixed values of the ZIP format: signatures and layouts of its records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
_END64, _LOCATOR64 = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of records after which a task goes on in another package.
PACKAGE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """The bytes are not a package of this form."""


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipWriter:
    """Stored members, streamed; ZIP64 records where a number does not fit, or for every number if always64."""

    def __init__(self, out, always64: bool = False):
        self.out, self.at, self.always64 = out, 0, always64
        self.entries: list[tuple[bytes, int, int, int]] = []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def member(self, name: str, chunks: Iterator[bytes], size: int, crc: int) -> int:
        """Write a member and return the place of its first byte; size and crc are those of all chunks."""
        raw_name, header = name.encode(), self.at
        wide = self.always64 or size >= _FULL32
        extra = struct.pack("<2H2Q", 1, 16, size, size) if wide else b""
        short = _FULL32 if wide else size
        self._write(_LOCAL.pack(LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw_name), len(extra)))
        self._write(raw_name + extra)
        data = self.at
        for c in chunks:
            self._write(c)
        if self.at - data != size:
            raise BadArchive(f"{name}: {self.at - data} bytes written, {size} announced")
        self.entries.append((raw_name, size, crc, header))
        return data

    def close(self) -> None:
        begin = self.at
        for name, size, crc, header in self.entries:
            wide = [x for x in (size, size, header) if self.always64 or x >= _FULL32]
            extra = struct.pack(f"<2H{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            cut = [_FULL32 if self.always64 or x >= _FULL32 else x for x in (size, size, header)]
            self._write(_CENTRAL.pack(CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, cut[0], cut[1], len(name), len(extra), 0, 0, 0, 0, cut[2]))
            self._write(name + extra)
        n, size = len(self.entries), self.at - begin
        if self.always64 or n >= _FULL16 or size >= _FULL32 or begin >= _FULL32:
            end64 = self.at
            self._write(_END64.pack(END64, _END64.size - 12, 45, 45, 0, 0, n, n, size, begin))
            self._write(_LOCATOR64.pack(LOCATOR64, 0, end64, 1))
        short = lambda x, full: full if self.always64 or x >= full else x
        self._write(_END.pack(END, 0, 0, short(n, _FULL16), short(n, _FULL16), short(size, _FULL32), short(begin, _FULL32), 0))


def _read(file, at: int, n: int) -> bytes:
    file.seek(at)
    raw = file.read(n)
    if len(raw) != n:
        raise BadArchive(f"{n} bytes wanted at {at}, {len(raw)} found")
    return raw


def members(file, size: int) -> list[Member]:
    """The central directory of an open package of so many bytes."""
    tail_at = max(0, size - _END.size - _FULL16)
    tail = _read(file, tail_at, size - tail_at)
    k = tail.rfind(END)
    while k >= 0 and (k + _END.size > len(tail) or k + _END.size + _END.unpack_from(tail, k)[7] != len(tail)):
        k = tail.rfind(END, 0, k)  # the signature can also stand in the comment
    if k < 0:
        raise BadArchive("no end of central directory")
    _, disk, first_disk, _, n, length, begin, _ = _END.unpack_from(tail, k)
    at = tail_at + k
    if at >= _LOCATOR64.size:
        sign, _, end64, disks = _LOCATOR64.unpack(_read(file, at - _LOCATOR64.size, _LOCATOR64.size))
        if sign == LOCATOR64:
            sign, _, _, _, disk, first_disk, _, n, length, begin = _END64.unpack(_read(file, end64, _END64.size))
            if sign != END64 or disks > 1:
                raise BadArchive("bad ZIP64 end of central directory")
    if disk or first_disk:
        raise BadArchive("an archive of several disks")
    raw, at, out = _read(file, begin, length), 0, []
    for _ in range(n):
        if len(raw) < at + _CENTRAL.size or raw[at : at + 4] != CENTRAL:
            raise BadArchive("bad central directory entry")
        f = _CENTRAL.unpack_from(raw, at)
        method, packed, full, n_name, n_extra, n_comment, header = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name_at = at + _CENTRAL.size
        name = raw[name_at : name_at + n_name].decode("utf-8" if f[3] & 0x800 else "cp437")
        extra = raw[name_at + n_name : name_at + n_name + n_extra]
        while len(extra) >= 4:
            kind, m = struct.unpack_from("<2H", extra)
            if kind == 1:  # ZIP64: only the numbers that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                full = next(wide) if full == _FULL32 else full
                packed = next(wide) if packed == _FULL32 else packed
                header = next(wide) if header == _FULL32 else header
            extra = extra[4 + m :]
        out.append(Member(name, method, packed, header))
        at = name_at + n_name + n_extra + n_comment
    return out


def data_place(file, member: Member) -> int:
    """Where a stored member's bytes begin: its local header can have other extra fields than the directory."""
    if member.method != 0:
        raise BadArchive(f"{member.name} is not stored")
    f = _LOCAL.unpack(_read(file, member.header, _LOCAL.size))
    if f[0] != LOCAL:
        raise BadArchive(f"{member.name}: no local header")
    return member.header + _LOCAL.size + f[9] + f[10]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (lower-case names) and payload of one gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise BadArchive("not a WARC/1.1 record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise BadArchive("a record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return fields, found, payload


def _line(text: str | None) -> str:
    """A header value: line breaks and other controls are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


class Package:
    """One package under a name of its own; records go to a side file first, since a ZIP header needs their size."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}-{os.urandom(6).hex()}.wacz"
        self.side = self.fs.open_output_stream(self.path + ".data")
        self.size = self.crc = 0
        self.index: list[str] = []

    def add(self, page_id: int | None, url: str | None, raw: bytes, kind: str) -> None:
        self.side.write(raw)
        self.index.append(json.dumps({"page_id": page_id, "url": url, "type": kind, "offset": self.size, "length": len(raw)}))
        self.size += len(raw)
        self.crc = zlib.crc32(raw, self.crc)

    def close(self) -> str:
        self.side.close()

        def chunks(stream) -> Iterator[bytes]:
            while chunk := stream.read(1 << 20):
                yield chunk

        with self.fs.open_output_stream(self.path) as out, self.fs.open_input_stream(self.path + ".data") as side:
            z = ZipWriter(out)
            z.member(DATA, chunks(side), self.size, self.crc)
            about = json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": self.size}]})
            for name, text in ((INDEX, "".join(f"{x}\n" for x in self.index)), (PACKAGE, about)):
                raw = text.encode()
                z.member(name, iter([raw]), len(raw), zlib.crc32(raw))
            z.close()
        self.fs.delete_file(self.path + ".data")
        return self.path


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the manifest: folder, path, n_records.

    Of the records with equal payloads of at least least_bytes, that with the largest page_id is the response and the
    others revisit it. A null html is an empty payload; a null page_id counts as the smallest; an empty table gives an empty manifest. Of rows that share the
    largest page_id and the payload the one of the last url is the response and the others revisit it, by its page_id. Packages hold
    package_bytes and a record at most, however much a task is given. Only packages that the manifest names count, so
    attempts of lost executors leave nothing that is read.
    """
    folder = worker_folder(pages.sparkSession, "warc", folder)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    key = ["n", "sha", "x"]
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html"), "x": F.xxhash64("html")})
    # Payloads are equal if length, SHA-1 and a second hash are. What is best is written before it is joined, without any html, so that
    # a payload which many pages have can be split between tasks.
    same = rows.groupBy(*key, "page_id", "url").agg(F.count("*").alias("rows"))
    best = same.groupBy(*key).agg(F.max(F.struct("page_id", "url", "rows")).alias("best"), F.sum("rows").alias("copies")).where(f"copies > 1 and n >= {int(least_bytes)}")
    best = written(best.drop("copies"), "warc-best")
    tied = F.coalesce(F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url")) & F.col("best").isNotNull(), F.lit(False))
    every = rows.join(best, key, "left").withColumns({"tied": tied, "refers_to": F.col("best.page_id")})
    columns = ["page_id", "url", "html", "refers_to", "response"]
    joined = every.where(~F.col("tied") | (F.col("best.rows") == 1)).withColumn("response", F.col("best").isNull() | F.col("tied")).select(columns)
    if best.where("best.rows > 1").limit(1).count():
        # Rows that agree in everything are one text so many times: the first is the response.
        one = every.where(F.col("tied") & (F.col("best.rows") > 1)).groupBy(*key, "page_id", "url", "refers_to").agg(F.first("html").alias("html"), F.count("*").alias("rows"))
        joined = joined.unionByName(one.select("page_id", "url", "html", "refers_to", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "rows"), lambda i: i == 1)).alias("response")))
    joined = joined.withColumn("part", F.spark_partition_id())

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, files = None, 0

        def named() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [out.close()], "n_records": pa.array([len(out.index)], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to, response, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or Package(folder, f"pages-{part:06d}-{files:06d}")
                body = html.encode()
                kind = "response" if response else "revisit"
                uri = _line(url)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(body)}"), ("Content-Type", "application/http; msgtype=response")]
                if not response:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
                    body = b""
                out.add(page_id, uri, record(fields, http + body), kind)
                if out.size >= package_bytes:
                    yield named()
                    out, files = None, files + 1
        if out is not None:
            yield named()

    manifest = written(joined.mapInArrow(frugal(save), "path string, n_records long"), "warc-manifest")
    return manifest.withColumn("folder", F.lit(folder))


def package_records(file, size: int) -> Iterator[tuple[dict, dict[str, str], dict[str, str], bytes]]:
    """Index entry, WARC fields, HTTP fields and payload of every record that the package's index names."""
    found = {m.name: m for m in members(file, size)}
    if DATA not in found or INDEX not in found:
        raise BadArchive("no archive or no index member")
    begin, index = data_place(file, found[DATA]), _read(file, data_place(file, found[INDEX]), found[INDEX].size)
    for line in index.decode().splitlines():
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > found[DATA].size:
            raise BadArchive("the index points beyond its archive")
        yield entry, *parse_record(_read(file, begin + entry["offset"], entry["length"]))


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits) of all records."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "None" else int(text)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                out: list[tuple] = []
                with fs.open_input_file(row["path"]) as file:
                    held = 0
                    for _, warc, http, payload in package_records(file, file.size()):
                        kind, said = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != int(http["content-length"]) or digest(payload) != said):
                            raise BadArchive(f"{row['path']}: a payload differs from its digest")
                        refers_to = number(warc["warc-refers-to"]) if kind == "revisit" else None
                        out.append((number(warc["warc-record-id"]), warc["warc-target-uri"], kind, refers_to, int(http["content-length"]), said, payload if kind == "response" else None))
                        held += len(payload)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "path").mapInArrow(load, kinds)

"""Web archives in ZIP packages: written from pages, read back by range without extraction.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member per record, and ``indexes/index.cdx``, one
line per record with its place. The reader finds the end record (ZIP64 where present), walks the central directory, locates the
stored members through their local headers, reads the index and then fetches runs of neighbouring records with one range read each.
Packages lie in the shared folder; their paths and sizes are rows of a table, so that only committed tasks count.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm.common import small_batches, table
from shelfsense.session import materialise, new_path

#: Fixed values of the ZIP format: signatures and the sizes of the fixed parts.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_U32 = 0xFFFFFFFF
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

#: A revisit replaces a payload of at least so many bytes.
MIN_REVISIT = 1000
#: A package is closed when its archive has reached this size.
PACKAGE_BYTES = 64 << 20
#: Neighbouring records that one range read fetches.
SPAN_BYTES = 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first: bool) -> bytes:
    """One WARC record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if not first:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    body = payload if first else b""
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


class Package:
    """Writes one ZIP package front to back; sizes beyond 32 bits, or ``zip64``, take the ZIP64 records."""

    def __init__(self, path: str, zip64: bool = False) -> None:
        fs, where = filesystem(path)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        self.path, self.zip64, self.out = path, zip64, fs.open_output_stream(where, compression=None)
        self.at, self.members, self.index = 0, [], []
        self._open(ARCHIVE)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _open(self, name: str) -> None:
        # Sizes follow the data (flag bit 3), since the stream cannot be rewound.
        self.name, self.header_at, self.crc, self.size = name, self.at, 0, 0
        raw = name.encode()
        self._put(_LOCAL + struct.pack("<5H3I2H", 45, 8, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> int:
        """Append to the open member; the offset within it."""
        at = self.size
        self._put(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        return at

    def _close_member(self) -> None:
        big = self.zip64 or self.size > _U32
        self._put(b"PK\x07\x08" + struct.pack("<IQQ" if big else "<III", self.crc, self.size, self.size))
        self.members.append((self.name, self.header_at, self.crc, self.size))

    def add(self, page_id: int | None, gz: bytes) -> None:
        offset = self.write(gz)
        self.index.append(json.dumps({"id": page_id, "offset": offset, "length": len(gz)}))

    def close(self) -> int:
        self._close_member()
        self._open(INDEX)
        self.write("".join(f"{line}\n" for line in self.index).encode())
        self._close_member()
        start = self.at
        for name, header_at, crc, size in self.members:
            big = self.zip64 or max(size, header_at) > _U32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header_at) if big else b""
            short = (_U32, _U32) if big else (size, header_at)
            raw = name.encode()
            self._put(
                _CENTRAL
                + struct.pack("<6H3I5H2I", 45, 45, 8, 0, 0, 33, crc, short[0], short[0], len(raw), len(extra), 0, 0, 0, 0, short[1])
                + raw
                + extra
            )
        length, n = self.at - start, len(self.members)
        big = self.zip64 or start > _U32
        if big:
            end64 = self.at
            self._put(_END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(_LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(_END + struct.pack("<4H2IH", 0, 0, n, n, length, _U32 if big else start, 0))
        self.out.close()
        return self.at


def members(file: pa.NativeFile, size: int) -> dict[str, tuple[int, int]]:
    """(offset of the data, length) of every stored member, from the central directory."""

    def at(offset: int, n: int) -> bytes:
        return file.read_at(n, offset)

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<H2I", tail, end + 10)
    locator_at = tail_at + end - 20
    if locator_at >= 0 and (locator := at(locator_at, 20))[:4] == _LOCATOR64:
        record64 = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record64[:4] != _END64:
            raise ValueError("bad ZIP64 end record")
        n, length, start = struct.unpack_from("<3Q", record64, 32)
    directory, pos, out = at(start, length), 0, {}
    for _ in range(n):
        if directory[pos : pos + 4] != _CENTRAL:
            raise ValueError("bad central directory")
        method, = struct.unpack_from("<H", directory, pos + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<2I3H", directory, pos + 20)
        header_at, = struct.unpack_from("<I", directory, pos + 42)
        name = directory[pos + 46 : pos + 46 + n_name].decode()
        extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n_field = struct.unpack_from("<2H", extra)
            if kind == 1:  # the wide values that are marked as missing, in this order
                wide = iter(struct.unpack_from(f"<{n_field // 8}Q", extra, 4))
                plain = next(wide) if plain == _U32 else plain
                packed = next(wide) if packed == _U32 else packed
                header_at = next(wide) if header_at == _U32 else header_at
            extra = extra[4 + n_field :]
        if method == 0:
            local = at(header_at, 30)
            if local[:4] != _LOCAL:
                raise ValueError("bad local header")
            out[name] = (header_at + 30 + sum(struct.unpack_from("<2H", local, 26)), packed)
        pos += 46 + n_name + n_extra + n_comment
    return out


def parse(gz: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    raw = zlib.decompress(gz, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, digest, winner) of every page: the largest page_id that has the payload; narrow rows only."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    long = narrow.where(F.col("size") >= MIN_REVISIT)
    return long.join(long.groupBy("digest").agg(F.max("page_id").alias("winner")), "digest").where("page_id < winner").select("page_id", "digest", "winner").distinct()


def write(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """One record per row of ``pages`` in packages under ``folder``; a table of (path, size, records).

    Of equal payloads of 1000 bytes or more the one with the largest page_id is a response and the others revisit it; rows
    that repeat the winning page are responses too.
    """
    later = decide(pages).select("page_id", F.col("digest").alias("_digest"), "winner")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = (
        pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("_digest"))
        .join(later, ["page_id", "_digest"], "left")
        .select("page_id", "url", "payload", "_digest", "winner")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package: Package | None = None
        closed: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, winner in zip(*(c for c in batch.columns), strict=True):
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz", zip64)
                page = page_id.as_py()
                package.add(page, record(page, url.as_py(), payload.as_py(), digest.as_py(), winner.as_py(), not winner.is_valid))
                if package.size >= package_bytes:
                    closed.append((package.path, package.close(), len(package.index)))
                    package = None
        if package:
            closed.append((package.path, package.close(), len(package.index)))
        if closed:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "size", "records"), c, strict=True)) for c in closed], schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return small_batches(rows).mapInArrow(run, "path string, size long, records long")


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def spans(packages: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """Runs of neighbouring records: (path, start, lengths), from the index of each package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = filesystem(path)
                with fs.open_input_file(where) as file:
                    found = members(file, size)
                    index_at, index_size = found[INDEX]
                    lines = file.read_at(index_size, index_at).splitlines()
                base, out, lengths, start = found[ARCHIVE][0], [], [], 0
                for line in lines:
                    entry = json.loads(line)
                    if lengths and (entry["offset"] != start + sum(lengths) or sum(lengths) >= span_bytes or len(lengths) >= 256):
                        out.append({"path": path, "start": base + start, "lengths": lengths})
                        lengths = []
                    if not lengths:
                        start = entry["offset"]
                    lengths.append(entry["length"])
                if lengths:
                    out.append({"path": path, "start": base + start, "lengths": lengths})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return packages.select("path", "size").repartition("path").mapInArrow(run, "path string, start long, lengths array<long>")


def read(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the packages. Of a response, length and digest are taken from the payload that was read and checked
    against its header; a revisit has them in its header. ``payloads`` adds the payload (null for a revisit)."""
    fields = _READ if payloads else pa.schema(list(_READ)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                fs, where = filesystem(span["path"])
                with fs.open_input_file(where) as file:
                    block = file.read_at(sum(span["lengths"]), span["start"])
                at, rows = 0, []
                for n in span["lengths"]:
                    head, body = parse(block[at : at + n])
                    at += n
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size, kind = int(head["WARC-Payload-Length"]), head["WARC-Type"]
                    if kind == "response" and (size, digest) != (len(body), hashlib.sha1(body).hexdigest()):
                        raise ValueError(f"damaged record in {span['path']}")
                    refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind, refers, body if kind == "response" else None))
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in rows], schema=fields)  # noqa: B905

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spans(packages).repartition("path", "start").mapInArrow(run, kinds + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Write ``pages`` to packages and read them back.

    Defined cases: a null html is the empty payload; a null url is empty; a null page_id is written with an empty id and comes back null
    (it never wins a group); rows that repeat a page give one record each; an empty table gives no package and no rows;
    further columns are not read.
    """
    spark = pages.sparkSession
    packages = materialise(write(pages, folder or new_path(spark, "warc")), "warc-packages")
    return read(packages, payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), payloads=False).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN winner > page_id THEN winner END AS refers_to
FROM w
"""

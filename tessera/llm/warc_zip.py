"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP archive with stored (uncompressed) members: ``archive/data.warc`` and
``indexes/index.cdx``, one line ``offset length record-id`` per record. The reader takes the end of
the archive, parses the end record (ZIP64 too) and the central directory, finds where the stored
members' bytes begin, reads the index by range, and then reads records by range.

Pages with equal payloads of at least ``min_bytes`` are written once: the one with the smallest
page_id as ``response``, the others as ``revisit`` records that name it.

Defined results: a null html is an empty payload, and equal to other empty ones. A page without id
in a group whose other pages have none either is a response. Rows that repeat the response's id are
responses too. An empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
#: Bytes of WARC data after which a task begins the next package, and of one range read.
PACKAGE_BYTES, READ_BYTES = 24_000_000, 4_000_000
#: Packages of one reading task.
PACKAGES_PER_TASK = 2


# ---------------------------------------------------------------- ZIP
class Member(NamedTuple):
    name: str
    method: int
    size: int
    start: int  # of its bytes in the archive


def _at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def directory(file, size: int) -> list[Member]:
    """Members of a ZIP archive: from its end records and central directory, by range reads."""
    tail_at = max(0, size - 66_000)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) - end < 22:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = tail[end - 20 : end]
        if end < 20 or locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        big = _at(file, struct.unpack("<Q", locator[8:16])[0], 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack("<QQQ", big[32:56])
    entries, found, p = _at(file, offset, length), [], 0
    for _ in range(count):
        if entries[p : p + 4] != b"PK\x01\x02":
            raise ValueError("central directory broken")
        flags, method = struct.unpack("<HH", entries[p + 8 : p + 12])
        packed, plain, n, m, k, disk = struct.unpack("<IIHHHH", entries[p + 20 : p + 36])
        header = struct.unpack("<I", entries[p + 42 : p + 46])[0]
        name = entries[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        wide = _zip64(entries[p + 46 + n : p + 46 + n + m])
        if plain == 0xFFFFFFFF:
            plain = wide.pop(0)
        if packed == 0xFFFFFFFF:
            packed = wide.pop(0)
        if header == 0xFFFFFFFF:
            header = wide.pop(0)
        local = _at(file, header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("local header broken")
        found.append(Member(name, method, packed, header + 30 + sum(struct.unpack("<HH", local[26:30]))))
        p += 46 + n + m + k
    return found


def _zip64(extra: bytes) -> list[int]:
    """The 64-bit numbers of the extra field 1."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[p : p + 4])
        if kind == 1:
            return [x[0] for x in struct.iter_unpack("<Q", extra[p + 4 : p + 4 + n // 8 * 8])]
        p += 4 + n
    return []


def stored(members: list[Member], name: str) -> Member:
    for m in members:
        if m.name == name:
            if m.method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} is not stored")
            return m
    raise ValueError(f"no member {name}")


# ---------------------------------------------------------------- WARC
def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, url, payload (of a revisit: none), payload_bytes, payload_digest, record_type, refers_to."""
    head, rest = data.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": said, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


# ---------------------------------------------------------------- packages
def _open(uri: str):
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages with refers_to, which is null for responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = common.columns_or_null(pages, page_id="long", url="string", html="string").withColumn("own", F.sha2(body, 256))
    long_enough = F.octet_length(body) >= min_bytes
    copies = rows.where(long_enough).groupBy("own").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("own", "first_id")
    copies = common.materialize(copies, "warc-copies")
    small = copies.count() <= common.BROADCAST_IDS
    joined = rows.join(F.broadcast(copies) if small else copies.hint("merge"), "own", "left")
    refers = F.when(long_enough & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, where: str, min_bytes: int = 0) -> DataFrame:
    """Write the pages into packages below ``where``; returns their manifest (uri, size, records).

    A package's name is its attempt's own, and only packages that a task which ended well has named
    are in the manifest, so lost or repeated tasks leave nothing that is read.
    """
    types = {"uri": pa.string(), "size": pa.int64(), "records": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(where)
        fs.create_dir(base, recursive=True)
        data, index, at, n = [], [], 0, 0

        def close():
            name = f"{uuid.uuid4().hex}.zip"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                with z.open(zipfile.ZipInfo(DATA), "w") as m:
                    for part in data:
                        m.write(part)
                z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(out.getbuffer())
            return common.arrow_batch({"uri": [f"{where}/{name}"], "size": [out.getbuffer().nbytes], "records": [n]}, types)

        for batch in batches:
            ids, urls, pages_, refers = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                page_id = ids[k].as_py()
                html = pages_[k].as_py()
                own = record(page_id, urls[k].as_py(), (html or "").encode(), refers[k].as_py())
                data.append(own)
                index.append(f"{at} {len(own)} {'' if page_id is None else page_id}\n")
                at, n = at + len(own), n + 1
                if at >= PACKAGE_BYTES:
                    yield close()
                    data, index, at, n = [], [], 0, 0
        if n:
            yield close()

    found = common.map_arrow(roles(pages, min_bytes), run, "uri string, size long, records long")
    return common.materialize(found, "warc-manifest")


def records(uri: str, size: int) -> Iterator[dict]:
    """Parsed records of one package, read by ranges that its index gives."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as file:
        members = directory(file, size)
        index, data = stored(members, INDEX), stored(members, DATA)
        spans = [tuple(map(int, line.split(" ")[:2])) for line in _at(file, index.start, index.size).decode().splitlines()]
        k = 0
        while k < len(spans):
            begin, stop = spans[k][0], k
            while stop < len(spans) and (stop == k or spans[stop][0] + spans[stop][1] - begin <= READ_BYTES) and (stop == k or spans[stop][0] == spans[stop - 1][0] + spans[stop - 1][1]):
                stop += 1
            part = _at(file, data.start + begin, spans[stop - 1][0] + spans[stop - 1][1] - begin)
            for offset, length in spans[k:stop]:
                yield parse(part[offset - begin : offset - begin + length])
            k = stop


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the packages, with its payload if asked for."""
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        types["payload"], schema = pa.binary(), schema + ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = {k: [] for k in types}
                for row in records(uri, size):
                    for k in types:
                        held[k].append(row[k])
                    if len(held["url"]) == 500:
                        yield common.arrow_batch(held, types)
                        held = {k: [] for k in types}
                yield common.arrow_batch(held, types)

    tasks = max(1, manifest.count() // PACKAGES_PER_TASK)
    return common.map_arrow(manifest.select("uri", "size").repartition(tasks, F.xxhash64("uri")), run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to packages in the shared folder and read those back."""
    return read(write(pages, common.new_path(spark, "warc"), min_bytes))

"""WARC files: one gzip member a record, read in sequence with incremental decompression, content-length framing and digest checks.

`spark.read.format("warc")` (after register()) has one partition for each file: a file is read once, from front to back, in blocks, and
only one record is held at a time. A record's status is

    ok          all of it holds
    digest      its block or payload doesn't have the digest that its header has
    unverified  it holds otherwise, but a digest can't be checked: an algorithm other than md5, sha1, sha256 and sha512, or a
                payload under a transfer encoding
    length      its member ends before or after its content length
    truncated   the file ends inside it
    corrupt     its member can't be decompressed, or has no WARC header; reading goes on at the next member
    plain       the file isn't empty and has no gzip member; the one record that stands for it

Digests are base32 or hexadecimal. The payload is the block, or, of an HTTP message, what follows its header.

Defined results: an empty file has no records; a record without a digest is ok if its length holds; header fields that are missing are null;
bytes between members are skipped; several files may hold equal records, and all are returned. write() stores a null payload as
an empty one and a null id as a record without an id; an empty table gives no records; long payloads are read whole; other
columns don't matter. A folder that write() is given may hold other files and folders, which stay; read() reads every file below it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 16
#: Bytes of payload in a batch handed to Spark.
BATCH = 4 << 20
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "file string, offset long, type string, record_id string, target_uri string, date string, content_type string, content_length long, status string, payload binary"
_FIELDS = {"warc-type": "type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type"}


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def matches(stated: str, content: bytes) -> bool | None:
    """Whether content has the digest, in base32 or hexadecimal; None if its algorithm isn't known."""
    algorithm, _, value = stated.partition(":")
    algorithm, value = algorithm.strip().lower().replace("-", ""), value.strip()
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return None
    raw = hashlib.new(algorithm, content, usedforsecurity=False).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def checked(fields: dict[str, str], block: bytes) -> str:
    """ok, digest or unverified."""
    found = []
    if stated := fields.get("warc-block-digest"):
        found.append(matches(stated, block))
    if stated := fields.get("warc-payload-digest"):
        head, body, encoded = b"", block, False
        if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            encoded = b"\ntransfer-encoding:" in head.lower()
        found.append(matches(stated, body) or (None if encoded else False) if matches(stated, b"") is not None else None)
    return "digest" if False in found else "unverified" if None in found else "ok"


def record(payload: bytes, record_id: str | None, uri: str | None, date: str = "2024-01-01T00:00:00Z", kind: str = "resource", content_type: str = "text/html") -> bytes:
    """One gzip member."""
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Date: {date}".encode()]
    if record_id is not None:
        head.append(f"WARC-Record-ID: <{record_id}>".encode())
    if uri is not None:
        head.append(b"WARC-Target-URI: " + uri.replace("\r", "").replace("\n", "").encode())
    head += [f"Content-Type: {content_type}".encode(), f"WARC-Block-Digest: {digest(payload)}".encode(), f"Content-Length: {len(payload)}".encode()]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def _parsed(plain: bytes, whole: bool) -> dict:
    """A record from its member's bytes."""
    out = dict.fromkeys(("type", "record_id", "target_uri", "date", "content_type", "content_length", "payload"))
    head, found, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return out | {"status": "corrupt" if whole else "truncated"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out |= {name: fields.get(k) for k, name in _FIELDS.items()}
    if out["record_id"]:
        out["record_id"] = out["record_id"].strip("<>")
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        return out | {"status": "length" if whole else "truncated", "payload": rest}
    payload = rest[:n]
    out |= {"content_length": n, "payload": payload}
    if not whole:
        return out | {"status": "truncated"}
    if len(payload) < n or rest[n:] not in (b"\r\n\r\n", b""):
        return out | {"status": "length"}
    return out | {"status": checked(fields, payload)}


def records(f: BinaryIO) -> Iterator[dict]:
    """The records of one file, in order."""
    data, at, ended, members = b"", 0, False, 0  # bytes not used so far, and where they begin in the file

    def more() -> bytes:
        nonlocal ended
        block = f.read(BLOCK)
        ended |= not block
        return block

    while True:
        while (i := data.find(MAGIC)) < 0 and not ended:
            keep = data[-2:]
            at += len(data) - len(keep)
            data = keep + more()
        if i < 0:
            if not members and at + len(data):
                yield _parsed(b"", True) | {"offset": 0, "status": "plain"}
            return
        data, at, members = data[i:], at + i, members + 1
        begin, z, parts = at, zlib.decompressobj(31), []
        try:
            while True:
                parts.append(z.decompress(data))
                if z.eof or ended:
                    break
                data = more()
        except zlib.error:
            yield _parsed(b"", True) | {"offset": begin}
            # the search for the next member goes on behind this one's mark
            f.seek(begin + len(MAGIC))
            data, at, ended = more(), begin + len(MAGIC), False
            continue
        yield _parsed(b"".join(parts), z.eof) | {"offset": begin}
        if not z.eof:
            return
        at = f.tell() - len(z.unused_data)
        data = z.unused_data


class WarcReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, at = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        return [InputPartition(x.path) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = {"offset": pa.int64(), "content_length": pa.int64(), "payload": pa.binary()}
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)

        if partition is None:
            return
        with system.open_input_file(partition.value) as f:
            for r in records(f):
                rows.append(r | {"file": partition.value})
                size += len(r["payload"] or b"")
                if size >= BATCH:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """Option path: a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").load(path)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A file for each partition; (file, records). Files of this job's tasks that failed or were repeated are removed, and no others."""
    job = uuid.uuid4().hex

    def written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        system.create_dir(at, recursive=True)
        name, n = f"{at}/{job}-{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(name, compression=None) as f:
            for b in it:
                for i, u, p in zip(*(c.to_pylist() for c in b.columns)):
                    f.write(record(p or b"", None if i is None else f"urn:page:{i}", u))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    system, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    system.create_dir(at, recursive=True)
    done = rows.mapInArrow(written, "file string, records long").collect()
    good = {r.file for r in done}
    for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if x.type == fs.FileType.File and x.base_name.startswith(f"{job}-") and x.path not in good:
            system.delete_file(x.path)
    return pages.sparkSession.createDataFrame(done, "file string, records long")

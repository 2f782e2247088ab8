"""WARC archives: one gzip member per record, written and read in order, in parallel over files.

Writing tasks stream their pages into a file of the target folder under a temporary name and rename it when complete, so a
repeated task replaces its own file. Reading tasks go through a file once: compressed bytes are inflated step by step, a
record's block is framed by its Content-Length, and block and payload digests are computed on the way and held against
those of the header; a payload is never held whole unless asked for.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from propensia.session import shared_path, stage

CHUNK = 1 << 18
ROLL_BYTES = 1 << 28
LEAST_REVISIT = 100
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class DamagedArchive(ValueError):
    """A member, frame or digest of an archive is not as its header says."""


def _qualified(spark: SparkSession, folder: str) -> str:
    """A folder without a scheme lies in Spark's default file system, as it does for Spark's own tables."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return folder if ":/" in folder or default.startswith("file:") else default.rstrip("/") + folder


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith(("s3a://", "s3n://")):  # Hadoop's names of one store
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One compressed record: a response, or a revisit without payload if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {_sha256(block)}",
        f"WARC-Payload-Digest: {_sha256(payload)}", f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Member:
    """The inflated bytes of one gzip member, on demand."""

    def __init__(self, source: BinaryIO, ahead: bytes):
        self.source, self.raw, self.z, self.out, self.at = source, ahead, zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        while not self.z.eof:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise DamagedArchive("the archive ends inside a member")
            got = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unconsumed_tail if not self.z.eof else self.z.unused_data
            if got:
                self.out, self.at = self.out[self.at :] + got, 0
                return True
        return False

    def until(self, end: bytes, most: int = 1 << 20) -> bytes:
        """All up to and with ``end``."""
        while (i := self.out.find(end, self.at)) < 0:
            if len(self.out) - self.at > most or not self._more():
                raise DamagedArchive("a header has no end")
        out, self.at = self.out[self.at : i + len(end)], i + len(end)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            if self.at == len(self.out) and not self._more():
                raise DamagedArchive("a block is shorter than its Content-Length")
            piece = self.out[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece

    def finish(self) -> bytes:
        """Checks that nothing but the record's end is left; returns what was read beyond the member."""
        if b"".join(self.take(4)) != b"\r\n\r\n" or self.at < len(self.out) or self._more():
            raise DamagedArchive("a record does not end after its block")
        return self.raw


class Record(NamedTuple):
    """``payload_digest`` is bare SHA-256 and with ``payload_bytes`` of the full payload, null where a revisit does not state them."""

    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int | None
    payload_digest: str | None
    payload: bytes | None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


#: digest algorithms that are verified, with their size; digests by others are passed over
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}
#: an HTTP header longer than this is none: the whole block is payload
HTTP_HEAD = 1 << 20


def _digest(labelled: str | None) -> tuple[str, bytes] | None:
    """Algorithm and bytes of ``algorithm:value`` with a hex or base32 value; None if absent or by an unknown algorithm."""
    name, _, value = (labelled or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return None
    value = value.strip()
    try:
        if len(value) == 2 * DIGESTS[name]:
            return name, bytes.fromhex(value)
        return name, base64.b32decode(value + "=" * (-len(value) % 8), casefold=True)
    except (ValueError, binascii.Error) as e:
        raise DamagedArchive(f"unreadable digest {labelled}") from e


class _Verified:
    """Data hashed by the algorithm of a stated digest, if that is known."""

    def __init__(self, labelled: str | None):
        self.stated = _digest(labelled)
        self.hash = hashlib.new(self.stated[0]) if self.stated else None

    def update(self, piece: bytes) -> None:
        if self.hash:
            self.hash.update(piece)

    def check(self, what: str) -> None:
        if self.hash and self.hash.digest() != self.stated[1]:
            raise DamagedArchive(what)


def _stated_size(http: dict[str, str]) -> int | None:
    size = http.get("content-length", "")
    return int(size) if size.isascii() and size.isdigit() else None


def read_records(source: BinaryIO, keep_payload: bool = False) -> Iterator[Record]:
    """Records of an archive in order; raises ``DamagedArchive`` where framing, a header or a digest is wrong.

    Block and payload digests are verified by the algorithm that the header names (MD5, SHA-1, SHA-2; hex or base32); those by
    other algorithms are passed over. The payload of an ``application/http`` block is what follows its HTTP header, that
    of other blocks the whole block. A revisit's payload digest is of the payload it refers to, so it is not verified.
    """
    ahead = source.read(CHUNK)
    while ahead:
        member = Member(source, ahead)
        try:
            headers = _fields(member.until(b"\r\n\r\n"))
            length, kind = headers["content-length"], headers["warc-type"]
        except (KeyError, zlib.error) as e:
            raise DamagedArchive(f"a record has no readable header: {e}") from e
        if not (length.isascii() and length.isdigit()):
            raise DamagedArchive(f"Content-Length {length}")
        name, revisit = headers.get("warc-record-id"), kind == "revisit"
        block, payload = _Verified(headers.get("warc-block-digest")), _Verified(None if revisit else headers.get("warc-payload-digest"))
        own, size, body = hashlib.sha256(), 0, []
        http: dict[str, str] | None = None if headers.get("content-type", "").lower().startswith("application/http") else {}
        held = b""
        try:
            left = int(length)
            for piece in member.take(left):
                block.update(piece)
                left -= len(piece)
                if http is None:
                    held += piece
                    head, end, rest = held.partition(b"\r\n\r\n")
                    if end:
                        http, piece = _fields(head), rest
                    elif left and len(held) <= HTTP_HEAD:
                        continue
                    else:
                        http, piece = {}, held
                payload.update(piece)
                own.update(piece)
                size += len(piece)
                if keep_payload:
                    body.append(piece)
            ahead = member.finish() or source.read(CHUNK)
        except zlib.error as e:
            raise DamagedArchive(str(e)) from e
        block.check(f"block digest of {name}")
        payload.check(f"payload digest of {name}")
        digest: str | None = own.hexdigest()
        if revisit:
            stated = _digest(headers.get("warc-payload-digest"))
            digest = stated[1].hex() if stated and stated[0] == "sha256" else None
            size = _stated_size(http or {})
        yield Record(headers, http or {}, size, digest, b"".join(body) if keep_payload else None)


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, top = _filesystem(folder)
        done: list[tuple[str, int, int]] = []
        out, records, size = None, 0, 0
        draft = f"{top}/_drafts/{task.partitionId()}-{task.taskAttemptId()}"

        def close() -> None:
            out.close()
            name = f"{top}/part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
            if files.get_file_info(name).type != pafs.FileType.NotFound:
                files.delete_file(name)
            files.move(draft, name)
            done.append((f"{folder}/{name.rpartition('/')[2]}", records, size))

        for batch in batches:
            payloads = batch.column("html").cast(pa.large_binary())
            for page, url, html, first in zip(*(batch.column(c) for c in ("id", "url")), payloads, batch.column("first")):
                if out is None:
                    files.create_dir(f"{top}/_drafts", recursive=True)
                    out, records, size = files.open_output_stream(draft, compression=None), 0, 0
                data = record(page.as_py(), url.as_py(), html.as_py() or b"", first.as_py())
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*done)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Writes one record per row and returns path, records and bytes of every archive.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the smallest id is a response and the others
    are revisits of it; smaller payloads are all responses. A null html is an empty payload. Rows that share both the
    smallest id and the payload are all responses; a row without an id revisits the smallest id, if there is one.
    No rows write no archive. Other columns are ignored. ``folder`` must be new, on storage that every executor
    reaches by path or by a scheme pyarrow knows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = large.join(stage(first.select("digest", "first"), "first"), "digest").where(~F.col("id").eqNullSafe(F.col("first")))
    again = stage(again.select("id", "digest", "first").distinct(), "again").withColumnRenamed("id", "again_id").withColumnRenamed("digest", "again_digest")
    marked = rows.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    folder = _qualified(pages.sparkSession, folder)
    written = marked.select("id", "url", "html", "first").mapInArrow(_writer(folder, roll), "path string, records long, bytes long")
    return stage(written, "archives")


def _reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(urn: str | None) -> int | None:
            """The page of a record id that ``record`` made; ids of other writers name no page."""
            found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
            return int(found[1]) if found else None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "refers_to_id", "path", "payload"]
            n = len(names) if keep_payload else len(names) - 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:n], types)], names[:n])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = _filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(name, compression=None) as source:
                    for r in read_records(source, keep_payload):
                        h = r.headers
                        rows.append((number(h.get("warc-record-id")), r.payload_bytes, r.payload_digest, h["warc-type"], number(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-record-id"), h.get("warc-refers-to"), path, r.payload))
                        held += len(r.payload or b"") + 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """All records of the archives whose paths are in the column path, a task per file.

    Returns page_id, payload_bytes and payload_digest (both of the full payload, also for revisits), record_type,
    refers_to, target_uri, record_id and refers_to_id (as written), path and, if asked for, payload (empty for revisits).
    page_id and refers_to are null for ids that ``write_archives`` did not make; the digest is SHA-256, and with the size
    null where a revisit does not state it. Records of all types are returned. A damaged archive fails the read.
    """
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string, refers_to_id string, path string"
    paths = archives.select("path")
    n = max(1, paths.count())
    return paths.repartition(n).mapInArrow(_reader(keep_payload), shape + (", payload binary" if keep_payload else ""))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to archives (in the session's shared folder unless told otherwise) and reads them back."""
    folder = folder or shared_path(pages.sparkSession, f"warc-{uuid.uuid4().hex[:8]}")
    return read_archives(write_archives(pages, folder))

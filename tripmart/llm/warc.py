"""WARC archives: written by Spark tasks, read back record by record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.hashing import rows_of
from tripmart.llm.text import column, written
from tripmart.session import work_dir

#: A task begins a new archive when one has reached so many compressed bytes.
ARCHIVE_BYTES = 1 << 28
_CHUNK = 1 << 18
# How a gzip member begins, and how the format names a repeat of an identical payload.
_MAGIC = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`page_id`, `url`, `html` (null as empty), `refers_to`: which page holds the payload that this one repeats.

    Of equal payloads of at least `least_bytes`, the page with the largest id keeps it; rows that repeat that id keep
    it too. Null ids are below all others; if no page of a payload has an id, none is a repeat. Only digests are
    grouped and joined by payload; pages with their html are dealt by page, url and digest, so a payload that very many
    pages share does not bring them together.
    """
    here = pages.select(column(pages, "page_id").cast("long").alias("page_id"), column(pages, "url").cast("string").alias("url"),
                        F.coalesce(column(pages, "html"), F.lit("")).alias("html"))
    here = here.withColumn("_digest", F.unhex(F.sha1("html")))
    row = ["page_id", "url", "_digest"]
    slim = written(here.select(*row, F.octet_length("html").alias("_size")), "warc-digests")
    keepers = slim.where(F.col("_size") >= least_bytes).groupBy(F.col("_digest").alias("_of")).agg(
        F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).where("_n > 1").select("_of", "_keeper")
    repeats = slim.join(keepers, F.col("_digest") == F.col("_of")).where(~F.col("page_id").eqNullSafe(F.col("_keeper"))).select(
        *[F.col(c).alias(f"_r{c}") for c in row], F.col("_keeper").alias("refers_to")).distinct()
    same = F.expr(" AND ".join(f"{c} <=> _r{c}" for c in row))
    return here.join(repeats, same, "left").select("page_id", "url", "html", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with only the head of the response."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~^|\\`{}\"") if url else "urn:x-none"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        *([("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{_PAGE}{refers_to}>")] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, path, done, n, size = None, "", [], 0, 0
        for rows in rows_of(batches):
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in rows.columns]):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = _member(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", least_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page (`page_id`, `url`, `html`) under `folder`; returns the manifest `path`, `records`, `bytes`.

    A task streams its pages into archives with names of their own. The manifest is a written table and holds only
    the archives of tasks that ended well: what a lost task left behind is not read. `folder` must be shared.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return written(record_types(pages, least_bytes).mapInArrow(
        _write(folder, date, archive_bytes), "path string, records long, bytes long"), "warc-manifest")


class _Members:
    """The decompressed bytes of gzip members, one after the other, a chunk at a time."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.rest, self.buffer = raw, b"", bytearray()
        self.packed, self.chunk, self.broken = None, b"", False

    def next(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        self.rest = self.rest or self.raw.read(_CHUNK)
        self.packed, self.buffer, self.broken = zlib.decompressobj(31), bytearray(), False
        return bool(self.rest)

    def _fill(self) -> bool:
        if self.packed.eof:
            return False
        data = self.packed.unconsumed_tail or self.rest or self.raw.read(_CHUNK)
        if not data:
            raise EOFError("the archive ends within a record")
        self.rest, self.chunk = b"", data
        try:
            self.buffer += self.packed.decompress(data, _CHUNK)
        except zlib.error:
            self.broken = True
            raise
        if self.packed.eof:
            self.rest = self.packed.unused_data
        return True

    def skip(self) -> None:
        """Leave a damaged member. A whole one is read to its end; behind a torn one the next start is looked for."""
        try:
            while not self.broken and self._fill():
                self.buffer.clear()
        except zlib.error:
            pass
        except EOFError:
            return
        if not self.broken:
            return
        data = self.chunk[1:]
        while True:
            at = data.find(_MAGIC)
            if at >= 0:
                self.rest = data[at:]
                return
            more = self.raw.read(_CHUNK)
            if not more:
                self.rest = b""
                return
            data = data[-2:] + more

    def head(self) -> bytes:
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > 1 << 20 or not self._fill():
                raise ValueError("no end of the head")
        found = bytes(self.buffer[:at + 4])
        del self.buffer[:at + 4]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._fill():
                raise EOFError("the block is shorter than its length")
            part = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(part)
            if part:
                yield part

    def tail(self) -> bytes:
        while self._fill():
            if len(self.buffer) > 4:
                break
        return bytes(self.buffer)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(_PAGE)
    return int(number) if number.lstrip("-").isdigit() else None


def read_records(raw: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order; `problem` says what is wrong with one, else null.

    Holds one chunk, or one payload where they are asked for. After a damaged record it goes on with the next gzip member;
    damaged bytes that hold no record's head are one problem, however many starts of members they seem to hold.
    """
    members, lost = _Members(raw), False
    while members.next():
        out: dict = {"problem": None}
        try:
            head = members.head()
            if not head.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            lost = False
            named = _fields(head)
            out |= {"page_id": _page(named.get("warc-record-id")), "url": named.get("warc-target-uri"),
                    "record_type": named.get("warc-type"), "refers_to": _page(named.get("warc-refers-to")),
                    "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:")}
            block, payload, kept, http = hashlib.sha1(), hashlib.sha1(), [], bytearray()
            length, body = int(named["content-length"]), None
            for part in members.take(length):
                block.update(part)
                if body is None:
                    http += part
                    at = http.find(b"\r\n\r\n")
                    if at < 0:
                        continue
                    out["payload_bytes"] = int(_fields(bytes(http[:at + 4])).get("content-length", -1))
                    part, body = bytes(http[at + 4:]), 0
                body += len(part)
                payload.update(part)
                if payloads:
                    kept.append(part)
            if members.tail() != b"\r\n\r\n":
                raise ValueError("the record does not end where its length says")
            if base64.b32encode(block.digest()).decode() != named.get("warc-block-digest", "").removeprefix("sha1:"):
                out["problem"] = "block digest"
            if out["record_type"] == "response":
                if base64.b32encode(payload.digest()).decode() != out["payload_digest"] or body != out["payload_bytes"]:
                    out["problem"] = "payload digest"
                out["payload"] = b"".join(kept) if payloads else None
            yield out
        except (EOFError, ValueError, KeyError, zlib.error) as e:
            if not lost:
                yield out | {"problem": f"{type(e).__name__}: {e}"}
            lost = True
            if isinstance(e, EOFError) and not members.packed.eof:
                return
            members.skip()


_READ = ("path string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, payload binary, problem string")
_ARROW = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("payload", pa.binary()), ("problem", pa.string())])


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for rows in batches:
            for path in rows.column("path").to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for found in read_records(raw, payloads):
                        held.append(found | {"path": path})
                        size += 500 + len(found.get("payload") or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives in `manifest` (`path`), each archive read from front to end by one task.

    Columns as in `_READ`; `payload_bytes` and `payload_digest` are those of the full payload for revisits too.
    """
    n = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(_read(folder, payloads), _READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages as read back from archives written to the shared folder; `problem` tells what is wrong with a record."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes=least_bytes), folder)

"""WARC archives: a committed writer and a salvaging reader.

Writing: each task writes gzip-member-per-record files to the shared folder
under names of its own and reports those it closed; only reported files are
read, so retried or lost tasks leave no duplicate records.

Reading: files are streamed, a member's content as it is inflated.  What fails
a check (inflate, gzip CRC, version line, header, length, digest) opens a gap.
Inside a member the reader searches the inflated bytes for the next version
line; behind damage to the compression itself, and between plain records, it
searches the file for the next gzip magic or version line.  Records before and
after the damage are kept, and the gap's bytes are reported as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.runtime import scratch, stored_map, text_of, written

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 64 << 20
#: Bytes of the longest block that the reader holds.
BLOCK_BYTES = 1 << 30


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, ident: str, url: str | None, payload: bytes | None, digest: str, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z", payload_bytes: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head without the payload,
    which may be None if its size is given."""
    size = len(payload) if payload_bytes is None else payload_bytes
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """The data as a gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


@dataclass
class Parsed:
    """A record that passed all checks, or a quarantined gap.

    ``start`` and ``end`` are the file's bytes: of the member for what lies
    inside one, where only its last record knows the end.  ``inner`` is the
    place in the inflated bytes; a gap inside a member has ``inner_end`` too.
    """

    start: int
    end: int | None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str | None = None
    inner: int | None = None
    inner_end: int | None = None


class _Bad(ValueError):
    pass


class _Bytes:
    """Bytes that come in parts, of which those before a place are let go."""

    def __init__(self, at: int = 0):
        self.data, self.base = bytearray(), at

    def _part(self) -> bytes:
        """The next bytes, empty at the end."""
        raise NotImplementedError

    def more(self) -> bool:
        part = self._part()
        self.data += part
        return bool(part)

    def peek(self, at: int, size: int) -> bytes:
        while len(self.data) < at - self.base + size and self.more():
            pass
        return bytes(self.data[at - self.base : at - self.base + size])

    def drop(self, upto: int) -> None:
        count = min(upto - self.base, len(self.data))
        del self.data[:count]
        self.base += count

    def find(self, marks: tuple[bytes, ...], at: int) -> int | None:
        """The first place from ``at`` on where a mark is; lets go what it passes."""
        while True:
            places = [x for x in (self.data.find(mark, at - self.base) for mark in marks) if x >= 0]
            if places:
                return self.base + min(places)
            at = max(at, self.end() - len(VERSION) + 1)  # a mark may have begun
            if not self.more():
                return None
            self.drop(min(at, self.end()))

    def end(self) -> int:
        return self.base + len(self.data)


class _Window:
    """The part of a stream that was read last."""

    def __init__(self, stream, step: int):
        self._stream, self._step = stream, step
        self._data, self._base = b"", 0

    def read(self, at: int) -> bytes:
        """Some bytes from ``at`` on, empty at the end."""
        if not self._base <= at < self._base + len(self._data):
            self._stream.seek(at)
            self._data, self._base = self._stream.read(self._step), at
        return self._data[at - self._base : at - self._base + (1 << 16)]


class _File(_Bytes):
    def __init__(self, window: _Window, at: int = 0):
        super().__init__(at)
        self._window = window

    def _part(self) -> bytes:
        return self._window.read(self.end())


class _Member(_Bytes):
    """The inflated bytes of the gzip member at ``start`` of a file."""

    def __init__(self, window: _Window, start: int):
        super().__init__()
        self._window, self._at = window, start
        self._inflater, self._left = zlib.decompressobj(31), b""
        self.after: int | None = None  #: the file's place behind the member
        self.damage: str | None = None

    def _part(self) -> bytes:
        while self.after is None and self.damage is None:
            part = self._left
            if not part:
                part = self._window.read(self._at)
                self._at += len(part)
            if not part:
                self.damage = "truncated member"
                break
            try:
                out = self._inflater.decompress(part, 1 << 20)
            except zlib.error as error:
                self.damage = f"inflate: {error}"
                break
            self._left = self._inflater.unconsumed_tail
            if self._inflater.eof:
                self.after = self._at - len(self._inflater.unused_data)
            if out:
                return out
        return b""


def parse_record(source: _Bytes, at: int, limit: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; raises _Bad.

    A block is only read if its length is at most ``limit`` bytes.
    """
    if source.peek(at, len(VERSION)) != VERSION:
        raise _Bad("no version line")
    seen = 0
    while (stop := source.data.find(b"\r\n\r\n", at - source.base + max(0, seen - 3))) < 0:
        seen = len(source.data) - (at - source.base)
        if seen >= 1 << 20:
            raise _Bad("endless header")
        if not source.more():
            raise _Bad("short header")
    headers = {}
    for line in bytes(source.data[at - source.base : stop]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise _Bad("malformed header")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise _Bad("no content length")
    if int(size) > limit:
        raise _Bad("block over the limit")
    begin = source.base + stop + 4
    found = source.peek(begin, int(size) + 4)
    block, tail = found[: int(size)], found[int(size) :]
    if len(found) < int(size) + 4:
        raise _Bad("short block")
    if tail != b"\r\n\r\n":
        raise _Bad("length mismatch")
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise _Bad("digest mismatch")
    return headers, block, begin + int(size) + 4


class SalvageReader:
    """Records and gaps of one archive, read from a seekable binary stream.

    It holds a record and what it reads at once: a block of over ``limit``
    bytes is quarantined.
    """

    def __init__(self, stream, step: int = 1 << 20, limit: int = BLOCK_BYTES):
        self._window, self._limit = _Window(stream, step), limit

    def _inside(self, member: _Member, start: int) -> Iterator[Parsed]:
        """Records and gaps of a member's inflated bytes."""
        at, gap, reason = 0, None, None
        while member.peek(at, 1):
            try:
                headers, block, end = parse_record(member, at, self._limit)
            except _Bad as error:
                if gap is None:
                    gap, reason = at, str(error)
                following = member.find((VERSION,), at + 1)
                if following is None:
                    at = member.end()
                    break
                at = following
                member.drop(at)
                continue
            if gap is not None:
                yield Parsed(start, None, reason=reason, inner=gap, inner_end=at)
                gap = None
            yield Parsed(start, None, headers, block, inner=at)
            at = end
            member.drop(at)
        if gap is not None:
            yield Parsed(start, None, reason=reason, inner=gap, inner_end=at)

    def __iter__(self) -> Iterator[Parsed]:
        file, at = _File(self._window), 0
        gap: Parsed | None = None  # open, its end not known yet

        def closed(end: int) -> Iterator[Parsed]:
            nonlocal gap
            if gap is not None:
                gap.end = end
                yield gap
                gap = None

        while head := file.peek(at, len(VERSION)):
            reason, inner = None, None
            if head.startswith(MAGIC):
                member, held, kept = _Member(self._window, at), None, 0
                for item in self._inside(member, at):
                    if item.reason is None:
                        yield from closed(at)
                        kept += 1
                    if held is not None and (kept or held.reason is None):
                        yield held
                    held = item
                file = _File(self._window, at)
                if member.damage is None and kept:
                    held.end = member.after
                    yield held
                elif kept:  # the member's rest is lost
                    lost = held if held.reason is not None else None
                    if lost is None:
                        yield held
                    reason, inner = (lost.reason, lost.inner) if lost else (member.damage, member.end())
                else:
                    reason = member.damage or (held.reason if held else "empty member")
                if member.damage is None:
                    if not kept and gap is None:
                        gap = Parsed(at, None, reason=reason)
                    at = member.after
                    file = _File(self._window, at)
                    continue
            elif head == VERSION:
                try:
                    headers, block, end = parse_record(file, at, self._limit)
                except _Bad as error:
                    reason = str(error)
                else:
                    yield from closed(at)
                    yield Parsed(at, end, headers, block)
                    at = end
                    file.drop(at)
                    continue
            else:
                reason = "no record start"
            if gap is None:
                gap = Parsed(at, None, reason=reason, inner=inner)
            following = file.find((MAGIC, VERSION), at + 1)
            if following is None:
                at = file.end()
                break
            at = following
            file.drop(at)
        yield from closed(at)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``(id string, url, payload binary, payload_bytes, digest,
    refers_to)`` rows; a revisit's payload may be null.

    Gives the written manifest ``(file, records, bytes)``.
    """

    def run(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        sink, name, temp, records, size = None, None, None, 0, 0

        def close():
            sink.close()
            system.move(temp, f"{root}/{name}")
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            for ident, url, payload, length, digest, refers in zip(*batch.columns, strict=True):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    temp, records, size = f"{root}/.{name}.open", 0, 0
                    sink = system.open_output_stream(temp, compression=None)
                kind = "revisit" if refers.is_valid else "response"
                data = member(record(kind, ident.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py(), payload_bytes=length.as_py()))
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    names = ("id", "url", "payload", "payload_bytes", "digest", "refers_to")
    return stored_map(rows.select(*names), run, "file string, records long, bytes long", "manifest").frame


_READ = "file string, start long, end long, inner long, inner_end long, kind string, id string, url string, payload_bytes long, payload_digest string, refers_to string, verified boolean, reason string"


def _row(file: str, item: Parsed) -> tuple:
    if item.reason is not None:
        return (file, item.start, item.end, item.inner, item.inner_end, "gap", None, None, None, None, None, False, item.reason)
    headers = item.headers
    head, split, payload = item.block.partition(b"\r\n\r\n")
    length = next((line[15:].strip() for line in head.split(b"\r\n") if line[:15].lower() == b"content-length:"), None)
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = int(length) if length is not None and length.isdigit() else len(payload) if split else len(item.block)
    whole = kind != "response" or (len(payload) == size and base32_sha1(payload) == digest)
    strip = lambda x: None if x is None else x.strip("<>")
    return (file, item.start, item.end, item.inner, None, kind, strip(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, digest, strip(headers.get("warc-refers-to")), whole, None)


def read_archives(files: DataFrame) -> DataFrame:
    """Records and quarantined gaps (``kind`` gap) of the ``file`` column's
    archives, as a written table."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = _open(file)
                rows = []
                with system.open_input_file(path) as stream:
                    for item in SalvageReader(stream):
                        rows.append(_row(file, item))
                        if len(rows) == 2000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored_map(files.select("file").repartition(parts, "file"), run, _READ, "records").frame


def archive_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes every page to WARC archives; gives the manifest.

    Among records with equal payloads of at least ``min_bytes`` bytes the one
    with the largest id is the response and the others revisit it.

    * null html is an empty payload, a null url is left out of the headers,
      line ends in urls are percent-encoded;
    * rows that repeat the largest id with one payload are all responses; null
      ids are the smallest: they revisit any other, among themselves all are
      responses; other columns are ignored, whatever their names;
    * an empty table gives an empty manifest; payloads are kept whole.
    """
    payload = text_of(html_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("hex", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # Written, so that the join of narrow rows can split the commonest payload's.
    last = written(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("hex").agg(F.max("page").alias("last")), "last")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    none = F.lit(None).cast("string")
    # Payloads travel to the records that hold them by digest and page: copies
    # of one payload have different pages.  Revisits travel without a payload.
    firsts = last.withColumnsRenamed({"hex": "own", "last": "own_page"})
    holders = rows.join(firsts, (rows.hex == firsts.own) & rows.page.eqNullSafe(firsts.own_page), "left_semi").select("page", "url", "payload", "payload_bytes", "hex", none.alias("refers_to"))
    short = rows.where(F.col("payload_bytes") < min_bytes).select("page", "url", "payload", "payload_bytes", "hex", none.alias("refers_to"))
    again = rows.drop("payload").join(last, "hex").where(~F.col("page").eqNullSafe(F.col("last")))
    again = again.select("page", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "hex", name(F.col("last")).alias("refers_to"))
    every = holders.unionByName(again)
    if min_bytes > 0:
        every = every.unionByName(short)
    digests = every.select(name(F.col("page")).alias("id"), "url", "payload", "payload_bytes", _base32("hex").alias("digest"), "refers_to")
    return write_archives(digests, folder or scratch(spark, "warc"))


def _base32(hex_col: str):
    """Base-32 of 160 bits given in hexadecimal, in SQL."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(0, 40, 5):  # 20 bits, four letters
        number = F.conv(F.substring(hex_col, k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(alphabet), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)

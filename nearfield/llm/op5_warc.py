"""WARC archives: a writer, and a sequential reader that checks what it reads.

One gzip member holds one record. The reader decompresses a member at a time, in blocks, frames it by Content-Length and
verifies both digests; a record needs no more memory than the caller asks for. Archives go to the folder all executors
share. A task names its files by its attempt and returns the names, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bytes after which a writer begins another archive; bytes read at once.
ARCHIVE, BLOCK = 64 << 20, 1 << 16
#: Repeated payloads up to which the table of them is broadcast.
BROADCAST_DIGESTS = 250_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class Members:
    """The decompressed bytes of one gzip member after the other, from a stream."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def __iter__(self) -> Iterator["Member"]:
        while self.rest or self._more():
            member = Member(self)
            yield member
            member.finish()

    def _more(self) -> bool:
        self.rest = self.stream.read(BLOCK)
        return bool(self.rest)


class Member:
    """One member: reads by line and by length."""

    def __init__(self, source: Members):
        self.source, self.unpack, self.ready = source, zlib.decompressobj(31), b""

    def _fill(self) -> bool:
        while not self.unpack.eof:
            if not self.source.rest and not self.source._more():
                raise ValueError("the archive ends within a record")
            made = self.unpack.decompress(self.source.rest, BLOCK)
            self.source.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if made:
                self.ready += made
                return True
        return False

    def line(self) -> str:
        while b"\r\n" not in self.ready:
            if not self._fill():
                raise ValueError("a record's header has no end")
        text, _, self.ready = self.ready.partition(b"\r\n")
        return text.decode()

    def parts(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.ready and not self._fill():
                raise ValueError("a record is shorter than its Content-Length")
            part, self.ready = self.ready[:length], self.ready[length:]
            length -= len(part)
            yield part

    def finish(self) -> None:
        """What follows the block is the two line ends that close a record."""
        while self._fill():
            pass
        if self.ready != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")


def records(stream, payloads: bool = True) -> Iterator[tuple[dict[str, str], int, str, bytes | None]]:
    """(fields with lower-case names, payload bytes, payload digest, payload if asked for) of each record, verified."""
    for member in Members(stream):
        if not member.line().startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while line := member.line():
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        whole, inner, size, kept, head = hashlib.sha1(), hashlib.sha1(), 0, [], b""
        http = fields.get("content-type", "").startswith("application/http")
        for part in member.parts(int(fields["content-length"])):
            whole.update(part)
            if http:  # the payload begins after the empty line
                head += part
                if b"\r\n\r\n" not in head:
                    continue
                part, http = head.partition(b"\r\n\r\n")[2], False
            inner.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32(whole.digest())}":
            raise ValueError(f"block digest of {fields.get('warc-record-id')} doesn't hold")
        own = base32(inner.digest())
        if fields["warc-type"] != "revisit" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{own}":
            raise ValueError(f"payload digest of {fields.get('warc-record-id')} doesn't hold")
        yield fields, size, own, b"".join(kept) if payloads else None


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _target(url: str | None, page_id: int | None) -> str:
    """A URI that fits in a field."""
    return re.sub(r"[^\x21-\x7E]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url) if url else f"urn:page:{page_id}"


def _write(batches: Iterator[pa.RecordBatch], root: str, date: str) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, first page of the payload or null, its url) to archives; (path, records) of each archive."""
    files, base = pyarrow.fs.FileSystem.from_uri(root)
    task, made, out, size, count, path = TaskContext.get(), [], None, 0, 0, ""
    for batch in batches:
        for page_id, url, page, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                path = f"{base}/part-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.warc.gz"
                out, size, count = files.open_output_stream(path, compression=None), 0, 0
            payload = (page or "").encode()
            digest, revisit = base32(hashlib.sha1(payload).digest()), first is not None and page_id != first
            block, target = HTTP if revisit else HTTP + payload, _target(url, page_id)
            fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, target, digest)), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}")]
            if page_id is not None:
                fields.append(("X-Page-ID", str(page_id)))
            if revisit:
                before = _target(first_url, first)
                fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, before, digest)), ("WARC-Refers-To-Target-URI", before), ("X-Refers-To-Page-ID", str(first)), ("X-Payload-Length", str(len(payload)))]
            packed = record(fields, block)
            out.write(packed)
            size, count = size + len(packed), count + 1
            if size >= ARCHIVE:
                out.close()
                out = None
                made.append((path, count))
    if out is not None:
        out.close()
        made.append((path, count))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], names=["path", "records"])


def write_archives(pages: DataFrame, root: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of pages below root; (path, records) of each archive, to be written once and kept.

    Of rows with equal payloads of `least` bytes or more, those with the smallest page id are responses and the rest
    revisit them. A row without an id revisits like any other; where no row of a payload has one, all are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    large = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least) if least else rows
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by(F.coalesce("url", F.lit("")), "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    first = Scratch(pages.sparkSession, "warc-digests").table(first, "first")
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    rows = rows.join(first, "digest", "left").select("page_id", "url", "html", "first", "first_url")
    return rows.mapInArrow(partial(_write, root=root, date=date), "path string, records long")


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    files, _ = pyarrow.fs.FileSystem.from_uri(root)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"]
    for batch in batches:
        for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, seen = [], 0
            with files.open_input_stream(path, compression=None) as stream:
                for fields, size, digest, _ in records(stream, payloads=False):
                    again = fields["warc-type"] == "revisit"
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                    found.append((number("x-page-id"), number("x-payload-length") if again else size, fields["warc-payload-digest"].removeprefix("sha1:") if again else digest, fields["warc-type"], number("x-refers-to-page-id"), fields["warc-target-uri"]))
                    seen += 1
                    if len(found) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), _TYPES, strict=True)], names=names)
                        found = []
            if seen != count:
                raise ValueError(f"{path} holds {seen} records, not {count}")
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), _TYPES, strict=True)], names=names)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target) of the records of archives(path, records) below root, an archive to a task."""
    return archives.repartition(max(1, archives.count())).mapInArrow(partial(_read, root=root), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string")


def round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A null or empty html is an empty payload; very long ones are read in pieces; null ids and urls and repeated rows have records of their own (see
    write_archives for their types; of rows with one id and one payload none is preferred); an empty table gives an empty one. Other columns are
    passed over. A response's bytes and digest are counted from its payload; a revisit's, which has none, have to be those of the response it names, or that is an error.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    root = f"{scratch.root}/archives"
    fs = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
    fs.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(fs)
    listed = scratch.table(write_archives(pages, root, least, id_col=id_col, url_col=url_col, html_col=html_col), "listed")
    scratch.kept.add("archives")
    found = scratch.table(read_archives(listed, root).drop("target"), "found")
    named = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    astray = found.where("record_type = 'revisit'").join(named, ["refers_to", "payload_bytes", "payload_digest"], "left_anti").first()
    if astray is not None:
        raise ValueError(f"the record of page {astray.page_id} revisits {astray.refers_to}, which has another payload")
    scratch.drop("archives", "listed")
    return found

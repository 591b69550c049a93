"""WARC archives of web pages: written as gzip members, read back by a verified chain of record boundaries.

Writing: pages with equal payloads of at least ``least`` bytes keep one ``response`` record, that
of the smallest page id; the others become ``revisit`` records that refer to it.  A record's id
is a name-based UUID of its type, page id, digest and url, so that a repeated attempt writes the
same records and ``WARC-Refers-To`` names a record that exists.  Each record is a gzip member of
its own; a file starts with a ``warcinfo`` record.  A task writes files of about ``file_bytes``
under names of its own, and the manifest lists the files of the attempts that counted.

Reading: files are cut into chunks.  A task takes every gzip magic number in its chunk for a
candidate record; one that decompresses to a WARC header has a successor, the offset after its
member, and following successors inside the chunk gives the offset at which the candidate's
chain leaves it.  Such a candidate may lie inside a payload.  Pointer jumping from offset 0 of
each file, over those exits, finds the one true entry of each chunk in as many rounds as the
number of chunks has binary digits; chunks are then read from their entries, so that only
reachable records are returned.  Descriptors of chunks are tiny rows, so they are dealt to a
number of tasks that follows the number of chunks, not their bytes.

Empty cases: null html is an empty payload, a null url becomes a URN of the page id.  Pages
that share an id are records of their own; rows equal in id, url and payload have one record id,
as the same record.  A null id is written as such, never counts as the smallest unless all are
null, and revisits the smallest id of its payload where there is one.  An empty table writes nothing.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import scratch_path, small_batches, written
from .words import slices

_MAGIC = b"\x1f\x8b\x08"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
_MANIFEST = "path string, bytes long, records long"


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, chr(0).join(map(str, parts)))}>"


def _member(lines: list[str], block: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def file_head(name: str, date: str) -> bytes:
    """The ``warcinfo`` record that a file starts with, as a gzip member."""
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id('warcinfo', name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(lines, b"format: WARC File Format 1.1\r\n")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None, revisit: bool, date: str) -> bytes:
    """One gzip member.  A revisit holds the response's HTTP head alone, with the full payload's digest and size."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    kind = "revisit" if revisit else "response"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(kind, page, digest, url)}", f"WARC-Target-URI: {_safe(url) if url else f'urn:page:{page}'}"]
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {'' if page is None else page}", f"Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id('response', refers, digest, refers_url)}", f"Refers-To-Page-ID: {refers}"]
    return _member([*lines, "Content-Type: application/http; msgtype=response"], block)


def write_pages(
    pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, file_bytes: int = 32 << 20,
    date: str = "2024-01-01T00:00:00Z", few: int = 200_000,
) -> DataFrame:
    """Writes the archives; returns the manifest (path, bytes, records), a written table.

    Up to ``few`` repeated payloads are marked by a broadcast of their digests, and no payload is shuffled; more of them meet the pages in a join.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    small_batches(pages.sparkSession)
    first = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("m"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").select("digest", F.col("m.page_id").alias("first"), F.col("m.url").alias("first_url")), "repeated")
    planned = rows.join(F.broadcast(first) if first.limit(few + 1).count() <= few else first, "digest", "left").withColumn("revisit", F.expr(f"length(payload) >= {least} AND first IS NOT NULL AND NOT page_id <=> first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        out, done, name, size, n = None, [], "", 0, 0
        for batch in batches:
            for part in slices(batch, "payload"):
                for row in part.to_pylist():
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        head = file_head(name, date)
                        out.write(head)
                        size = len(head)
                    member = record(row["page_id"], row["url"], row["payload"], row["digest"], row["first"], row["first_url"], row["revisit"], date)
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= file_bytes:
                        out.close()
                        done.append((f"{folder}/{name}", size, n))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "bytes", "records"])

    return written(planned.select("page_id", "url", "payload", "digest", "first", "first_url", "revisit").mapInArrow(write, _MANIFEST), "manifest")


class _Window:
    """A growing stretch of one file: from ``begin``, at first up to ``end``, further only as far as a member reaches.

    Members are unpacked from the bytes at hand, so each byte is read once.
    """

    def __init__(self, path: str, begin: int, end: int, stretch: int = 1 << 17, step: int = 1 << 14):
        fs, name = _files(path)
        self.file, self.begin, self.stretch, self.step = fs.open_input_file(name), begin, stretch, step
        self.size = self.file.size()
        self.data, self.read = bytearray(), 0
        self._more(min(end, self.size) - begin)

    def _more(self, n: int) -> bool:
        at = self.begin + len(self.data)
        data = self.file.read_at(max(0, min(n, self.size - at)), at)
        self.read += len(data)
        self.data += data
        return bool(data)

    def drop(self, offset: int) -> None:
        """Forgets what lies before an offset."""
        if offset - self.begin >= self.stretch:
            del self.data[: offset - self.begin]
            self.begin = offset

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """(content, offset after it) of a gzip member, None where there is none whole or its content is no WARC record."""
        unpack, at, out, known = zlib.decompressobj(31), offset, [], False
        try:
            while at < self.begin + len(self.data) or self._more(self.stretch):
                data = self.data[at - self.begin : at - self.begin + self.step]
                out.append(unpack.decompress(data))
                at += len(data)
                if unpack.eof:
                    return b"".join(out), at - len(unpack.unused_data)
                if not known and sum(map(len, out)) >= 10:
                    known = True
                    if not _HEAD.match(b"".join(out)[:10]):
                        return None
        except zlib.error:
            return None
        return None


def _parsed(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(header fields in lower case, block) of a WARC record, None if it is none."""
    if not _HEAD.match(content):
        return None
    head, found, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    length = fields.get("content-length", "")
    if not found or not length.isdigit() or len(rest) < int(length):
        return None
    return fields, rest[: int(length)]


def _tasks(manifest: DataFrame, chunk: int, chunks_a_task: int = 16) -> int:
    """Tasks for the chunks of all files: one a chunk until the cores are busy, then ``chunks_a_task`` chunks each."""
    chunks = manifest.agg(F.coalesce(F.sum(F.expr(f"greatest(bytes - 1, 0L) div {chunk} + 1")), F.lit(0))).first()[0]
    return max(1, min(chunks, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-chunks // chunks_a_task))))


def candidates(manifest: DataFrame, chunk: int) -> DataFrame:
    """(path, at, successor, leaves): each record candidate, its successor, and where its chain leaves its chunk."""
    chunks = manifest.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L) div {chunk})")).alias("k"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["k"] * chunk
                window = _Window(row["path"], start, start + chunk + 2)
                found, at = [], window.data.find(_MAGIC, 0, chunk + 2)
                while at >= 0:
                    member = window.member(start + at)
                    if member and _parsed(member[0]):
                        found.append((start + at, member[1]))
                    at = window.data.find(_MAGIC, at + 1, chunk + 2)
                window.file.close()
                leaves: dict[int, int] = {}
                for place, after in reversed(found):
                    leaves[place] = leaves.get(after, after)
                kept = [(row["path"], p, after, leaves[p]) for p, after in found]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept, strict=True)], names=["path", "at", "successor", "leaves"])

    return chunks.repartition(_tasks(manifest, chunk)).mapInArrow(scan, "path string, at long, successor long, leaves long")


def entries(found: DataFrame, manifest: DataFrame, chunk: int) -> DataFrame:
    """(path, at): the first reachable record of each chunk, by pointer jumping from offset 0 of each file."""
    longest = manifest.agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    jumps = found.select("path", "at", F.col("leaves").alias("to"))
    reached = manifest.select("path", F.lit(0).cast("long").alias("at"))
    for _ in range(max(1, (longest // chunk + 1).bit_length())):
        reached = reached.unionAll(reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))).distinct()
        jumps = jumps.join(jumps.select("path", F.col("at").alias("to"), F.col("to").alias("further")), ["path", "to"], "left").select("path", "at", F.coalesce("further", "to").alias("to"))
        reached, jumps = written(reached, "reached"), written(jumps, "jumps")
    return reached


def read_records(manifest: DataFrame, *, chunk: int = 4 << 20) -> DataFrame:
    """Per reachable record: page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes,
    payload_digest (of the full payload) and sound (the payload read has the digest recorded)."""
    found = written(candidates(manifest, chunk), "candidates")
    starts = entries(found, manifest, chunk)
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, sound boolean"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, out, held = row["at"], [], 0
                until = (at // chunk + 1) * chunk
                window = _Window(row["path"], at, until)
                while at < min(until, window.size):
                    window.drop(at)
                    member = window.member(at)
                    parsed = member and _parsed(member[0])
                    if not parsed:
                        raise ValueError(f"no record at {at} of {row['path']}")
                    (fields, block), at = parsed, member[1]
                    if fields["warc-type"] == "warcinfo":
                        continue
                    revisit = fields["warc-type"] == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    recorded = fields["warc-payload-digest"].removeprefix("sha256:")
                    digest = recorded if revisit else hashlib.sha256(payload).hexdigest()
                    size = int(fields["payload-length"]) if revisit else len(payload)
                    out.append((int(fields["page-id"]) if fields.get("page-id") else None, fields.get("warc-target-uri"), fields["warc-type"], int(fields["refers-to-page-id"]) if revisit else None, payload, size, digest, digest == recorded))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
                window.file.close()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return starts.repartition(_tasks(manifest, chunk)).mapInArrow(walk, schema)


def round_trip(pages: DataFrame, *, folder: str | None = None, chunk: int = 4 << 20, **options) -> DataFrame:
    """``write_pages`` into ``folder`` (else a scratch folder), then ``read_records`` of what lies there."""
    folder = folder or scratch_path(pages.sparkSession, "archives")
    return read_records(write_pages(pages, folder, **options), chunk=chunk)

"""Web archives (WARC): written by a data source with task files and a commit, read back by a salvage reader.

Writing: every row becomes a record of its own gzip member (or plain, by option). Of records
with equal payloads one is the response, and the others revisit it without a payload.
Files are written by tasks under ``_temporary`` and moved in place when the job commits, so a
task that ran twice leaves no record twice; a file is closed at ``roll`` bytes.

Reading: a task takes a range of a file, from the first record that begins in it, by random
reads. Every record is checked: the member's checksum, the lengths, the blank lines behind it
and the digests. After a failed check the reader searches for the next valid member or version
line and goes on there; the bytes between are a row of the gap log. Where a range begins is a
guess (a payload may hold an archive of its own), so each range says where it began and where
the next one has to: files in which these disagree are read again from their start, in one task.

Odd input: a null html is an empty payload; a null or empty url gives no target; a null page_id
is smaller than any other and comes back as null; rows that repeat both page_id and payload are
written each, with one record id; an empty table gives an archive without records; payloads
of any length are a record each, held one at a time; columns other than page_id, url and html
are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window

from .common import join_hot, materialize, split_by

#: Version lines, and the profile of a revisit by payload.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
BLANK = b"\r\n\r\n"
#: Bytes of an archive file before the next is begun, of a range that one task reads, of a read, and of a batch of rows.
ROLL, SPAN, CHUNK, BATCH = 256 << 20, 64 << 20, 1 << 16, 8 << 20
#: Longest header of a record.
HEADER = 1 << 20


def store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or URI, as tasks reach it."""
    if "://" not in path and not path.startswith("file:"):
        return stores.LocalFileSystem(), path
    return stores.FileSystem.from_uri(path)


def base32_sha1(binary: Column) -> Column:
    """Upper-case base32 of the SHA-1, by DataFrame functions: five hexadecimal digits are four letters."""
    text = F.sha1(binary)
    quarter = lambda k: F.lpad(F.conv(F.substring(text, 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*(quarter(k) for k in range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def records(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, record_type and refers_to of every page.

    Of pages with equal payloads of at least ``revisit_from`` bytes the one with the largest
    page_id is the response, and the others' payloads are left out. Payloads that have no
    copy are told apart without a shuffle; digests of many pages are joined apart.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    copies = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"), F.first("payload_bytes").alias("size")).where("n > 1").where(F.col("size") >= revisit_from).drop("size"))
    alone, perhaps = split_by(rows, F.col("digest"), copies, "digest")
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_hot(perhaps, "digest", copies, "digest", "n", total).drop("n").unionByName(alone.withColumn("last", F.lit(None).cast("long")))
    again = F.coalesce(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"),
    )


RECORDS = "page_id long, url string, payload binary, payload_bytes long, digest string, record_type string, refers_to long"


def _name(page: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def record_bytes(row: dict, date: str) -> bytes:
    """One record: its header, the HTTP header and the payload, blank lines."""
    length = row["payload_bytes"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (row["payload"] or b"")
    lines = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'], row['digest'])}", f"WARC-Date: {date}"]
    if row["url"]:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(row['refers_to'], row['digest'])}"]
    lines += [f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Block-Digest: sha1:{sha1_of(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BLANK + block + BLANK


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written."""

    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.gzip = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip"
        self.roll, self.date = int(options.get("roll", ROLL)), options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        files.create_dir(f"{root}/_temporary", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = files.open_output_stream(f"{root}/_temporary/{names[-1]}", compression=None), 0
                raw = record_bytes({c: batch.column(c)[k].as_py() for c in batch.schema.names}, self.date)
                if self.gzip:
                    raw = gzip.compress(raw, 4, mtime=0)
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        files.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                files.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store(self.path))

    def _clear(self, files: stores.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_temporary").type == stores.FileType.Directory:
            files.delete_dir(f"{root}/_temporary")


class WarcSource(DataSource):
    """``df.write.format("warc")`` for rows of ``RECORDS``; options path, compression (gzip or none), roll, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def write(found: DataFrame, path: str, **options: str) -> None:
    """Write rows of ``records`` as archive files in the folder ``path``."""
    found.sparkSession.dataSource.register(WarcSource)
    found.select(*(c.split()[0] for c in RECORDS.split(", "))).write.format("warc").options(path=path, **options).mode("append").save()


class Bad(Exception):
    """A failed check, with the place behind the record where its frame is whole."""

    def __init__(self, why: str, end: int | None = None):
        super().__init__(why)
        self.end = end


class Archive:
    """Random reads of a file, by chunks of which the last few are kept."""

    def __init__(self, files: stores.FileSystem, path: str):
        self.file = files.open_input_file(path)
        self.size = self.file.size()

    def at(self, start: int, length: int) -> bytes:
        return self.file.read_at(max(0, min(length, self.size - start)), start)

    def find(self, start: int) -> Iterator[int]:
        """Places from ``start`` on that look like the beginning of a record."""
        while start < self.size:
            window = self.at(start, CHUNK + 16)
            for m in START.finditer(window):
                if m.start() < CHUNK:
                    yield start + m.start()
            start += CHUNK

    def record(self, start: int) -> tuple[list[dict], int]:
        """The records that begin at ``start`` (several if they share a member), and where the next begins."""
        head = self.at(start, 16)
        if head[:3] == b"\x1f\x8b\x08":
            raw, end = self._member(start)
            found, place = [], 0
            while place < len(raw):
                one, place = self._parse(lambda a, n, raw=raw: raw[a : a + n], place, end)
                found.append(one)
            return found, end
        if START.match(head):
            one, end = self._parse(self.at, start, None)
            return [one], end
        raise Bad("no record begins here")

    def _member(self, start: int) -> tuple[bytes, int]:
        inflate, out, place = zlib.decompressobj(31), [], start
        while not inflate.eof:
            piece = self.at(place, CHUNK)
            if not piece:
                raise Bad("member is cut off")
            try:
                out.append(inflate.decompress(piece))
            except zlib.error:
                raise Bad("member is damaged") from None
            if place == start and len(out[0]) > 8 and not START.match(out[0]):
                raise Bad("member holds no record")
            place += len(piece)
        return b"".join(out), place - len(inflate.unused_data)

    def _parse(self, at, start: int, member_end: int | None) -> tuple[dict, int]:
        """A record by reads ``at(place, length)``; ``member_end`` is where its member ends, if it has one."""
        raw = at(start, CHUNK)
        if (cut := raw.find(BLANK)) < 0:
            raw = at(start, HEADER)
            cut = raw.find(BLANK)
        lines = raw[:cut].split(b"\r\n") if cut >= 0 else [b""]
        if not START.match(lines[0] + b"\r\n"):
            raise Bad("header has no end" if cut < 0 else "no version line", member_end)
        fields = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines[1:])}
        length = fields.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,15}", length):
            raise Bad("no length", member_end)
        begin, length = start + cut + 4, int(length)
        if at(begin + length, 4) != BLANK:
            raise Bad("length is wrong", member_end)
        block, end = at(begin, length), begin + length + 4
        frame = member_end
        if frame is None and (end == self.size or START.match(at(end, 16))):
            frame = end
        http = fields.get("content-type", "").startswith("application/http")
        top, _, payload = block.partition(BLANK) if http else (b"", b"", block)
        kind, said = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
        if (known := fields.get("warc-block-digest", "")).startswith("sha1:") and known[5:] != sha1_of(block):
            raise Bad("block digest differs", frame)
        if kind != "revisit" and said.startswith("sha1:") and said[5:] != sha1_of(payload):
            raise Bad("payload digest differs", frame)
        told = re.search(rb"(?im)^content-length:\s*([0-9]{1,15})\s*$", top.replace(b"\r\n", b"\n")) if kind == "revisit" else None
        return {"type": kind, "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to_id": fields.get("warc-refers-to"), "digest": said[5:] if kind == "revisit" else sha1_of(payload), "payload": payload, "payload_bytes": int(told[1]) if told else len(payload)}, end


#: kind is record, gap or range. start and end are bytes of the file; of a range, where its first record and the first of the next range begin.
_READ = "kind string, file string, range long, start long, end long, reason string, type string, record_id string, url string, refers_to_id string, digest string, payload binary, payload_bytes long"
_NAMES = [c.split()[0] for c in _READ.split(", ")]


def salvage(files: stores.FileSystem, path: str, begin: int, stop: int) -> Iterator[dict]:
    """Records and gaps that begin in bytes [begin, stop) of a file, and where its range began and ended."""
    archive = Archive(files, path)

    def valid(place: int) -> int:
        for found in archive.find(place):
            try:
                archive.record(found)
                return found
            except Bad:
                pass
        return archive.size

    place = first = valid(begin) if begin else 0
    while place < min(stop, archive.size):
        try:
            found, end = archive.record(place)
            for one in found:
                yield {"kind": "record", "start": place, "end": end, **one}
        except Bad as failed:
            end = failed.end if failed.end is not None else valid(place + 1)
            yield {"kind": "gap", "start": place, "end": end, "reason": str(failed)}
        place = end
    yield {"kind": "range", "start": first, "end": place}


def _scan(payloads: bool):
    texts = {"kind", "file", "reason", "type", "record_id", "url", "refers_to_id", "digest"}
    shape = pa.schema([(c, pa.string() if c in texts else pa.binary() if c == "payload" else pa.int64()) for c in _NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.to_pylist():
                held, size = [], 0
                for row in salvage(*store(at["file"]), at["begin"], at["stop"]):
                    size += 500 + len(row.get("payload") or b"")
                    held.append({**row, "file": at["file"], "range": at["begin"]} | ({} if payloads else {"payload": None}))
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(held, shape)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, shape)

    return run


def scan(spark: SparkSession, path: str, payloads: bool = True, span: int = SPAN) -> DataFrame:
    """Rows of ``_READ`` for all files of a folder: records, gaps, ranges; a task for each range of ``span`` bytes."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    ranges = listed.select("file", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(span))).alias("begin"), "length").select("file", "begin", F.least(F.col("begin") + span, "length").alias("stop"))
    rows = materialize(_dealt(ranges).mapInArrow(_scan(payloads), _READ))
    begun = F.lag("end").over(Window.partitionBy("file").orderBy("range"))  # a row for a range
    wrong = materialize(rows.where("kind = 'range'").withColumn("begun", begun).where("begun <> start").select("file").distinct())
    if not wrong.take(1):
        return rows
    again = listed.join(wrong, "file", "left_semi").select("file", F.lit(0).cast("long").alias("begin"), F.col("length").alias("stop"))
    return materialize(rows.join(wrong, "file", "left_anti").unionByName(_dealt(again).mapInArrow(_scan(payloads), _READ)))


def _dealt(ranges: DataFrame) -> DataFrame:
    """A range goes to a task of its own, or nearly."""
    spark = ranges.sparkSession
    n = max(ranges.count(), 1)
    return ranges.repartition(min(n, 8 * spark.sparkContext.defaultParallelism) if n < 10_000 else n // 4, "file", "begin")


_ID = r"^<urn:page:([0-9-]+):"


def read(scanned: DataFrame) -> DataFrame:
    """file, start, end, page_id, url, payload, payload_bytes, digest, record_type and refers_to of every response and revisit."""
    number = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), _ID, 1).try_cast("long")
    found = scanned.where("kind = 'record' and type in ('response', 'revisit')")
    return found.select("file", "start", "end", number(F.col("record_id")).alias("page_id"), "url", "payload", "payload_bytes", "digest", F.col("type").alias("record_type"), number(F.col("refers_to_id")).alias("refers_to"))


def gaps(scanned: DataFrame) -> DataFrame:
    """file, start, end and reason of the bytes that were passed over."""
    return scanned.where("kind = 'gap'").select("file", "start", "end", "reason")


def round_trip(pages: DataFrame, path: str, revisit_from: int = 0, **options: str) -> DataFrame:
    """Archives of ``pages`` in ``path``, read back without their payloads."""
    write(records(pages, revisit_from), path, **options)
    return read(scan(pages.sparkSession, path, payloads=False)).drop("payload")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
d AS (SELECT page_id, payload_bytes, (SELECT translate(string_agg(to_base(('0x' || substr(x, 5 * k + 1, 5))::BIGINT, 32, 4), '' ORDER BY k), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') FROM range(8) t(k)) AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""

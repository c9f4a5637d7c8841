"""WARC archives written and read as tables of record chunks.

Writing: every page becomes a `response` record, or a `revisit` of the response with the smallest id among equal
payloads of at least min_revisit bytes. A payload over chunk_bytes is cut into WARC segments (WARC-Segment-Number,
`continuation` records), so no writer or reader holds more than a chunk beside the cell that Spark hands over. The
archives are WARC 1.1 in gzip, one gzip member for each file, written by Spark's text sink through its commit protocol to
any file system that Spark knows: each record is a row with the header lines and a row with the block, and the sink's line
separator, two CRLF pairs, is just what the format puts after both. Each record has an identifier of its own, made of the
job, the task and a count; a revisit names its response by target URI and date, which the format offers for that.

Reading: lines stream through a parser that cuts the bytes by Content-Length, and gives a row for each record and chunk
number with the running length and the running SHA-256, so the last chunk of a record has the payload's digest. It takes
WARC 1.0 and 1.1, header names in any case, records of any type and target, and files without a stated digest. Files must
be compressed with gzip, as others would be split between tasks. Blocks are taken as they are: of an `application/http`
record the HTTP head counts as part of it.

Defined cases: a null payload is empty; a null id is written as an empty id and read as null, and is the smallest id
among equal payloads, so that such a group's revisits refer to null; of equal ids with equal payloads every row is a
response (they are the row that the others refer to); an empty table gives an empty archive; other columns are neither
read nor written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, text_bytes

END, VERSIONS = b"\r\n\r\n", (b"WARC/1.1", b"WARC/1.0")
PAGE = b"urn:page:"
#: Repeated digests that are sent whole to each task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
CHUNKS = "record_id string, target_uri string, page_id long, record_type string, chunk_no int, chunk_bytes long, running_bytes long, running_sha256 string, full_bytes long, stated_digest string, refers_to long, last boolean"


def plan_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_revisit: int = 100) -> tuple[DataFrame, DataFrame]:
    """page_id, data, digest, refers_to and is_revisit of each page; and the written table of repeats that this reads.

    Digests that occur twice are counted before any shuffle and written as a small table. Up to BROADCAST_ROWS of them, by
    its count, go to each task and payloads stay where they are; more are joined, and the join's hot keys can be split at
    run time.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), text_bytes(payload).alias("data"))
    rows = rows.withColumn("digest", F.sha2("data", 256))
    long_enough = F.octet_length("data") >= min_revisit
    same = rows.where(long_enough).groupBy("digest").agg(F.min(F.struct("page_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = materialize(same.select(F.col("digest").alias("_digest"), "first"), "repeats")
    same = F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats
    joined = rows.join(same, (rows["digest"] == same["_digest"]) & long_enough, "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select("page_id", "data", "digest", F.when(again, F.col("first.page_id")).alias("refers_to"), again.alias("is_revisit")), repeats


def _record(kind: bytes, name: bytes, date: bytes, page: bytes, block: bytes, *more: bytes) -> Iterator[bytes]:
    yield b"\r\n".join([VERSIONS[0], b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, b"WARC-Date: " + date, b"WARC-Target-URI: " + PAGE + page, b"Content-Type: text/html", b"Content-Length: %d" % len(block), *more])
    yield block


def record_rows(names: Iterator[bytes], date: bytes, page_id: int | None, data: bytes, digest: str, refers_to: int | None, revisit: bool, chunk_bytes: int) -> Iterator[bytes]:
    """The header and block rows of a page's records. names: identifiers that no other record has."""
    page, name = b"" if page_id is None else b"%d" % page_id, next(names)
    stated = [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % len(data)]
    if revisit:
        to = b"" if refers_to is None else b"%d" % refers_to
        yield from _record(b"revisit", name, date, page, b"", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To-Target-URI: " + PAGE + to, b"WARC-Refers-To-Date: " + date, *stated)
        return
    view = memoryview(data)
    count = max(1, -(-len(data) // chunk_bytes))
    for i in range(count):
        block = bytes(view[i * chunk_bytes : (i + 1) * chunk_bytes])
        if count == 1:
            more = stated
        else:
            more = [*(stated if i == 0 else [b"WARC-Segment-Origin-ID: " + name]), b"WARC-Segment-Number: %d" % (i + 1)]
            more += [b"WARC-Segment-Total-Length: %d" % len(data)] * (i == count - 1)
        yield from _record(b"continuation" if i else b"response", next(names) if i else name, date, page, block, *more)


def record_names(job: uuid.UUID, task: int) -> Iterator[bytes]:
    """Record identifiers; a task that runs again gives the same."""
    count = 0
    while True:
        yield b"<urn:uuid:" + str(uuid.uuid5(job, f"{task}/{count}")).encode() + b">"
        count += 1


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", min_revisit: int = 100, chunk_bytes: int = 1 << 20, batch_bytes: int = 4 << 20, date: datetime | None = None) -> None:
    """Write the archives of all pages to the folder path, a file for each task. date: of the capture, now if it isn't given."""
    job, when = uuid.uuid4(), (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ").encode()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, names = [], 0, record_names(job, TaskContext.get().partitionId())
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for line in record_rows(names, when, *(x.as_py() for x in row), chunk_bytes):
                    out.append(line)
                    size += len(line)
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    planned, repeats = plan_revisits(pages, key, payload, min_revisit)
    rows = planned.mapInArrow(lines, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)
    discard(repeats)


class ChunkParser:
    """Cuts a stream of bytes into records; keeps a header or the rest of a line at most, never a whole payload."""

    def __init__(self) -> None:
        self.left, self.head, self.rest = -1, [], b""
        self.chunk, self.skip = {}, 0
        self.running: dict = {}

    def feed(self, line: bytes) -> Iterator[tuple]:
        """line: bytes up to and with a line feed, or any piece of a block."""
        while line:
            if self.left < 0:  # between records or in a header
                end = line.find(b"\n")
                if end < 0:
                    self.rest += line
                    return
                one, line = (self.rest + line[:end]).rstrip(b"\r"), line[end + 1 :]
                self.rest = b""
                if one:
                    self.head.append(one)
                elif self.head:
                    self._begin()
                    if self.left == 0:
                        yield self._end()
                continue
            part, line = line[: self.left], line[self.left :]
            self.running["sha"].update(part)
            self.running["bytes"] += len(part)
            self.left -= len(part)
            if self.left == 0:
                yield self._end()

    def _begin(self) -> None:
        if self.head[0] not in VERSIONS:
            raise ValueError(f"not the start of a record: {self.head[0][:80]!r}")
        h: dict[bytes, bytes] = {}
        for line in self.head[1:]:
            name, _, value = line.partition(b":")
            h.setdefault(name.strip().lower(), value.strip())
        self.head, self.chunk, self.left = [], h, int(h[b"content-length"])
        if h[b"warc-type"] != b"continuation":
            self.running = {"sha": hashlib.sha256(), "bytes": 0, "of": h, "no": 0}
        elif h[b"warc-segment-origin-id"] != self.running["of"][b"warc-record-id"] or int(h[b"warc-segment-number"]) != self.running["no"] + 1:
            raise ValueError("a segment is out of order")

    def _end(self) -> tuple:
        run, h = self.running, self.chunk
        of, self.left = run["of"], -1
        run["no"] += 1
        number = lambda uri: int(x) if uri.startswith(PAGE) and (x := uri[len(PAGE) :]).removeprefix(b"-").isdigit() else None
        text = lambda name: of[name].decode("utf-8", "replace") if name in of else None
        last = b"warc-segment-total-length" in h or b"warc-segment-number" not in h
        digest = text(b"warc-payload-digest") or ""
        whole = int(of[b"x-payload-length"]) if b"x-payload-length" in of else None
        target, to = (of.get(x, b"") for x in (b"warc-target-uri", b"warc-refers-to-target-uri"))
        return text(b"warc-record-id"), text(b"warc-target-uri"), number(target), text(b"warc-type"), run["no"], int(h[b"content-length"]), run["bytes"], run["sha"].hexdigest(), whole, digest.removeprefix("sha256:") if digest.startswith("sha256:") else None, number(to), last


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    parser = ChunkParser()
    for batch in batches:
        out = [row for line in batch.column(0) for row in parser.feed(line.as_py() + b"\n")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives in the folder path: record id, chunk number, lengths and running digests."""
    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(_parse, CHUNKS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page, from the last chunk of its record; fails where a response differs from its stated digest or length.
    What a record doesn't state, as of ordinary archives, is what was read; a revisit's own payload isn't there to be read."""
    ends = read_chunks(spark, path).where("last").withColumn("_again", F.col("record_type") == "revisit")
    same = lambda stated, read: F.col(stated).isNull() | (F.col(stated) == F.col(read))
    whole = F.col("_again") | (same("stated_digest", "running_sha256") & same("full_bytes", "running_bytes"))
    of = lambda stated, read: F.when(F.col("_again"), F.col(stated)).otherwise(F.coalesce(stated, read))
    digest = F.when(whole, of("stated_digest", "running_sha256")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id"))))
    return ends.select("page_id", of("full_bytes", "running_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")

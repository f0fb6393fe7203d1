"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id. A range is the ids whose records begin in the same ``range_bytes`` of all records' bytes
in the order of their ids: exact prefix sums, so ranges depend neither on a sample nor on the number of partitions (rows
of one id are in one range). A task writes its ranges as gzip members, one per record, and rolls to the next file once
the compressed size passes ``roll_bytes``. Headers and digests are regenerated from the payload. A file is
written under a temporary name of its own attempt and renamed when complete, so a retried or speculative task replaces
a file by an equal one; names and bytes depend only on the records. The task returns a manifest row per file, Spark
writes the rows as the manifest, and readers open only what the manifest lists."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranktide.llm.common import batches, bounded_batches, each_row, materialise

ROLL_BYTES = 64 << 20
RANGE_BYTES = 16 << 20  # before compression
READ_BYTES = 4 << 20  # compressed, of one reading task
OVERHEAD = 512  # bytes that a record counts besides url and payload
LEVEL = 4
MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload binary")
_MANIFEST_ARROW = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                             ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    number = urn[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header only, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page)),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([("WARC-Refers-To", _id(refers_to)),
           ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class _Roller:
    """The files of one range."""

    def __init__(self, root: str, part: int, roll_bytes: int):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.part, self.roll, self.serial, self.out = part, roll_bytes, 0, None

    def add(self, page: int | None, data: bytes):
        """Write a record; yields a manifest row when a file is complete."""
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.serial:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.out, self.hash = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
            self.records = self.bytes = 0
            self.first = page
        packed = gzip.compress(data, LEVEL, mtime=0)
        self.out.write(packed)
        self.hash.update(packed)
        self.records, self.bytes, self.last = self.records + 1, self.bytes + len(packed), page
        if self.bytes >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.serial += 1
        return self.name, self.records, self.bytes, self.hash.hexdigest(), self.first, self.last


def _first_copies(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, refers_to) of each page whose payload a smaller page_id has: digests are grouped, never payloads."""
    sized = pages.select("page_id", F.sha1(F.encode("_html", "UTF-8")).alias("_sha"),
                         F.octet_length("_html").alias("_n")).where(F.col("_n") >= min_bytes)
    firsts = sized.groupBy("_sha", "_n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_rows"))
    return (sized.join(firsts.where("_rows > 1"), ["_sha", "_n"])
            .select("page_id", "refers_to", "_sha").distinct())


def ranges(pages: DataFrame, range_bytes: int) -> DataFrame:
    """(page_id, range) of each id of ``pages`` (page_id, bytes): the number of bytes of all smaller ids' rows (null is
    the smallest) over ``range_bytes``, rounded down."""
    each = pages.groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    ordered = materialise(each.repartitionByRange("page_id").sortWithinPartitions("page_id")
                          .withColumn("part", F.spark_partition_id()), "sizes")
    parts = ordered.groupBy("part").agg(F.sum("bytes").alias("all"))  # a row for each partition
    before = parts.select("part", F.coalesce(F.sum("all").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.sum("bytes").over(Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    return (ordered.withColumn("inside", inside).join(before, "part")
            .select("page_id", F.floor((F.col("start") + F.col("inside")) / range_bytes).alias("range")))


def write(pages: DataFrame, root: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES,
          partitions: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``root`` and return the manifest.

    Of the records with equal payloads of at least ``min_revisit_bytes`` that with the smallest page_id is the
    response and the others refer to it; of repeated rows of that page the first is. A null html is an empty payload,
    a null url an empty one; a null page_id sorts first and is never referred to. Extra columns are ignored. No rows
    give a manifest without rows. A group of copies costs one row per copy, without its payload."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("_html"))
    marks = _first_copies(rows, min_revisit_bytes)
    # a mark (kind 0) sorts before the pages it is for: one shuffle brings both together
    both = (
        rows.select("page_id", F.lit(1).alias("kind"), "url", "_html", F.lit(None).cast("long").alias("refers_to"))
        .unionByName(marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                                  F.col("_sha").alias("_html"), "refers_to"))
    )
    size = F.octet_length(F.coalesce("url", F.lit(""))) + F.octet_length("_html") + F.lit(OVERHEAD)
    of = materialise(ranges(rows.select("page_id", size.cast("long").alias("bytes")), range_bytes), "ranges")
    ranged = both.join(of.withColumnRenamed("page_id", "_page"), F.col("page_id").eqNullSafe(F.col("_page"))).drop("_page")
    dealt = ranged.repartition(partitions, "range") if partitions else ranged.repartition("range")
    ordered = dealt.sortWithinPartitions("range", "page_id", "kind", "url", "_html").select(
        "page_id", "kind", "url", "_html", "refers_to", "range")

    def work(it):
        def files():
            page, marked, written = object(), {}, set()
            roller = None
            for p, kind, url, html, first, part in each_row(it):
                if roller is None or roller.part != part:
                    if roller is not None and roller.out is not None:
                        yield roller.close()
                    roller = _Roller(root, part, roll_bytes)
                if p != page:
                    page, marked, written = p, {}, set()
                if kind == 0:
                    marked[html] = first
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                sha = hashlib.sha1(payload).hexdigest()
                first = marked.get(sha)
                revisit = first is not None and (first != p or sha in written)
                written.add(sha)
                yield from roller.add(p, record(p, url, payload, first, revisit))
            if roller is not None and roller.out is not None:
                yield roller.close()

        yield from batches(files(), _MANIFEST_ARROW)

    spark = pages.sparkSession
    where, top = fs.FileSystem.from_uri(root)
    where.create_dir(top)
    manifest = f"{root}/_manifest"
    ordered.mapInArrow(work, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


class _Counted:
    """A stream that counts and hashes what is read of it."""

    def __init__(self, raw):
        self.raw, self.bytes, self.hash = raw, 0, hashlib.sha256()

    def read(self, size: int = -1) -> bytes:
        data = self.raw.read() if size is None or size < 0 else self.raw.read(size)
        self.bytes += len(data)
        self.hash.update(data)
        return data


def records(stream):
    """(headers, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def read(manifest: DataFrame, root: str, payload: bool = True) -> DataFrame:
    """The records of the files that ``manifest`` lists: page_id, payload_bytes, payload_digest, record_type,
    refers_to and, for responses, the payload. Digests are computed again and must be those of the headers; a file's
    bytes, their sha256, its number of records and its first and last id must be those of the manifest."""
    kept = READ if payload else READ.removesuffix(", payload binary")
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)

    def one(head, block):
        http, _, body = block.partition(b"\r\n\r\n")
        lengths = [int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"]
        own = head["warc-payload-digest"].removeprefix("sha1:")
        response = head["warc-type"] == "response"
        if head["warc-block-digest"] != f"sha1:{digest(block)}" or response and (digest(body) != own or len(body) != lengths[0]):
            raise ValueError(f"digest of {head['warc-record-id']} does not hold")
        row = (_page(head["warc-record-id"]), lengths[0], own, head["warc-type"],
               None if response else _page(head["warc-refers-to"]))
        return row + (body if response else None,) if payload else row

    def work(it):
        where, top = fs.FileSystem.from_uri(root)

        def rows():
            for name, *stated in each_row(it):
                with where.open_input_stream(f"{top}/{name}", compression=None) as raw:
                    counted = _Counted(raw)
                    number, first, last = 0, None, None
                    with gzip.GzipFile(fileobj=counted) as f:
                        for head, block in records(f):
                            row = one(head, block)
                            first, last, number = row[0] if not number else first, row[0], number + 1
                            yield row
                if [number, counted.bytes, counted.hash.hexdigest(), first, last] != stated:
                    raise ValueError(f"{name} is not the file that the manifest lists")

        yield from batches(rows(), arrow, 256)

    # AQE would fold the few names into one task: the number of tasks follows the archives' bytes
    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(files, math.ceil(size / READ_BYTES)))
    listed = manifest.select("file", "records", "bytes", "sha256", "first_id", "last_id")
    return listed.repartition(tasks, "file").mapInArrow(work, kept)

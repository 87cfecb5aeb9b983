"""WARC archives with an index of byte ranges.

Writing: each task appends one gzip member per record to an archive file of
bounded size in shared storage, and emits an index row (archive, offset, length,
URL, digest) for each record, after the file is closed. The index becomes a
table before anything is read, so a task that is run again leaves at most an
archive that no row names.

Reading: index rows are selected with ordinary DataFrame filters, dealt by
archive and block of offsets, sorted, and neighbouring ranges are coalesced into
one read each. Every payload is checked against its digest.

Records with equal payloads are stored once: the row of the largest page_id is a
``response``, the others are ``revisit`` records that refer to it and carry the
HTTP header only. Payloads under ``least`` bytes are always responses.

Defined results: a null html is an empty payload; a null URL has no target
header and reads back as null; a null page_id is always a response; rows that
repeat the largest page_id are responses each; an empty table gives an empty
index and result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.shared import narrowed, new_folder, tidy

LEAST = 1000
ARCHIVE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20
#: Two ranges are read together if no more than this lies between them.
GAP_BYTES = 64 << 10
#: Digests that have copies are sent to all tasks up to this many (under 100 bytes each).
BROADCAST_ROWS = 200_000
INDEX = "archive string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
_ID = "urn:x-page:"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a record that refers to another holds no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one uncompressed WARC record; the payload's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(_ID)) else None
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"), "url": None if url is None else unquote(url), "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, and refers_to for copies of another row's payload."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    copies = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last")).where("first <> last").select("digest", "first")
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    joined = rows.join(copies, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) below folder; returns the index, read from its table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(f"{root}/archives", recursive=True)
        stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, name, rows, offset = None, "", [], 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64())]))

        count = 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"archives/{stem}-{count:04d}.warc.gz"
                    out, rows, offset, count = fs.open_output_stream(f"{root}/{name}", compression=None), [], 0, count + 1
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, digest, refers_to, date)) + packer.flush()
                out.write(member)
                rows.append({"archive": name, "offset": offset, "length": len(member), "url": url, "digest": digest, "record_type": "response" if refers_to is None else "revisit", "page_id": page_id})
                offset += len(member)
                if offset >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    typed(narrowed(pages, page_id="page_id", url="url", html="html"), least).mapInArrow(tidy(write), INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, places in the list) of reads that cover sorted (offset, length) ranges."""
    start = end = 0
    members: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if members and (offset > end + gap or offset + length - start > most):
            yield start, end, members
            members = []
        if not members:
            start, end = offset, offset + length
        end = max(end, offset + length)
        members.append(i)
    if members:
        yield start, end, members


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the selected index rows point to."""
    spark = selected.sparkSession
    block = F.floor(F.col("offset") / BLOCK_BYTES)
    dealt = selected.select("archive", "offset", "length").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive", block).sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            archives, offsets, lengths = (c.to_pylist() for c in batch.columns)
            lo = 0
            while lo < len(archives):
                hi = lo
                while hi < len(archives) and archives[hi] == archives[lo]:
                    hi += 1
                with fs.open_input_file(f"{root}/{archives[lo]}") as file:
                    for start, end, members in coalesced(list(zip(offsets[lo:hi], lengths[lo:hi], strict=True))):
                        data = file.read_at(end - start, start)
                        rows = [parse(zlib.decompress(data[(at := offsets[lo + i] - start) : at + lengths[lo + i]], 31)) for i in members]
                        if not with_payload:
                            for r in rows:
                                r["payload"] = None
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
                lo = hi

    return dealt.mapInArrow(tidy(read), RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for every page, then read all of them back through the index."""
    folder = new_folder(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.page_id < f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 1000
"""

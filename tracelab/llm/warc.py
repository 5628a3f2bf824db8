"""WARC archives with an index (operator 8).

Writing puts one record for each page into gzip-per-record archives and an
index beside them: file, offset, length, URL and digest of each record. Pages
with equal payloads have one response record, the others are revisits.
Reading goes by the index first: the chosen records are sorted by file and
offset, and those that lie close together are fetched by one byte-range read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import batch_of, new_file, read_range, shared_dir, small_batches, stored, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CHUNK = 8 << 20  #: records that begin in the same chunk of a file are read by one task; bytes of one read at most
GAP = 64 << 10  #: a smaller gap between chosen records is read over
INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    found = uri.strip("<>").rpartition(":")[2]
    return None if found == "none" else int(found)


def make_record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP header of its payload alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def parse_record(data: bytes) -> dict:
    """What a record says; the payload of a response is checked against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page_of(refers) if refers else None}


def plan_records(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """For each page: its payload's SHA-1 and size, and the page that a revisit refers to.

    Of pages with equal payloads of ``min_bytes`` or more the one with the largest
    id is the response; equal ids with equal payloads are responses all, a null
    id counts as the smallest. The join has only digests; AQE splits a hot one.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digests = stored(pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size")), "warc-digests")
    groups = digests.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return digests.join(groups, "sha1", "left").select("page_id", "sha1", "size", F.when(revisit, F.col("newest")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, out_dir: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes all pages to archives in ``out_dir`` and returns the index, which is stored there too.

    A null payload or URL is taken as empty. Other columns are left out. An
    empty table gives an empty index.
    """
    spark = pages.sparkSession
    small_batches(spark)
    plan = plan_records(pages, page_id, html, min_bytes).dropDuplicates(["page_id", "sha1"])
    full = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    full = full.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    joined = full.alias("p").join(plan.alias("q"), F.col("p.page_id").eqNullSafe(F.col("q.page_id")) & (F.col("p.sha1") == F.col("q.sha1")))
    rows = joined.select("p.page_id", "p.url", F.when(~F.col("q.revisit"), F.col("p.html")).alias("html"), "p.sha1", "q.size", "q.refers_to", "q.revisit").sortWithinPartitions("page_id", "sha1", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        # a task that runs again writes another file, and the index names the one whose rows were kept
        task = TaskContext.get()
        path, offset = f"{out_dir}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0

        with new_file(path) as out:
            for batch in chain([first], batches):
                index = []
                for page, address, page_html, sha1, size, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    data = make_record(page, address, b"" if revisit else page_html.encode(), size, digest, refers, revisit, date)
                    out.write(data)
                    index.append((path, offset, len(data), page, address, digest, "revisit" if revisit else "response"))
                    offset += len(data)
                if index:
                    yield batch_of(INDEX, list(zip(*index, strict=True)))

    return stored(rows.mapInArrow(write, INDEX), "warc-index", f"{out_dir}/index")


def coalesced(ranges: Iterable[tuple[int, int]], gap: int = GAP, most: int = CHUNK) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges in runs that lie close; a run spans at most ``most`` bytes or is one range."""
    run: list[tuple[int, int]] = []
    for offset, length in ranges:
        if run and (offset - sum(run[-1]) > gap or offset + length - run[0][0] > most):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def read_warc(index: DataFrame, payloads: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The records of the given rows of an index: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked, payload.

    Chunks of the archives are dealt to as many tasks as their bytes ask for. A
    task reads a run of close records at a time, opens one record after the
    other, and holds no more payloads than a run's.
    """
    kept = f"{RECORD}, payload binary" if payloads else RECORD

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, o, n) for batch in batches for p, o, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
        for path, own in groupby(rows, key=itemgetter(0)):
            for run in coalesced(((o, n) for _, o, n in own), most=chunk):
                start = run[0][0]
                data, found, size = read_range(path, start, sum(run[-1]) - start), [], 0
                for at, n in run:
                    record = parse_record(data[at - start : at - start + n])
                    found.append(tuple(record[c.split()[0]] for c in kept.split(", ")))
                    size += len(record["payload"] or b"") if payloads else 0
                    if size >= chunk:
                        yield batch_of(kept, list(zip(*found, strict=True)))
                        found, size = [], 0
                if found:
                    yield batch_of(kept, list(zip(*found, strict=True)))

    held = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    near = F.floor(F.col("offset") / chunk)
    dealt = index.select("path", "offset", "length").repartition(max(1, math.ceil(held / chunk)), "path", near)
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(read, kept)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_warc(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(string_split(h, ''), lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111',
    '1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x)]), '') AS bits,
    max(page_id) OVER (PARTITION BY h) AS newest
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * CAST(substring(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substring(bits, 5 * i + 2, 1) AS INTEGER)
         + 4 * CAST(substring(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substring(bits, 5 * i + 4, 1) AS INTEGER)
         + CAST(substring(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM b
"""

"""WARC archives: a writer with revisit records and a splittable reader.

Writer: one gzip member per record, archives rolled at a size limit, written by
the tasks to uniquely named files. Only files named in the manifest (which Spark
commits) count, so a retried or lost task leaves at most an unread orphan. Equal
payloads are found by a partial aggregate on their digest; pages are then joined
with the digests that occur twice, by broadcast or shuffle as their measured size asks.

Reader: tasks get byte ranges. A task looks for gzip magic in its range, takes a
place for a member only if what it decodes there starts a WARC header, and owns the
records that start inside, reading past its end to finish the last. Magic inside
compressed data fails that test, in the writer's own archives as in others.

Edge cases: null html is an empty payload; a null url has no target header; rows
with a null page_id are archived without a page id and with a record id of their own (responses, or revisits of the
group's response); rows that repeat a page_id share its record id, and with the smallest page_id are all responses; an
empty table gives no archives and no rows; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm.common import saved, scratch, table

ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
TASK_BYTES = 64 << 20  #: of ranges that one task reads, where there are more than a few for every core
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  #: the public name space for URLs
RECORDS = "path string, at long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP header, which states the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, bytes, records) of the pages (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    large = rows.where(F.octet_length("html") >= min_bytes)
    firsts = saved(large.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "firsts")
    rows = rows.join(firsts, "sha", "left")  # a page whose payload is alone has no row there; broadcast or a join by digest that splits skewed ones
    rows = rows.withColumn("refers_to", F.when(F.octet_length("html") >= min_bytes, F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")))).drop("first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        out, size, n, name, done = None, 0, 0, "", []
        for pdf in batches:
            for page_id, url, text, sha, refers_to in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], pdf["sha"], pdf["refers_to"].astype("Int64"), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = member(record(None if page_id is pd.NA else int(page_id), url, text.encode(), digest, None if refers_to is pd.NA else int(refers_to)))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    return saved(rows.select("page_id", "url", "html", "sha", "refers_to").mapInPandas(run, "path string, bytes long, records long"), "archives")


def parse(data: bytes) -> dict:
    """The columns of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    number = lambda k: int(fields[k]) if k in fields else None
    if kind == "response":
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest.removeprefix("sha1:") != found:
            raise ValueError(f"payload digest of {fields.get('warc-record-id')} is {found}, not {digest}")
    else:
        size, found = next((int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), 0), digest.removeprefix("sha1:")
    return {"page_id": number("page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("refers-to-page-id"), "payload_bytes": size, "payload_digest": found, "payload": payload if kind == "response" else None}


def members(read_at, start: int, end: int, size: int, more: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, decoded record) of the WARC members that start in ``start .. end - 1``.

    read_at(n, place) gives bytes of a file of ``size`` bytes.
    """
    data, at = read_at(min(size, end + 2) - start, start), 0  # magic that straddles the end is seen from its start
    while True:
        at = data.find(MAGIC, at)
        if at < 0 or start + at >= end:
            return
        z, fed, out, bad, step = zlib.decompressobj(31), at, [], False, 4096  # small steps: what lies beyond a member is copied
        while not z.eof:
            if fed >= len(data):
                if start + len(data) >= size:
                    bad = True
                    break
                data += read_at(min(more, size - start - len(data)), start + len(data))
            piece = data[fed : fed + step]
            fed, step = fed + len(piece), min(2 * step, more)
            try:
                out.append(z.decompress(piece))
            except zlib.error:
                bad = True
                break
            head = b"".join(out)[:5] if len(out) < 3 else b"WARC/"
            if not b"WARC/".startswith(head[:5]):
                bad = True
                break
        if bad or not b"".join(out).startswith(b"WARC/"):
            at += 1
            continue
        yield start + at, b"".join(out)
        at = fed - len(z.unused_data)


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of archives (path, bytes), read by byte ranges in parallel.

    payloads: whether the column ``payload`` is filled; sizes and digests always come from the decoded payload.
    """
    splits = archives.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
    size = archives.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).collect()[0]
    spread = archives.sparkSession.sparkContext.defaultParallelism * 8
    n = max(1, min(size.n + size.bytes // split_bytes, max(spread, size.bytes // TASK_BYTES)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["bytes"], pdf["start"], strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    rows, held = [], 0
                    for at, data in members(lambda k, place: f.read_at(k, place), start, min(start + split_bytes, size), size):  # noqa: B023
                        row = parse(data) | {"path": path, "at": at}
                        held += len(data) if payloads else 1000
                        rows.append(row if payloads else row | {"payload": None})
                        if held > 4 << 20:
                            yield frame(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows, names)

    def frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return splits.repartition(n).mapInPandas(run, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"), min_bytes=0)
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first, count(*) AS c FROM s GROUP BY h),
r AS (SELECT s.*, CASE WHEN c > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM s JOIN f USING (h))
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""

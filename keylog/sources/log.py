"""The binary op-log file: a writer, and a distributed reader that stops at the first damage.

A record is ``crc u32, key length u32, value length u32, key, value``, little-endian; the
checksum is the CRC-32C of all that follows it; a value length of 0xFFFFFFFF marks
a delete, which has no value bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.functions.crc import crc32c_many
from keylog.workspace import saved

DELETE = 0xFFFFFFFF
ENTRIES = "path string, ordinal long, key binary, value binary, is_delete boolean"


def encode(entries: Iterable[tuple[bytes, bytes | None]]) -> bytes:
    """Records of (key, value) pairs; a value of None is a delete."""
    bodies = [struct.pack("<II", len(k), DELETE if v is None else len(v)) + k + (v or b"") for k, v in entries]
    return b"".join(struct.pack("<I", int(c)) + b for c, b in zip(crc32c_many(bodies), bodies, strict=True)) if bodies else b""


def decode(data: bytes, check: bool = True) -> list[tuple[bytes, bytes | None]]:
    """The records up to the first short or damaged one.

    check: also end at the first wrong checksum (off for a dump of what is there).
    """
    at, spans = 0, []
    while at + 12 <= len(data):
        crc, klen, vlen = struct.unpack_from("<III", data, at)
        end = at + 12 + klen + (0 if vlen == DELETE else vlen)
        if end > len(data):
            break
        spans.append((at, klen, vlen, end, crc))
        at = end
    good = len(spans)
    if check and spans:
        found = crc32c_many([data[a + 4 : end] for a, _, _, end, _ in spans])
        good = next((i for i, s in enumerate(spans) if int(found[i]) != s[4]), good)
    return [(data[a + 12 : a + 12 + k], None if v == DELETE else data[a + 12 + k : end]) for a, k, v, end, _ in spans[:good]]


def read_log(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(path, ordinal, key, value, is_delete) of all log files under ``path``; each file ends at its first damage.

    A file is the unit of parallelism, since a record can only be found from the one before it.
    """

    return decode_frame(spark.read.format("binaryFile").load(path).select("path", "content"), check)


def decode_frame(files: DataFrame, check: bool = True) -> DataFrame:
    """The same for a frame (path, content) of whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = decode(bytes(data), check)
                for i in range(0, max(len(rows), 1), 10_000):
                    some = rows[i : i + 10_000]
                    yield pd.DataFrame({"path": name, "ordinal": range(i, i + len(some)), "key": [k for k, _ in some], "value": [v for _, v in some], "is_delete": [v is None for _, v in some]})

    return files.select("path", "content").mapInPandas(run, ENTRIES)


def encode_frame(df: DataFrame, order: str = "seq") -> DataFrame:
    """An op-log as files (path, content) of the binary format, whose names are in the order of their records.

    Dealt out by range of ``order``; a file holds the records of one Arrow batch, so no task and not the driver holds a whole log.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, pdf in enumerate(batches):
            if len(pdf):
                entries = [(bytes(key), None if gone else bytes(value)) for key, value, gone in zip(pdf["key"], pdf["value"], pdf["is_delete"], strict=True)]
                yield pd.DataFrame({"path": [f"{pdf['part'].iloc[0]:08d}-{k:08d}.log"], "content": [encode(entries)]})

    rows = df.repartitionByRange(order).sortWithinPartitions(order).select("key", "value", "is_delete", F.spark_partition_id().alias("part"))
    return saved(rows.mapInPandas(run, "path string, content binary"), "log")


def torn(files: DataFrame, lost: int = 1) -> DataFrame:
    """The files without the last bytes of the last one, as a crash leaves a log."""
    last = files.agg(F.max("path")).collect()[0][0]
    cut = F.expr(f"substring(content, 1, length(content) - {lost})")
    return files.withColumn("content", F.when(F.col("path") == last, cut).otherwise(F.col("content")))


def replay(log: DataFrame) -> DataFrame:
    """The op-log of a recovered log: ``seq`` is the order of the records, files by name."""
    first = log.groupBy("path").agg((F.max("ordinal") + 1).alias("n"))
    from pyspark.sql import Window

    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = first.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return log.join(base, "path").select("key", "value", "is_delete", (F.col("base") + F.col("ordinal")).alias("seq"))


def dump(log: DataFrame, width: int = 20) -> DataFrame:
    """(idx, op, key, value) of a replayed log for people: values cut to ``width`` characters."""
    value = F.col("value").cast("string")
    return log.select(
        F.col("seq").alias("idx"), F.when(F.col("is_delete"), "DELETE").otherwise("PUT").alias("op"), F.col("key").cast("string").alias("key"),
        F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("..."))).otherwise(value).alias("value"),
    )


class LogFile:
    """A log on the local disk of the driver, for interchange with other programs."""

    def __init__(self, path: str, sync_writes: bool = False) -> None:
        self.path, self.sync_writes = path, sync_writes
        self._file = open(path, "ab")  # noqa: SIM115

    def append(self, key: bytes, value: bytes) -> None:
        self._write([(key, value)])

    def remove(self, key: bytes) -> None:
        self._write([(key, None)])

    def extend(self, entries: Iterable[tuple[bytes, bytes | None]]) -> None:
        self._write(entries)

    def _write(self, entries: Iterable[tuple[bytes, bytes | None]]) -> None:
        self._file.write(encode(entries))
        self._file.flush()
        if self.sync_writes:
            os.fsync(self._file.fileno())

    def recover(self) -> list[tuple[bytes, bytes | None]]:
        with open(self.path, "rb") as f:
            return decode(f.read())

    def truncate(self) -> None:
        self._file.truncate(0)

    def sync(self) -> None:
        self._file.flush()
        os.fsync(self._file.fileno())

    def close(self) -> None:
        if not self._file.closed:
            self.sync()
            self._file.close()

    def __enter__(self) -> LogFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def write_log(df: DataFrame, path: str, order: str = "seq") -> int:
    """Export an op-log in order to one local file, streamed through the driver; returns the records written."""
    n, held = 0, []
    with LogFile(path) as log:
        for r in df.orderBy(order).select("key", "value", "is_delete").toLocalIterator():
            held.append((bytes(r.key), None if r.is_delete else bytes(r.value)))
            n += 1
            if len(held) >= 10_000:
                log.extend(held)
                held = []
        log.extend(held)
    return n

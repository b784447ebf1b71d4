"""Reads over an op-log: point, multi-point, range, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylog.operators.layout import measured, shuffle_limits, tasks
from keylog.operators.resolve import latest, live
from keylog.schema import key_literal


def get(ops: DataFrame, key: str | bytes) -> DataFrame:
    """One row (key, found, value); a deleted key is not found. The equality reaches the scan."""
    hit = latest(ops.where(F.col("key") == key_literal(key))).where(~F.col("is_delete"))
    return hit.agg((F.count("*") > 0).alias("found"), F.first("value").alias("value")).select(key_literal(key).alias("key"), "found", "value")


def multi_get(ops: DataFrame, keys: DataFrame, held: tuple[int, int] | None = None) -> DataFrame:
    """(key, found, value) for each row of ``keys``; repeated keys are answered each.

    Few keys reduce the op-log before versions are resolved. Keys too many to broadcast would have to be shuffled and sorted
    for that, once for every run, as Spark moves the reduction into a union; instead they and the op-log are dealt out by key, each
    once, to the session's number of shuffle partitions or as many more as it takes for a task to sort ``TASK_BYTES``.
    held: bytes of (op-log, keys) in memory; measured if unknown, the op-log only for many keys.
    """
    asked = keys.select(F.col("key").cast("binary").alias("key"))
    usual, small = shuffle_limits(ops.sparkSession)
    size = held[1] if held else measured(asked)
    if size <= small:
        hits = live(ops.join(asked.distinct(), "key", "left_semi"))
    else:
        n = tasks(size + (held[0] if held else measured(ops)))
        dealt = (n, "key") if n > usual else ("key",)
        asked, hits = asked.repartition(*dealt), live(ops.repartition(*dealt))
    return asked.join(hits.withColumn("found", F.lit(True)), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")


def contains(ops: DataFrame, keys: DataFrame, held: tuple[int, int] | None = None) -> DataFrame:
    """(key, found) for each row of ``keys``."""
    return multi_get(ops, keys, held).select("key", "found")


def between(start: str | bytes | None, end: str | bytes | None):
    """key in [start, end], both included; None leaves a side open."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("key") >= key_literal(start))
    if end is not None:
        out = out & (F.col("key") <= key_literal(end))
    return out


def scan(ops: DataFrame, start: str | bytes | None = None, end: str | bytes | None = None) -> DataFrame:
    """(key, value) of the live keys in [start, end] in byte order; start > end gives none."""
    return live(ops.where(between(start, end))).orderBy("key")


def lower_bound(ops: DataFrame, key: str | bytes) -> DataFrame:
    """The first key at or after ``key``, with its newest version, tombstone or not."""
    return latest(ops.where(F.col("key") >= key_literal(key))).orderBy("key").limit(1)


def size(ops: DataFrame) -> DataFrame:
    """Number of distinct keys, deleted ones included."""
    return ops.agg(F.count_distinct("key").alias("keys"))

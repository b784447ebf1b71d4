"""Which version of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylog.operators.order import running_total


def latest(ops: DataFrame) -> DataFrame:
    """The newest row of each key, tombstones included.

    One sort-based aggregate on either side of the shuffle (binary values cannot be hash-aggregated), so a key
    with many versions shrinks before it. A predicate on ``key`` is pushed through it into the scans; one on
    ``value`` or ``is_delete`` must stay above, or old versions would reappear.
    """
    top = F.max_by(F.struct("value", "is_delete"), "seq").alias("_top")
    return ops.groupBy("key").agg(top, F.max("seq").alias("seq")).select("key", "_top.value", "_top.is_delete", "seq")


def live(ops: DataFrame) -> DataFrame:
    """(key, value) of every key whose newest version is no delete."""
    return latest(ops).where(~F.col("is_delete")).select("key", "value")


def history(ops: DataFrame) -> DataFrame:
    """Every version with its place (1 is the newest) and the value it replaced.

    The replaced value is null for a first version and after a delete.
    """
    by_key = Window.partitionBy("key")
    return ops.select(
        "key", "value", "is_delete", "seq",
        F.row_number().over(by_key.orderBy(F.col("seq").desc())).alias("version"),
        F.lag("value").over(by_key.orderBy("seq")).alias("previous"),
    )


def merge_all(*runs: DataFrame) -> DataFrame:
    """All rows of all runs in key order, duplicates kept, older versions of a key first."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy("key", "seq")


def live_bytes(ops: DataFrame) -> DataFrame:
    """The buffer's size: bytes of key and value over the newest version of each key."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return latest(ops).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("entries"))


def running_bytes(ops: DataFrame) -> DataFrame:
    """The buffer's size after each mutation: a new key adds key and value, an overwrite the difference."""
    size = F.coalesce(F.octet_length("value"), F.lit(0))
    before = F.lag(size).over(Window.partitionBy("key").orderBy("seq"))
    step = ops.select("key", "seq", (size - F.coalesce(before, -F.octet_length("key"))).cast("long").alias("delta"))
    return running_total(step, [], ["seq"], F.col("delta"), "bytes")

"""Analytic views of sorted runs: blocks, statistics, lists of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylog.operators.order import running_total


def block_index(run: DataFrame, per_block: int) -> DataFrame:
    """(block, first_key, last_key, entries, bytes) for blocks of ``per_block`` entries in key order.

    Entries of one size only: there every block but the last holds the same number. The order number is a running total
    over one written copy of the sorted run, so it does not depend on how a plan deals the rows out twice.
    """
    size = 8 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = run.select("key", size.cast("long").alias("size"))
    numbered = running_total(rows, [], ["key"], F.lit(1).cast("long"), "n").withColumn("block", F.expr(f"(n - 1) div {per_block}"))
    return numbered.groupBy("block").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def run_stats(ops: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: smallest and largest key, rows, tombstones, bytes, range of seq."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return ops.groupBy(run).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("rows"), F.count_if("is_delete").alias("tombstones"),
        F.sum(size).alias("bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )

"""Running totals in a global order, without a window over everything."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylog.workspace import saved


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the same ``by`` up to and with each row, in ``order``.

    The rows are dealt out by range of (by, order), sorted, numbered and written once; all else reads that copy, so a
    row's partition means the same everywhere. Totals of partitions shift the totals inside them. A group with a third
    of all rows is spread over many ranges; only rows that agree in all of ``by`` and ``order`` share one. Null groups are groups.
    """
    rows = df.withColumn("_amount", amount).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = saved(rows.withColumn("_id", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_id", 33))
    sums = rows.groupBy(*by, "_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per group and partition
    base = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = rows.withColumn("_own", F.sum("_amount").over(Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.col("_part") == F.col("_p"))
    return own.join(base, same).withColumn(name, F.col("_base") + F.col("_own")).select(*df.columns, name)

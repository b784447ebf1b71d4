"""Sorted runs as Parquet: range-partitioned, sorted by key, with key statistics and Bloom filters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keylog.operators.layout import held, sizes, tasks
from keylog.plans.manifest import Run
from keylog.schema import OP_SCHEMA
from keylog.workspace import Files


def write_run(df: DataFrame, path: str, level: int, *, seq: int | None = None, unique: bool = True, partitions: int | None = None, bloom_fpp: float = 0.01, row_group_bytes: int = 128 << 20, size: int | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None) -> Run | None:
    """Write op-log rows as one run and describe it; None if there are no rows.

    Files do not overlap in key and are sorted, so a range meets few files and row
    groups. The Bloom filter grows with the distinct keys that a row group really has. All statistics are
    observed while writing. partitions: the least number of files; there are more where
    a task would have too much to sort. size: bytes that the rows take in memory. Where it is unknown they are written
    as they come and measured first, so that the sampling for the ranges does not compute them again.
    resolve: what becomes of the rows of a range, which has all rows of its keys; an aggregate by key needs no other shuffle there.
    """
    rows = df.select(*OP_SCHEMA.names)
    if size is not None:
        return _write_sorted(rows, path, level, seq, unique, max(partitions or 1, tasks(size)), bloom_fpp, row_group_bytes, resolve)
    unsorted = Files(df.sparkSession, f"{path}-unsorted")
    try:
        seen = Observation()
        rows.observe(seen, *sizes(rows)).write.option("compression", "zstd").parquet(f"{path}-unsorted")
        n = max(partitions or 1, tasks(held(seen.get["rows"], seen.get["bytes"])))
        return _write_sorted(df.sparkSession.read.schema(OP_SCHEMA).parquet(f"{path}-unsorted"), path, level, seq, unique, n, bloom_fpp, row_group_bytes, resolve)
    finally:
        unsorted.remove(unsorted.root)


def _write_sorted(rows: DataFrame, path: str, level: int, seq: int | None, unique: bool, n: int, bloom_fpp: float, row_group_bytes: int, resolve: Callable[[DataFrame], DataFrame] | None) -> Run | None:
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    seen = Observation()
    rows = rows.repartitionByRange(n, "key")
    rows = resolve(rows) if resolve else rows
    rows = rows.sortWithinPartitions("key").observe(
        seen, F.count("*").alias("rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(size).alias("bytes"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count_if("is_delete").alias("tombstones"), F.count_if(F.col("key").isNull()).alias("null_keys"),
    )
    writer = rows.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.fpp#key", str(bloom_fpp))
    writer.parquet(path)
    s = seen.get
    if s["null_keys"]:
        raise ValueError(f"{s['null_keys']} rows have no key")
    if not s["rows"]:
        return None
    low, high = (seq, seq) if seq is not None else (s["min_seq"], s["max_seq"])
    return Run(uuid.uuid4().hex, path, level, bytes(s["min_key"]), bytes(s["max_key"]), s["rows"], s["bytes"], low or 0, high or 0, s["tombstones"], seq, unique)


def read_runs(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    """The rows of all runs. Runs whose rows carry their own seq are read in one scan."""
    own = [r.path for r in runs if r.seq is None]
    frames = [spark.read.schema(OP_SCHEMA).parquet(*own)] if own else []
    for r in runs:
        if r.seq is not None:
            frames.append(spark.read.schema(OP_SCHEMA).parquet(r.path).withColumn("seq", F.lit(r.seq).cast("long")))
    if not frames:
        return spark.createDataFrame([], OP_SCHEMA)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

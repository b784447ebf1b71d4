"""Helpers shared by the corpus operators: tables, the shared folder, slots."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.workspace import scratch, shared_dir

__all__ = ["drop_saved", "global_slots", "release", "saved", "scratch", "shared_dir", "slots", "table", "whole_text"]

#: Bytes that separate words: the space and \t..\r, as the inside of a regex class.
SPACES = r"\x20\x09-\x0D"


BATCH_ROWS = 1000  #: rows that a Python worker holds at once; texts can be long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark's reader touches the path."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows, so that a worker's memory is bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def saved(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at files that outlive any executor, so nothing above is
    computed twice and a lost executor costs only its own running tasks. free: a
    step with a large shuffle, whose files are to go at once.
    """
    bounded_batches(df.sparkSession)
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    if free:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done.

    It does so once the JVM's collector has seen that nothing refers to them, which a
    quiet driver can put off for the whole of a job with many steps.
    """
    gc.collect()
    spark._jvm.System.gc()


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a ``saved`` frame that is needed no more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slots(df: DataFrame, key: str, part: str = "_part", rank: str = "_rank") -> DataFrame:
    """Number the rows of each ``key`` inside each partition, then save the result.

    Adds ``part`` (a partition's number) and ``rank`` (0.. within part and key).
    No shuffle and no window, so a key with a third of all rows costs nothing
    extra; ``global_slots`` turns the pair into one gapless number per key.
    """
    schema = df.select("*", F.lit(0).alias(part), F.lit(0).cast("long").alias(rank)).schema

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            at = pdf.groupby(key, sort=False).cumcount() + pdf[key].map(lambda k: seen.get(k, 0))
            for k, n in pdf[key].value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)
            yield pdf.assign(**{rank: at.astype("int64")})

    numbered = df.withColumn(part, F.spark_partition_id()).mapInPandas(number, schema)
    return saved(numbered, "slots")


def global_slots(numbered: DataFrame, key: str, slot: str, part: str = "_part", rank: str = "_rank") -> DataFrame:
    """``slot``: gapless from 0 within each key, over the output of ``slots``.

    The offsets come from one row per (key, partition); Spark decides by their
    measured size whether the join is broadcast or shuffled.
    """
    from pyspark.sql import Window

    counts = numbered.groupBy(key, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(offsets, [key, part]).withColumn(slot, (F.col("_base") + F.col(rank)).cast("long")).drop("_base", part, rank)


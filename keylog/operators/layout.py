"""How many tasks rows are dealt to, by what they take in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_BYTES = 64  #: of a row that is sorted, beside its keys and values
TASK_BYTES = 64 << 20  #: of rows that one task sorts


def sizes(df: DataFrame) -> list:
    """Aggregates ``rows`` and ``bytes``: all rows, and the bytes of the binary columns."""
    parts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    return [F.count("*").alias("rows"), F.coalesce(F.sum(sum(parts, F.lit(0).cast("long"))), F.lit(0)).alias("bytes")]


def held(rows: int, size: int) -> int:
    """Bytes that rows with ``size`` bytes of keys and values take while they are sorted."""
    return size + ROW_BYTES * rows


def measured(df: DataFrame) -> int:
    """``held`` by one pass over the rows."""
    r = df.agg(*sizes(df)).collect()[0]
    return held(r.rows, r.bytes)


def tasks(size: int) -> int:
    """Tasks among which that many held bytes are dealt out; at least one."""
    return max(1, -(-size // TASK_BYTES))


def shuffle_limits(spark: SparkSession) -> tuple[int, int]:
    """(partitions of a shuffle for which no number is given, bytes up to which a side of a join is broadcast) of the session."""
    conf = spark._jsparkSession.sessionState().conf()
    return conf.numShufflePartitions(), conf.autoBroadcastJoinThreshold()

"""The op-log: one row per mutation, ``seq`` orders the versions of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OP_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("is_delete", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), True),
])


def ops(df: DataFrame, key: Column | str = "key", value: Column | str = "value", is_delete: Column | str | bool = False, seq: Column | str | int | None = None) -> DataFrame:
    """Normalise any frame to the op-log columns: deletes carry a null value, puts a null-free one.

    Keys and values are bytes; strings are taken as UTF-8. Empty keys and values are
    ordinary; a null key is no key and is refused at write time.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    gone = F.coalesce(col(is_delete).cast("boolean"), F.lit(False))
    return df.select(
        col(key).cast("binary").alias("key"),
        F.when(~gone, F.coalesce(col(value).cast("binary"), F.lit(bytearray(b"")))).alias("value"),
        gone.alias("is_delete"),
        col(seq).cast("long").alias("seq"),
    )


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Binary columns as strings, for display and comparison."""
    named = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    return df.withColumns({c: F.col(c).cast("string") for c in named})


def as_key(key: str | bytes) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


def key_literal(key: str | bytes) -> Column:
    return F.lit(bytearray(as_key(key)))

"""CRC-32C (Castagnoli), vectorised over many byte strings; Spark's own crc32 is the IEEE one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78  #: reflected


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def crc32c_many(items: Sequence[bytes], state: np.ndarray | None = None) -> np.ndarray:
    """The checksum of every item; ``state``: checksums to continue from."""
    n = len(items)
    lengths = np.fromiter(map(len, items), dtype=np.int64, count=n)
    data = np.frombuffer(b"".join(items), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    crc = ~(np.zeros(n, dtype=np.uint32) if state is None else state.astype(np.uint32))
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    for j, k in enumerate(active):
        i = order[:k]
        crc[i] = _TABLE[(crc[i] ^ data[starts[i] + j]) & 255] ^ (crc[i] >> np.uint32(8))
    return ~crc


def crc32c(data: bytes, state: int = 0) -> int:
    return int(crc32c_many([data], np.array([state], dtype=np.uint32))[0])


def crc32c_column(column: Column | str) -> Column:
    """CRC-32C of a binary column; null for null."""

    @F.pandas_udf("long")
    def run(items: pd.Series) -> pd.Series:
        some = items.notna()
        out = pd.Series([None] * len(items), dtype="Int64")
        out[some.to_numpy()] = crc32c_many([bytes(x) for x in items[some]]).astype("int64")
        return out

    return run(column)

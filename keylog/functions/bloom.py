"""A stand-alone Bloom filter over a column: built by a distributed aggregate, tested in bulk."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SEGMENT = 1 << 23  #: bits that one task sets


def geometry(n: int, fpp: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at a false-positive rate."""
    bits = max(8, int(-n * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, int(bits / max(n, 1) * math.log(2)))


class BloomFilter:
    """Bits set by double hashing of two 64-bit hashes, which Spark computes (xxhash64 with two seeds)."""

    def __init__(self, bits: int, hashes: int, data: np.ndarray | None = None) -> None:
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros((bits + 7) // 8, dtype=np.uint8) if data is None else data

    @staticmethod
    def hashed(column: str) -> list[Column]:
        return [F.xxhash64(column).alias("h1"), F.xxhash64(column, F.lit(7)).alias("h2")]

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        i = np.arange(self.hashes, dtype=np.uint64)
        return (h1.astype(np.uint64)[:, None] + i * (h2.astype(np.uint64) | np.uint64(1))[:, None]) % np.uint64(self.bits)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = self.places(h1, h2).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def test(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)

    @classmethod
    def of(cls, df: DataFrame, column: str, fpp: float = 0.01, n: int | None = None) -> BloomFilter:
        """Built from the number of distinct keys. Places of bits are dealt out by range, and each range is set by one task,

        which never holds more than its range; the driver gathers the ranges into the one filter that it returns.
        """
        n = df.agg(F.approx_count_distinct(column)).collect()[0][0] if n is None else n
        out = cls(*geometry(max(int(n * 1.1), 1), fpp))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = np.unique(out.places(pdf["h1"].to_numpy(), pdf["h2"].to_numpy()))
                part = at // np.uint64(SEGMENT)
                cuts = np.flatnonzero(np.diff(part)) + 1
                runs = np.split((at % np.uint64(SEGMENT)).astype("<u4"), cuts)
                yield pd.DataFrame({"part": part[np.concatenate([[0], cuts])].astype(np.int64) if len(at) else [], "places": [r.tobytes() for r in runs] if len(at) else []})

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            own = np.zeros(SEGMENT // 8, dtype=np.uint8)
            for p in pdf["places"]:
                at = np.frombuffer(p, dtype="<u4")
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [own.tobytes()]})

        hashes = df.where(F.col(column).isNotNull()).select(*cls.hashed(column))
        for r in hashes.mapInPandas(deal, "part long, places binary").groupBy("part").applyInPandas(join, "part long, data binary").toLocalIterator():
            a = r.part * (SEGMENT // 8)
            b = min(a + SEGMENT // 8, len(out.data))
            out.data[a:b] |= np.frombuffer(bytes(r.data), dtype=np.uint8)[: b - a]
        return out

    def may_contain(self, df: DataFrame, column: str, name: str = "may_contain") -> DataFrame:
        """Adds whether each row's key may be in the filter; never false for one that is."""

        @F.pandas_udf("boolean")
        def check(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(self.test(h1.to_numpy(), h2.to_numpy()))

        return df.withColumn(name, check(*self.hashed(column)))

    def to_bytes(self) -> bytes:
        return struct.pack("<qq", self.bits, self.hashes) + self.data.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BloomFilter:
        bits, hashes = struct.unpack_from("<qq", raw)
        return cls(bits, hashes, np.frombuffer(raw, dtype=np.uint8, offset=16).copy())

"""Best-fit packing of documents into fixed-length token sequences.

Documents are tokenised, closed by an end id, and cut only if longer than a
sequence; the remainder is then the first piece. What is packed are the *counts*
of piece lengths (at most ``capacity`` numbers), so the plan is made on the driver in
bounded memory whatever the corpus size, and is the same as packing one by one:

* pieces above one third of the capacity: at most two a sequence, by greedy
  matching (the longest left takes the longest that still fits beside it);
* shorter ones, longest first, best-fit the remaining gaps (the smallest gap that
  holds them), opening sequences only when no gap does.

A plan row maps a run of ranks of one length to a run of sequences, so the only
distributed state is each piece's rank among pieces of its length: counted per
partition while tokenising and shifted by per-partition offsets. Token ids are
written once and never shuffled.

Edge cases: a null or empty text is its end id alone; an empty table gives no
rows; repeated rows are packed separately; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keylog.llm.common import saved, table, whole_text

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length int, ids binary, _part int, _rank long"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level BPE file.

    The same vocabulary and split pattern are also run through tiktoken, about four
    times as fast; texts with characters beyond the Latin blocks and general
    punctuation, where the two libraries' Unicode tables may differ, and texts that hold
    an added token of the file (the library gives its id), take the
    tokenizers library itself. Tests hold the two against each other.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        symbols = byte_symbols()
        vocab = self.full.get_vocab(with_added_tokens=False)
        ranks = {bytes(symbols[c] for c in word): i for word, i in vocab.items() if all(c in symbols for c in word)}
        added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        for t in added:
            ranks.pop(t.encode(), None)
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join(["[^\x00-ɏ‐-‧‰-⁞]", *map(re.escape, added)])).search

    def __call__(self, text: str) -> list[int]:
        if self.odd(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) in the shared folder; ids: little-endian uint32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen = Encoder(tokenizer_path), np.zeros(capacity + 1, dtype=np.int64)
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, text, part in zip(pdf["doc_id"].array, pdf["text"], pdf["_part"], strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                cut = len(ids) % capacity or capacity
                edges = [0, *range(cut, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k in range(len(edges) - 1):
                    a, b = edges[k], edges[k + 1]
                    out.append((doc_id, k, a, b - a, ids[a:b].tobytes(), part, seen[b - a]))
                    seen[b - a] += 1
                if len(out) >= 4000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids", "_part", "_rank"])
        return pdf.assign(doc_id=pdf["doc_id"].astype("Int64"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.spark_partition_id().alias("_part"))
    return saved(rows.mapInPandas(run, PIECES), "pieces")


@dataclass
class Placement:
    """Ranks ``rank .. rank + per * bins - 1`` of ``length`` go to sequences ``first ..``, ``per`` in each from ``offset``."""

    length: int
    rank: int
    per: int
    bins: int
    first: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Placements of all pieces, and the number of sequences."""
    left = {s: n for s, n in counts.items() if n > 0}
    rank: dict[int, int] = dict.fromkeys(left, 0)
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, how many), sorted
    out: list[Placement] = []
    opened = 0

    def place(s: int, per: int, bins: int, first: int, offset: int) -> None:
        out.append(Placement(s, rank[s], per, bins, first, offset))
        rank[s] += per * bins
        left[s] -= per * bins

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            t = next((t for t in large if t <= capacity - s and left[t] >= 1 + (t == s)), None)
            bins = left[s] if t is None else left[s] // 2 if t == s else min(left[s], left[t])
            place(s, 1, bins, opened, 0)
            if t is not None:
                place(t, 1, bins, opened, s)
            if gap := capacity - s - (t or 0):
                insort(gaps, (gap, opened, bins))
            opened += bins
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(gaps, (s, -1, -1))
            if i < len(gaps):
                gap, first, n = gaps.pop(i)
            else:
                gap, first, n = capacity, opened, -(-left[s] // (capacity // s))
                opened += n
            per = gap // s
            full = min(n, left[s] // per)
            rest = left[s] - per * full
            if full:
                place(s, per, full, first, capacity - gap)
                if gap - per * s:
                    insort(gaps, (gap - per * s, first, full))
            used = full
            if rest and full < n:
                place(s, rest, 1, first + full, capacity - gap)
                insort(gaps, (gap - rest * s, first + full, 1))
                used += 1
            if used < n:
                insort(gaps, (gap, first + used, n - used))
    return out, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces of ``tokenised``, without their ids (ids_crc32 instead)."""
    spark = pieces.sparkSession
    rows = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "_part", "_rank")
    counts = saved(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed, _ = plan(total, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(offsets, ["length", "_part"]).withColumn("k", F.col("base") + F.col("_rank"))
    runs = [(p.length, p.rank, p.rank + p.per * p.bins, p.per, p.first, p.offset) for p in placed]
    # At most a few rows for each length up to the capacity: the size of this table is bounded by the capacity alone.
    table_ = F.broadcast(spark.createDataFrame(runs, "length int, lo long, hi long, per long, first long, at long"))
    return ranked.join(table_, (ranked["length"] == table_["length"]) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).select(
        "doc_id", "piece", "start", ranked["length"].cast("long").alias("length"), "ids_crc32",
        (F.col("first") + F.expr("(k - lo) div per")).alias("sequence_id"),
        (F.col("at") + (F.col("k") - F.col("lo")) % F.col("per") * ranked["length"]).alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenised(table(spark, sf_dir, "documents"), default_tokenizer()))

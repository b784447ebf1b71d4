"""Sharding: minimax contiguous partition of atomic groups.

Rows with equal texts form one atomic group. Groups are ordered by a 60-bit hash
of the text, and the smallest capacity is found for which a greedy left-to-right
walk needs at most ``n_shards`` shards; shards are cut where the walk cuts.

The walk needs prefix sums only, so it runs on the driver over a *summary*: group
sizes summed by hash prefix (a partial aggregate, one row per prefix). Cuts at
block borders bound the answer from above, cuts inside blocks from below; only
blocks in which some cut can still lie are split further, by 10 more hash bits a
round, until every such block is a single group. The capacity is then exact, and
the driver never holds more than the blocks plus those few refinements.

Assignment is a projection (hash against 15 cut points); slots are numbered per
partition and shifted by partition offsets, so neither a large shard nor a group
with a third of all rows meets in one task.

Edge cases: a null text has size 1 and crc 0 and shares the empty text's group;
fewer groups than shards leave the last shards empty; an empty table gives no
rows; repeated rows are one group; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm.common import global_slots, saved, slots, table, whole_text

BITS, STEP, FIRST = 60, 10, 12  #: hash bits; bits more per round; bits of the first round


class Blocks:
    """Disjoint hash intervals in order with their total sizes; ``single`` ones cannot be cut."""

    def __init__(self) -> None:
        self.rows: dict[tuple[int, int], tuple[int, bool]] = {}  # (first hash, bits left) -> (size, single)

    def ordered(self) -> list[tuple[int, int, int, bool]]:
        return [(start, left, size, single) for (start, left), (size, single) in sorted(self.rows.items())]


def greedy(ends: list[int], capacity: int, most: int, inside: list[bool] | None = None) -> list[int] | None:
    """Ends (as prefix sums) of the shards that a greedy walk fills, or None if ``most`` do not do.

    ends: prefix sums of the block sizes. inside: which blocks may be cut anywhere.
    """
    at, total, cuts = 0, ends[-1] if ends else 0, []
    while at < total:
        if len(cuts) == most:
            return None
        i = bisect_right(ends, at + capacity)
        reach = ends[i - 1] if i else 0
        if inside is not None and i < len(ends) and inside[i]:
            reach = at + capacity
        if reach <= at:
            return None
        at = min(reach, total)
        cuts.append(at)
    return cuts


def reaches(ends: list[int], capacity: int, steps: int, inside: list[bool] | None = None) -> list[int]:
    """Prefix sums that a greedy walk has reached after 1 .. ``steps`` shards."""
    at, out = 0, []
    for _ in range(steps):
        i = bisect_right(ends, at + capacity)
        at = max(at, ends[i - 1] if i else 0)
        if inside is not None and i < len(ends) and inside[i]:
            at = max(at, min((out[-1] if out else 0) + capacity, ends[-1]))
        out.append(at)
    return out


def smallest(ends: list[int], most: int, inside: list[bool] | None = None) -> tuple[int, list[int]]:
    """The least feasible capacity, by binary search, and its cuts."""
    total = ends[-1] if ends else 0
    low, high = max(0, -(-total // most) - 1), max(total, 1)  # low is infeasible or zero, high feasible
    while high - low > 1:
        mid = (low + high) // 2
        if greedy(ends, mid, most, inside) is None:
            low = mid
        else:
            high = mid
    return high, greedy(ends, high, most, inside) or []


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """(capacity, hashes) from a table (h, size) of the rows' group hashes and sizes.

    Shard k takes the groups with hash below ``hashes[k]`` that earlier shards lack.
    """

    def sums(df: DataFrame, left: int) -> list:
        p = F.shiftright("h", left)
        return df.groupBy(p.alias("p")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()

    blocks = Blocks()
    left = BITS - FIRST
    for r in sums(groups, left):
        blocks.rows[r.p << left, left] = (int(r["size"]), r.lo == r.hi)
    while True:
        rows = blocks.ordered()
        ends, at = [], 0
        for _, _, size, _ in rows:
            at += size
            ends.append(at)
        high, cuts = smallest(ends, n_shards)  # cuts at borders only
        free = [not single for *_, single in rows]
        low, _ = smallest(ends, n_shards, free)
        open_ = set()
        if low < high:
            # For any capacity in [low, high] the k-th cut lies between these two walks.
            for a, b in zip(reaches(ends, low, n_shards), reaches(ends, high, n_shards, free), strict=True):
                i = bisect_right(ends, a)
                while i < len(rows) and (ends[i - 1] if i else 0) < b:
                    if free[i]:
                        open_.add(i)
                    i += 1
        if not open_:
            hashes = []
            for c in cuts:
                i = bisect_right(ends, c)
                hashes.append(rows[i][0] if i < len(rows) else 1 << BITS)
            return high, hashes
        # Split the open blocks, all of one depth in a job.
        depths = {rows[i][1] for i in open_}
        for left in sorted(depths, reverse=True):
            starts = [rows[i][0] for i in open_ if rows[i][1] == left]
            less = max(0, left - STEP)
            inside: Column = F.shiftright("h", left).isin([s >> left for s in starts])
            found = sums(groups.where(inside), less)
            for s in starts:
                del blocks.rows[s, left]
            for r in found:
                blocks.rows[r.p << less, less] = (int(r["size"]), less == 0 or r.lo == r.hi)


def group_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts share a shard, the largest shard is as small as can be."""
    text = whole_text()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_hash(text).alias("h"))
    rows = saved(rows, "shard-rows")
    _, hashes = minimax_cuts(rows.select("h", "size"), n_shards)
    shard = F.lit(0)
    for h in hashes[:-1]:
        shard = shard + (F.col("h") >= h).cast("int")
    return global_slots(slots(rows.withColumn("shard", shard).drop("h"), "shard"), "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

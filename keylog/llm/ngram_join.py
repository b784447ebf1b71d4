"""N-gram Jaccard self-join by vertical partitioning.

Documents are sets of distinct word n-grams (here: 64-bit hashes). Two link when
their Jaccard similarity reaches the threshold. Steps, each a shuffle of packed or narrow rows:

1. Frequencies of all grams of all documents, counted in blocks and merged by hash range. Grams that occur often
   (a list of bounded length) go to the end of the *global order*: rare grams by
   hash first, frequent ones after them by frequency.
2. Each document's set is hashed to a class; documents with equal sets are one class
   and are joined once. Classes have 64-bit names; a second hash of every set tells whether two sets share a name, and
   such classes are renamed. Of each class the first n - ceil(t n) + 1 grams in the
   global order are indexed, and the first n - ceil(2 t / (1 + t) n) + 1 of them are marked:
   linked classes share one of those that is marked in the smaller set.
3. Candidates from the index. Small postings give all their pairs. Larger ones give, per
   band of set sizes, pairs with one leader only; each posting draws its own. A posting of a frequent gram is
   dealt out in chunks, each draws its leaders, and the leaders of the chunks do so again until they fit in one.
4. Overlaps, by *vertical partitioning*: the global order is cut into fragments of equal load (occurrences of grams).
   Every set is cut into its segments, and each (fragment, pair) is a row of its own that meets the two
   segments by (fragment, class) and counts their overlap; partial overlaps are then summed per pair. The
   fragments of rare grams are counted for all pairs, further ones only for pairs that can still reach the
   threshold if all their uncounted grams agree.
5. Links give components. Postings that still span several components draw leaders once
   more; in what then is open, the pairs of different components are made, but for those that the places of their common gram rule out (too
   few grams follow it), or the triangle inequality of the Jaccard distance by their
   distances to the leader. Open postings of more than ``HOT`` classes are cut into blocks, and each pair of blocks is a
   unit of work. All these pairs go through 4 as well.
   So no link between different components is lost, and the many links inside a large group
   of near copies are never made as rows.
6. All links are inside components, so those of each class are counted there, over pairs of blocks of bounded size;
   only one sum per class and unit is passed on.

Edge cases: null or empty texts have no grams, no links, and are their own component;
fewer words than n make one gram; every row is a document of its own, also if
its doc_id is repeated; a null doc_id takes part and does not count as the smallest
(a component of nulls only has a null id); other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm import bytewords as B
from keylog.llm.common import drop_saved, saved, table, whole_text
from keylog.llm.graph import components

N = 5
PERCENT = 75
OFTEN = 16  #: a gram in more documents than this may be called frequent
MOST_FREQUENT = 1_000_000  #: bound of the list of frequent grams (12 MB)
SMALL = 4  #: postings up to this length give all their pairs
FRAGMENTS = 6
STAGES = ((0, 1), (2, 3, 4, 5))  #: fragments counted before and after pairs are pruned
HOT = 1024  #: members of a posting that one group holds at once
FLUSH = 1_000_000  #: grams a task gathers before it passes them on
UNIT = 1024  #: classes of a component that are held against each other at once
UNIT_GRAMS = 1_000_000  #: and the grams of their sets
COLUMNS = 4096  #: grams of a matrix of memberships
BROADCAST_IDS = 1_000_000  #: ids are broadcast up to this many, else joined by a shuffle


def gram_sets(batch_texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of every text."""
    h, first = B.word_hashes(*B.text_bytes(batch_texts), B.SPACED)
    g = B.grams(h, n, seed=2)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield B.mix(B.grams(h[a:b], int(b - a), seed=3) + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def _parts(docs: DataFrame) -> int:
    """Hash ranges: as many as shuffle partitions, and more for more input."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // (8 << 20), 1 << 20), 4)


def _part_of(high: np.ndarray, parts: int) -> np.ndarray:
    return ((high.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Order:
    """The global order: rare grams by hash, then the frequent ones (sorted upper halves of their hashes) by document count.

    load: occurrences of all grams in all documents.
    """

    def __init__(self, halves: np.ndarray, counts: np.ndarray, load: int) -> None:
        self.halves, self.counts, self.load = halves, counts, max(load, 1)
        self.rare = max(load - int(counts.sum()), 0)
        by = np.lexsort((halves, counts))
        self.reach = np.empty(len(halves), dtype=np.int64)
        self.reach[by] = self.rare + np.cumsum(counts[by].astype(np.int64))

    def often(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document count of each frequent gram and 0 for rare ones, its place in the list)."""
        if not len(self.halves):
            return np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.halves, (g >> np.uint64(32)).astype(np.uint32)), len(self.halves) - 1)
        return np.where(self.halves[at] == g >> np.uint64(32), self.counts[at], 0).astype(np.int64), at

    def fragment(self, g: np.ndarray, fragments: int) -> np.ndarray:
        """The fragment of each gram: fragments hold equal loads and follow each other in the order."""
        often, at = self.often(g)
        before = (g >> np.uint64(32)).astype(np.float64) / 2.0**32 * self.rare
        if len(self.halves):
            before = np.where(often > 0, self.reach[at] - 1, before)
        return np.minimum((before * fragments / self.load).astype(np.int64), fragments - 1)


def frequent_grams(docs: DataFrame, n: int = N, most: int = MOST_FREQUENT) -> Order:
    """The global order; its list holds the frequent grams, at most ``most``.

    Counted over all grams of all documents, in blocks first, so that a gram of every document
    comes once from each block. Halves that coincide are counted
    together, which moves both in the order and changes no result.
    """
    parts = _parts(docs)
    schema = pa.schema([("part", pa.int32()), ("ones", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for g in gram_sets(batch.column(0), n):
                held.append((g >> np.uint64(32)).astype(np.uint32))
                size += len(g)
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)
        B.trim()

    def thin(x: np.ndarray) -> bytes:
        """Differences of sorted numbers, low and high halves apart: the latter are nearly all zero and compress away."""
        return np.diff(x, prepend=np.uint32(0)).astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()

    def thick(b: bytes) -> np.ndarray:
        return np.cumsum(np.ascontiguousarray(np.frombuffer(b, dtype="<u2").reshape(2, -1).T).view("<u4").ravel(), dtype=np.uint32)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        x, c = np.unique(np.concatenate(held), return_counts=True)
        p = _part_of(x, parts)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
        runs = [(x[a:b], c[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        blobs = [[thin(r[k == 1]) for r, k in runs], [thin(r[k > 1]) for r, k in runs], [k[k > 1].astype("<u4").tobytes() for _, k in runs]]
        return pa.RecordBatch.from_arrays([pa.array(p[cuts[:-1]], pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], schema=schema)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ones = [thick(b) for b in pdf["ones"]]
        x = np.concatenate([*ones, *(thick(b) for b in pdf["more"])])
        c = np.concatenate([np.ones(sum(map(len, ones)), dtype=np.int64), *(np.frombuffer(b, dtype="<u4") for b in pdf["counts"])]).astype(np.int64)
        order = np.argsort(x, kind="stable")
        x, c = x[order], c[order]
        cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        load = int(c.sum())
        c = np.minimum(np.add.reduceat(c, cuts), 0xFFFFFFFF)
        k = c > OFTEN
        del ones, order
        B.trim()
        return pd.DataFrame({"halves": [x[cuts[k]].astype("<u4").tobytes()], "counts": [c[k].astype("<u4").tobytes()], "load": load, "over": [[int((c > OFTEN << j).sum()) for j in range(28)]]})

    counted = saved(docs.select(whole_text().alias("text")).mapInArrow(gather, "part int, ones binary, more binary, counts binary").groupBy("part").applyInPandas(count, "halves binary, counts binary, load long, over array<long>"), "frequent", free=True)
    over = counted.agg(F.sum("load").alias("load"), *(F.sum(F.col("over")[j]).alias(f"o{j}") for j in range(28))).collect()[0]
    least = next((OFTEN << j for j in range(28) if (over[f"o{j}"] or 0) <= most), OFTEN << 28)

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, c in zip(pdf["halves"], pdf["counts"], strict=True):
                h, c = np.frombuffer(h, dtype="<u4"), np.frombuffer(c, dtype="<u4")
                yield pd.DataFrame({"halves": [h[c > least].tobytes()], "counts": [c[c > least].tobytes()]})

    rows = counted.select("halves", "counts").mapInPandas(only, "halves binary, counts binary").collect()  # at most ``most`` grams
    drop_saved(counted)
    halves = np.concatenate([np.zeros(0, dtype="<u4"), *(np.frombuffer(r.halves, dtype="<u4") for r in rows)])
    counts = np.concatenate([np.zeros(0, dtype="<u4"), *(np.frombuffer(r.counts, dtype="<u4") for r in rows)])
    order = np.argsort(halves)
    return Order(halves[order], counts[order], over["load"] or 0)


@dataclass(frozen=True)
class Names:
    """64-bit names of sets, the same for equal sets. shared: names that different sets have; these go by both hashes.

    bits: of the first hash that are used (fewer in tests).
    """

    bits: int = 64
    shared: frozenset[int] = frozenset()

    def both(self, g: np.ndarray) -> tuple[int, int]:
        """(name, a second and independent hash) of a set."""
        n = np.uint64(len(g))
        a, b = (B.mix(B.mix(g ^ np.uint64(k)).sum(dtype=np.uint64, keepdims=True) + n).view(np.int64)[0] for k in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B))
        name = int(a) >> (64 - self.bits)
        return (name ^ int(b) if name in self.shared else name), int(b)


def members(docs: DataFrame, order: Order, n: int = N, percent: int = PERCENT, bits: int = 64) -> tuple[DataFrame, Names]:
    """(doc_id, c, n, prefix) of every row: its class, set size, and first grams in the global order; and the classes' names."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # bounded by MOST_FREQUENT
    schema = pa.schema([("doc_id", pa.int64()), ("c", pa.int64()), ("v", pa.int64()), ("n", pa.int32()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(bits)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for g in gram_sets(batch.column(1), n):
                p = len(g) - (percent * len(g) + 99) // 100 + 1 if len(g) else 0
                name = names.both(g)
                often, _ = shared.value.often(g)
                if often.any():
                    g = g[np.lexsort((g, often))]
                for col, x in zip(out, (*name, len(g), g[:p].astype("<u8").tobytes()), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(col, f.type) for col, f in zip(out, list(schema)[1:], strict=True))], schema=schema)
            B.trim()

    wide = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, c long, v long, n int, prefix binary"), "members")
    twice = wide.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo != hi").select("c")
    found = frozenset(r.c for r in twice.limit(1_000_001).collect())  # of n sets about n^2 / 2^65 pairs share a name: a hundred at 6e10
    if len(found) > 1_000_000:
        raise RuntimeError("too many sets share their 64-bit names")
    if found:
        both = F.transform(F.array(*map(F.lit, sorted(found))), lambda x: x)
        wide = wide.withColumn("c", F.when(F.array_contains(both, F.col("c")), F.col("c").bitwiseXOR(F.col("v"))).otherwise(F.col("c")))
    return wide.drop("v"), Names(bits, found)


def reachable(na: np.ndarray, nb: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets can link whose first common gram leaves them so many grams from it on.

    True links pass where their first common gram is indexed, so this may be asked of any common gram.
    """
    most = np.minimum(rest_a, rest_b)
    return 100 * most >= percent * (na + nb - most)


def leaders(n: np.ndarray, marked: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """For the members of a posting, by size: each one's leader, as places in the posting.

    A leader is a marked member drawn by ``seed``; it takes all open members that it may link with by
    size and marks, and so on until no marked member is open. Members that nobody takes lead themselves.
    """
    out, open_ = np.arange(len(n)), np.ones(len(n), dtype=bool)
    while True:
        left = np.flatnonzero(open_ & marked)
        if not len(left):
            return out
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        at = left[(seed >> 33) % len(left)]
        low, high = np.minimum(n, n[at]), np.maximum(n, n[at])
        take = open_ & (low * 100 >= percent * high) & ((n >= n[at]) | marked)
        take[at] = True
        out[take] = at
        open_ &= ~take


def postings(g: np.ndarray, n: np.ndarray, marked: np.ndarray, split: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, whether a leads b) as places in entries sorted by (g, n, unmarked first last): all pairs of small postings, leaders of others."""
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.append(first, len(g)))
    small = (length <= SMALL) & ~split[first]
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for d in range(1, SMALL):
        for s in range(SMALL - d):
            f = first[small & (length > s + d)]
            left.append(f + s)
            right.append(f + s + d)
    k = sum(map(len, left))
    for f, size in zip(first[~small], length[~small], strict=True):
        left.append(f + leaders(n[f : f + size], marked[f : f + size], int(g[f]) & ((1 << 62) - 1), percent))
        right.append(np.arange(f, f + size))
    a, b = np.concatenate(left), np.concatenate(right)
    return a, b, np.arange(len(a)) >= k


_FOUND = "kind byte, g long, a long, b long, na int, nb int, marked boolean, rest int, split boolean"


def _found(x: dict[str, np.ndarray], percent: int) -> pd.DataFrame:
    """Pairs and leaders (_FOUND) among entries g, n, marked, rest, c, split: kind 0, a pair to check; kind 1, b in posting g has leader a."""
    order = np.lexsort((x["c"], ~x["marked"], x["n"], x["g"]))
    x = {k: v[order] for k, v in x.items()}
    once = np.concatenate([[True], (x["g"][1:] != x["g"][:-1]) | (x["c"][1:] != x["c"][:-1])])
    x = {k: v[once] for k, v in x.items()}
    n, flag, rest, c = x["n"], x["marked"], x["rest"], x["c"]
    a, b, lead = postings(x["g"], n, flag, x["split"], percent)
    ok = lead | flag[a] & reachable(n[a], n[b], rest[a], rest[b], percent)  # a is the smaller set here
    a, b, lead = a[ok], b[ok], lead[ok]
    out = pd.DataFrame({"kind": lead.astype(np.int8), "g": x["g"][b], "a": c[a], "b": c[b], "na": n[a].astype(np.int32), "nb": n[b].astype(np.int32), "marked": flag[b], "rest": rest[b].astype(np.int32), "split": x["split"][b]})
    posts = out[out["kind"] == 1]
    # Leaders meet all their members, reachable or not: the distances are used in step 5.
    pairs = pd.concat([out[out["kind"] == 0], posts[posts["a"] != posts["b"]].assign(kind=np.int8(0))])
    swap = pairs["a"] > pairs["b"]  # a pair is found from either side, but named once
    pairs = pairs.assign(**{x: pairs[x].where(~swap, pairs[y]) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))}).drop_duplicates(["a", "b"])
    return pd.concat([pairs, posts])


def candidates(rows: DataFrame, order: Order, parts: int, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """Pairs and leaders (_FOUND) from members."""
    shared = rows.sparkSession.sparkContext.broadcast(order)
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
    entry = np.dtype([("g", "<i8"), ("n", "<u4"), ("rest", "<u4"), ("c", "<i8")])  # rest: the set's grams from this one on
    mark, cut = np.uint32(1 << 31), np.uint32(1 << 31)  # set in n: the gram is among those that the smaller set of a link must share; in rest: the posting is in chunks

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        size = 0
        for batch in batches:
            for c, n, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n and c not in held:
                    held[c] = (n, np.frombuffer(prefix, dtype="<u8"))
                    size += len(held[c][1])
            if size >= FLUSH:
                yield packed(held)
                held, size = {}, 0
        if held:
            yield packed(held)
        B.trim()

    def packed(held: dict) -> pa.RecordBatch:
        g = np.concatenate([x for _, x in held.values()])
        k = np.array([len(x) for _, x in held.values()])
        x = np.empty(len(g), dtype=entry)
        x["g"] = g.view(np.int64)
        n = np.array([n for n, _ in held.values()], dtype=np.int64)
        marked = n - (2 * percent * n + 99 + percent) // (100 + percent) + 1
        place = np.arange(len(g)) - np.repeat(np.cumsum(k) - k, k)
        x["n"] = np.repeat(n, k).astype(np.uint32) | np.where(place < np.repeat(marked, k), mark, np.uint32(0))
        x["c"] = np.repeat(np.fromiter(held, dtype=np.int64, count=len(held)), k)
        often, _ = shared.value.often(g)
        chunks = (1 + often // hot).astype(np.uint64)
        x["rest"] = (np.repeat(n, k) - place).astype(np.uint32) | np.where(chunks > 1, cut, np.uint32(0))
        chunk = B.mix(x["c"].view(np.uint64) ^ np.uint64(0x517CC1B727220A95)) % chunks
        p = _part_of(B.mix(g + chunk * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32), parts)
        by = np.argsort(p, kind="stable")
        p, x = p[by], x[by]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
        return pa.RecordBatch.from_arrays([pa.array(p[cuts[:-1]], pa.int32()), pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=schema)

    def pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(b, dtype=entry) for b in pdf["data"]])
        B.trim()
        return _found({"g": x["g"], "n": (x["n"] & ~mark).astype(np.int64), "marked": x["n"] >= mark, "rest": (x["rest"] & ~cut).astype(np.int64), "c": x["c"], "split": x["rest"] >= cut}, percent)

    packed_rows = rows.select("c", "n", "prefix").mapInArrow(gather, "part int, data binary")
    out = saved(packed_rows.groupBy("part").applyInPandas(pair_up, _FOUND), "candidates", free=True)
    own = F.col("a") == F.col("b")
    tops = out.where((F.col("kind") == 1) & F.col("split") & own)
    pairs, last = out, None
    while True:  # the leaders of a posting's chunks draw leaders, as long as that leaves far fewer; what stays apart is left to step 5
        counts = tops.groupBy("g").agg(F.count("*").alias("members")).where("members > 1")
        most = counts.agg(F.max("members")).collect()[0][0]
        if most is None or last is not None and most > last // 2:
            return pairs
        last = most
        dealt = tops.select("g", F.col("b").alias("c"), F.col("nb").alias("n"), "marked", "rest").join(counts, "g").withColumn("chunks", 1 + F.expr(f"members div {hot}"))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("c"), "chunks")), F.lit(parts)))

        def again(pdf: pd.DataFrame) -> pd.DataFrame:
            x = {k: pdf[k].to_numpy() for k in ("g", "n", "marked", "rest", "c")}
            return _found(x | {"n": x["n"].astype(np.int64), "rest": x["rest"].astype(np.int64), "split": np.ones(len(pdf), dtype=bool)}, percent)

        level = saved(dealt.groupBy("part").applyInPandas(again, _FOUND), "leaders")
        pairs = pairs.unionByName(level.where("kind = 0"))
        tops = level.where((F.col("kind") == 1) & own)
        if most <= hot:
            return pairs


def segments(docs: DataFrame, classes: DataFrame, order: Order, names: Names, n: int = N, which: tuple[int, ...] = STAGES[0], fragments: int = FRAGMENTS) -> DataFrame:
    """(c, f, grams) for the classes (c, rep): the segment of each set in each of the fragments, empty ones included.

    Rows with a repeated doc_id give a class's segments more than once.
    """
    ids = classes.select(F.col("rep").alias("doc_id")).where("doc_id is not null")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    few = classes.count() <= BROADCAST_IDS
    wanted = d.join(F.broadcast(ids.distinct()) if few else ids.distinct(), "doc_id", "left_semi")
    if classes.where("rep is null").limit(1).count():
        wanted = wanted.unionByName(d.where("doc_id is null"))
    shared = docs.sparkSession.sparkContext.broadcast(order)
    schema = pa.schema([("c", pa.int64()), ("f", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cs, sizes, parts = [], [], [np.zeros(0, dtype=np.uint64)]
            for g in gram_sets(batch.column(0), n):
                if len(g):
                    cs.append(names.both(g)[0])
                    f = shared.value.fragment(g, fragments)
                    for k in which:
                        parts.append(g[f == k])
                        sizes.append(len(parts[-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
            B.trim()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(cs, dtype=np.int64), len(which))), pa.array(np.tile(np.array(which, dtype=np.int32), len(cs))), lists], schema=schema)

    rows = wanted.select("text").mapInArrow(run, "c long, f int, grams array<long>")
    wanted_c = classes.select("c")
    return rows.join(F.broadcast(wanted_c) if few else wanted_c, "c", "left_semi")


def overlaps(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order: Order, names: Names, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked, nearest, farthest) of pairs (a, b, na, nb): whether they link, and bounds of their Jaccard distance.

    Each (fragment, pair) is counted by itself; the counts are summed by pair, before pairs are pruned and after.
    """
    zero = F.lit(0).cast("long")
    todo = pairs.select("a", "b", F.col("na").cast("long").alias("na"), F.col("nb").cast("long").alias("nb"), zero.alias("common"), zero.alias("sa"), zero.alias("sb"))
    out = None
    for which in STAGES:
        ends = todo.select(F.col("a").alias("c")).unionByName(todo.select(F.col("b").alias("c"))).distinct()
        involved = saved(classes.join(ends, "c", "left_semi"), "involved")
        seg = saved(segments(docs, involved, order, names, n, which), "segments", free=True)
        work = todo.withColumn("f", F.explode(F.array(*map(F.lit, which))))
        # Each row meets b's segment first; only that travels on to a's.
        x = work.join(seg.select(F.col("c").alias("b"), "f", F.col("grams").alias("gb")), ["b", "f"])
        x = x.join(seg.select(F.col("c").alias("a"), "f", F.col("grams").alias("ga")), ["a", "f"])
        key = ["a", "b", "na", "nb", "common", "sa", "sb"]
        part = x.select(*key, "f", F.size(F.array_intersect("ga", "gb")).alias("k"), F.size("ga").alias("la"), F.size("gb").alias("lb"))
        # Repeated rows of a class count once: the maximum of each fragment, then the sum over the fragments.
        sums = part.groupBy(*key).agg(*(F.max(F.when(F.col("f") == j, F.struct("k", "la", "lb"))).alias(f"f{j}") for j in which))
        total = lambda c: sum((F.col(f"f{j}.{c}") for j in which[1:]), F.col(f"f{which[0]}.{c}")).cast("long")  # noqa: E731, B023
        k = sums.select("a", "b", "na", "nb", (F.col("common") + total("k")).alias("common"), (F.col("sa") + total("la")).alias("sa"), (F.col("sb") + total("lb")).alias("sb"))
        k = k.withColumn("most", F.col("common") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb")))
        k = saved(k.withColumn("can", F.expr(f"100 * most >= {percent} * (na + nb - most)")), "overlaps", free=True)
        drop_saved(seg)
        last = which is STAGES[-1]
        near = 1 - F.col("most") / (F.col("na") + F.col("nb") - F.col("most"))
        far = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
        done = (k if last else k.where("not can")).select("a", "b", F.col("can").alias("linked"), near.alias("nearest"), far.alias("farthest"))
        out = done if out is None else out.unionByName(done)
        todo = k.where("can").drop("most", "can")
    return out


def common(owner: np.ndarray, grams: np.ndarray, k: int, cut: int) -> np.ndarray:
    """Overlaps of the sets 0..cut-1 (rows) with the sets cut..k-1 (columns), or of all sets with all if cut is k.

    Grams of few sets give their pairs, the others are columns of a matrix of memberships, a bounded number at a time.
    """
    first = 0 if cut == k else cut
    wide = k - first
    out = np.zeros(cut * wide, dtype=np.int64)
    by = np.argsort(grams, kind="stable")
    g, owner = grams[by], owner[by]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(start, len(g)))
    few = max(k // 12, 1)
    for d in range(1, few):  # pairs of a gram's sets, d places apart; owners ascend within a gram
        more = (count <= few) & (count > d)
        if not more.any():
            break
        size = count[more] - d
        at = np.repeat(start[more] - np.cumsum(size) + size, size) + np.arange(size.sum())
        x, y = owner[at], owner[at + d]
        if first:
            ok = (x < cut) & (y >= cut)
            x, y = x[ok], y[ok] - cut
        np.add.at(out, x * wide + y, 1)
        if not first:
            np.add.at(out, y * wide + x, 1)
    out = out.reshape(cut, wide)
    many = np.flatnonzero(count > few)
    for s in range(0, len(many), COLUMNS):
        some = many[s : s + COLUMNS]
        size = count[some]
        at = np.repeat(start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
        m = np.zeros((k, len(some)), dtype=np.float32)  # sums of at most COLUMNS ones are exact
        m[owner[at], np.repeat(np.arange(len(some)), size)] = 1
        out += (m[:cut] @ m[first:].T).astype(np.int64)
    return out


def degrees(docs: DataFrame, classes: DataFrame, labels: DataFrame, order: Order, names: Names, n: int = N, percent: int = PERCENT, unit: int = UNIT) -> DataFrame:
    """(c, n_links): with how many other classes each class links, for the classes (c, n, rep) in components (node, component).

    All links are inside components. A component is dealt into blocks of bounded size, and every pair of its blocks, and every
    block, is a unit that counts all overlaps in it at once. A unit passes on one sum per class, no pairs, and the
    sums of a class are added. The work grows with the square of the classes in a component, as the number of links may.
    """
    inside = classes.join(labels.withColumnRenamed("node", "c"), "c")
    sizes = inside.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("load"))
    sizes = sizes.select("component", F.greatest(F.expr(f"(members + {unit - 1}) div {unit}"), F.expr(f"(load + {UNIT_GRAMS - 1}) div {UNIT_GRAMS}")).alias("blocks"))
    inside = saved(inside.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("c"), "blocks")), "inside")
    load = inside.agg(F.sum(F.col("n") * F.col("blocks"))).collect()[0][0] or 0
    parts = max(_parts(docs), min(load // UNIT_GRAMS, 1 << 20))
    sets = segments(docs, inside, order, names, n, (0,), 1).groupBy("c").agg(F.first("grams").alias("grams"))  # repeated rows count once
    x = inside.drop("rep").join(sets, "c").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x = x.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "c", "n", "grams")
    x = x.withColumn("part", F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(parts)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """All units of one hash range."""
        pdf = pdf.sort_values(["component", "lo", "hi", "block", "c"])
        comp, lo, hi, block, c = (pdf[k].to_numpy() for k in ("component", "lo", "hi", "block", "c"))
        size, grams = pdf["n"].to_numpy().astype(np.int64), pdf["grams"].to_numpy()
        new = np.flatnonzero((comp[1:] != comp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        links = np.zeros(len(pdf), dtype=np.int64)
        for s, t in zip([0, *new], [*new, len(pdf)], strict=True):
            k, across = int(t - s), lo[s] != hi[s]
            cut = int((block[s:t] == lo[s]).sum()) if across else k
            if across and cut in (0, k):
                continue
            owner = np.repeat(np.arange(k), [len(q) for q in grams[s:t]])
            both = common(owner, np.concatenate(grams[s:t]), k, cut)
            a, b = size[s : s + cut], size[s + cut : t] if across else size[s:t]
            linked = 100 * both >= percent * (a[:, None] + b[None, :] - both)
            if across:
                links[s + cut : t] += linked.sum(axis=0)
            else:
                np.fill_diagonal(linked, False)
            links[s : s + cut] += linked.sum(axis=1)
        B.trim()
        return pd.DataFrame({"c": c, "n_links": links})

    done = saved(x.groupBy("part").applyInPandas(count, "c long, n_links long"), "degrees", free=True)
    return done.groupBy("c").agg(F.sum("n_links").alias("n_links"))


def ngram_join(docs: DataFrame, n: int = N, percent: int = PERCENT, hot: int = HOT, bits: int = 64, unit: int = UNIT, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, least_id, n_links) for every row of the documents.

    class_id names the set, the same for equal sets; least_id is the smallest doc_id that has it (null where only rows without a doc_id
    have it; a row without words has its own). n_links: all other sets that link with this one; without ``count_links`` null.
    """
    order = frequent_grams(docs, n)
    wide, names = members(docs, order, n, percent, bits)
    parts = _parts(docs)
    found = candidates(wide, order, parts, percent, hot)
    rows = saved(wide.select("doc_id", "c", "n"), "rows")
    drop_saved(wide)
    classes = saved(rows.where("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("rep")), "classes")
    pairs = saved(found.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")), "pairs")
    checked = overlaps(docs, pairs, classes, order, names, n, percent)
    labels = components(saved(checked.where("linked").select("a", "b"), "round1"))
    for star in (True, False):
        more = unresolved(found, labels, checked, star, parts, percent, hot)
        if more.limit(1).count():
            extra = saved(overlaps(docs, more, classes, order, names, n, percent), "checked")
            checked = checked.unionByName(extra)
            labels = merged(labels, extra.where("linked").select("a", "b"))
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component")
    if count_links:
        named = named.join(degrees(docs, classes, labels, order, names, n, percent, unit), "c", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    named = saved(named.select("c", "component_id", F.col("rep").alias("least_id"), "n_links"), "named")
    out = rows.select("doc_id", "c", F.col("n").cast("long").alias("n_shingles")).join(named, "c", "left")
    none = F.col("n_shingles") == 0
    own = lambda x: F.when(none, F.col("doc_id")).otherwise(F.col(x)).alias(x)
    return out.select("doc_id", "n_shingles", own("component_id"), F.col("c").alias("class_id"), own("least_id"), F.when(none & F.lit(count_links), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after further links: only the components that they join are worked on."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    named = links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    named = saved(named, "between")
    new = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    nodes = labels.unionByName(named.select(F.col("a").alias("node"), F.col("ca").alias("component"))).unionByName(named.select(F.col("b").alias("node"), F.col("cb").alias("component"))).distinct()
    return saved(nodes.join(new.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")


def unresolved(found: DataFrame, labels: DataFrame, checked: DataFrame, star: bool, parts: int, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """Pairs (a, b, na, nb) of larger postings that are in different components, were not checked, and may still link.

    star: only pairs with leaders newly drawn, which leave fewer pairs to the full round.
    """
    posts = found.where("kind = 1").select("g", F.col("b").alias("c"), F.col("nb").alias("n"), F.col("a").alias("leader"), "marked", "rest")
    posts = posts.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    open_ = posts.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo != hi")
    posts = posts.join(saved(open_.select("g", (1 + F.expr(f"members div {hot}")).alias("chunks")), "open"), "g")
    # Each member has a block of its posting. Leaders are drawn in blocks; for the full round every pair of blocks, and every block, is a unit.
    posts = posts.withColumn("block", F.pmod(F.xxhash64("c"), "chunks"))
    other = F.array("block") if star else F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    posts = posts.withColumn("other", F.explode(other)).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "chunks")
    both = checked.select("a", "b", "nearest", "farthest")
    far = both.select(F.col("a").alias("leader"), F.col("b").alias("c"), "nearest", "farthest").unionByName(both.select(F.col("b").alias("leader"), F.col("a").alias("c"), "nearest", "farthest"))
    posts = posts.join(far, ["leader", "c"], "left")
    own = F.col("leader") == F.col("c")
    posts = posts.withColumns({"nearest": F.when(own, 0.0).otherwise(F.coalesce("nearest", F.lit(0.0))), "farthest": F.when(own, 0.0).otherwise(F.coalesce("farthest", F.lit(1.0)))})
    most = 1 - percent / 100 + 1e-9

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        """All open postings of one hash range."""
        pdf = pdf.assign(late=~pdf["marked"]).sort_values(["g", "lo", "hi", "n", "late", "c"])
        x = {k: pdf[k].to_numpy() for k in pdf.columns}
        x["n"], x["rest"] = x["n"].astype(np.int64), x["rest"].astype(np.int64)
        new = (x["g"][1:] != x["g"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], new])), [len(pdf)]])
        found = [pair_up({k: v[s:t] for k, v in x.items()}, s) for s, t in zip(edges[:-1], edges[1:], strict=True)]
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        c, n = x["c"], x["n"]
        a, b = np.where(c[a] <= c[b], a, b), np.where(c[a] <= c[b], b, a)
        return pd.DataFrame({"a": c[a], "b": c[b], "na": n[a], "nb": n[b]}).drop_duplicates(["a", "b"])

    def pair_up(x: dict[str, np.ndarray], at: int) -> tuple[np.ndarray, np.ndarray]:
        n, comp, marked = x["n"], x["component"], x["marked"]
        if star:
            b = np.arange(len(n))
            a = leaders(n, marked, (int(x["g"][0]) & ((1 << 62) - 1)) + 1, percent)
            return a[comp[a] != comp[b]] + at, b[comp[a] != comp[b]] + at
        lead, rest, near, far = x["leader"], x["rest"], x["nearest"], x["farthest"]
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        apart = x["lo"][0] != x["hi"][0]  # two blocks: only pairs across
        for i in np.flatnonzero(marked):
            j = np.arange(i + 1, np.searchsorted(n, int(n[i]) * 100 // percent, "right"))
            if apart:
                j = j[x["block"][j] != x["block"][i]]
            j = j[(comp[j] != comp[i]) & reachable(n[i], n[j], rest[i], rest[j], percent)]
            if len(j):
                j = j[~((lead[j] == lead[i]) & ((near[j] - far[i] > most) | (near[i] - far[j] > most)))]
                left.append(np.full(len(j), i))
                right.append(j)
        return np.concatenate(left) + at, np.concatenate(right) + at

    pairs = posts.withColumn("part", F.pmod(F.xxhash64("g", "lo", "hi"), F.lit(parts))).groupBy("part").applyInPandas(cross, "a long, b long, na int, nb int").distinct()
    return saved(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "open-pairs")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; also class_id, the smallest doc_id with an equal set, and n_links, all other sets that link with it."""
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", F.col("least_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents whose doc_id is their component's smallest. All columns stay.

    Rows with a null doc_id are kept; rows that repeat a kept doc_id are kept with it. The
    ids that go are broadcast up to BROADCAST_IDS and joined by a shuffle of the texts beyond.
    """
    out = ngram_join(docs, n, percent, count_links=False).where("doc_id is not null")
    kept = out.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    gone = saved(kept.where("not kept").select("doc_id"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 75 * (m.n + o.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
k AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY v) AS class_id FROM (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS v FROM s GROUP BY doc_id)),
m AS (SELECT l.a, count(DISTINCT y.class_id) AS n_links FROM l JOIN k x ON x.doc_id = l.a JOIN k y ON y.doc_id = l.b WHERE x.class_id <> y.class_id GROUP BY l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
  coalesce(k.class_id, d.doc_id) AS class_id, coalesce(m.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

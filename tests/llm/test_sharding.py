import random
from collections import defaultdict

import pytest

from keylog.llm import sharding as S


def brute(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_minimal(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(1 << S.BITS) if r.random() < 0.9 else (77 << 48) + r.randrange(50), r.randrange(1, 10**r.randrange(1, 6))) for _ in range(3000)]
    if seed == 1:
        rows += [(5 << 40, 1000)] * 2000
    if seed == 2:
        rows = [((1 << 30) + r.randrange(200), 7 + r.randrange(3)) for _ in range(500)]
    if seed == 3:
        rows = rows[:5]
    groups = defaultdict(int)
    for h, s in rows:
        groups[h] += s
    keys = sorted(groups)
    capacity, hashes = S.minimax_cuts(spark.createDataFrame(rows, "h long, size long"), 16)
    assert capacity == brute([groups[h] for h in keys], 16)
    loads = defaultdict(int)
    for h in keys:
        loads[sum(h >= c for c in hashes[:-1])] += groups[h]
    assert max(loads.values()) == capacity and max(loads) < 16


def test_documents(spark):
    rows = [(i, f"text {i % 40}") for i in range(300)] + [(None, None), (7, ""), (7, ""), (9, "x" * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as h", "3 as size", "4 as _part")
    out = S.shard_documents(docs, 16).collect()
    assert len(out) == len(rows)
    of = defaultdict(set)
    slots = defaultdict(list)
    for r in out:
        of[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty(spark):
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_a_plain_reading_of_its_contract(spark):
    """Every column of op8's rows by plain Python; the largest shard is as small as any contiguous cut of the ordered groups allows."""
    import hashlib
    import zlib
    from collections import defaultdict

    import duckdb

    from keylog.llm import sharding

    d = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{d}/documents.parquet'").fetchall())
    rows = sharding.op8_sharding(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    groups, shard_of, total, slots = defaultdict(int), {}, defaultdict(int), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 16
        groups[hashlib.md5(raw).hexdigest()[:15], raw] += r.size
        assert shard_of.setdefault(raw, r.shard) == r.shard
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = [(n, raw) for (_, raw), n in sorted(groups.items(), key=lambda x: x[0][0])]
    assert [shard_of[raw] for _, raw in ordered] == sorted(shard_of.values())  # contiguous

    def shards(capacity):
        used, room = 1, capacity
        for n, _ in ordered:
            if n > capacity:
                return 10**9
            if n > room:
                used, room = used + 1, capacity
            room -= n
        return used

    best = max(total.values())
    assert shards(best) <= 16 < shards(best - 1)

import random

import numpy as np
import pytest

from keylog.llm import suffix_dedup as S


@pytest.mark.parametrize("seed", range(8))
def test_suffix_order(seed):
    r = random.Random(seed)
    for n in [*range(1, 13), 100, 101, 102, 700]:
        s = [r.randrange(1, r.choice([2, 3, 30])) for _ in range(n)]
        if n > 200:
            s[300:] = s[:400]
        got = S.suffix_order(np.array(s)).tolist()
        assert got == sorted(range(n), key=lambda i: s[i:])


def corpus(seed):
    r = random.Random(seed)
    some = lambda n, a="abcdefgh é": "".join(r.choice(a) for _ in range(n))
    shared = [some(r.randrange(60, 400)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [some(r.randrange(0, 200))]
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randrange(50, 400)], some(r.randrange(0, 120))]
        rows.append((r.randrange(10_000), "".join(parts)))
    for _ in range(30):
        i, t = r.choice(rows)
        t = list(t)
        for _ in range(r.randrange(3)):
            if t:
                t[r.randrange(len(t))] = "X"
        rows.append((r.randrange(10_000), "".join(t)))
    rows += [(20_000, "ab" * 300), (20_001, "a" * 99), (20_002, "a" * 100), (20_003, "a" * 500), (None, rows[0][1]), (None, None), (20_004, ""), (20_005, None), rows[3], rows[3], (-5, shared[0])]
    ids = set()
    return [x for x in rows if x[0] is None or x == rows[3] or not (x[0] in ids or ids.add(x[0]))]


@pytest.mark.parametrize(("hot", "one_in"), [(S.HOT, 16), (3, 16), (3, 1), (1, 1)])
def test_against_brute_force(spark, hot, one_in, monkeypatch):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "ONE_IN", one_in)
    monkeypatch.setattr(S, "FLUSH", 5000)
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rid", "2 as start", "3 as kind").coalesce(1)
    out = S.dedup(docs)
    got = sorted(map(repr, [tuple(r) for r in out.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()]))
    assert got == sorted(map(repr, S.brute_force(rows)))


def test_hot_grams_are_bounded_and_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "ONE_IN", 1)
    monkeypatch.setattr(S, "HOT", 1)
    rows = corpus(5)
    docs = S._placed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    every = S.hot_grams(docs)
    monkeypatch.setattr(S, "MOST_HOT", 5)
    few = S.hot_grams(docs)
    assert len(every) > 5 >= len(few) and np.isin(few, every).all() and (np.diff(every.view(np.int64)) > 0).all()
    got = sorted(map(repr, [tuple(r) for r in S.dedup(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()]))
    assert got == sorted(map(repr, S.brute_force(rows)))


def test_rows_keep_their_numbers_however_files_are_split(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    spark.range(3000).selectExpr("id as doc_id", "repeat(cast(id as string), 50) as text").repartition(4).write.option("parquet.block.size", "20000").parquet(path)
    docs = spark.read.parquet(path)
    seen = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            x = S._numbered(S._placed(docs))
            seen.append((x.rdd.getNumPartitions(), {r.doc: r.rid for r in x.select("doc", "rid").collect()}))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0][0] < seen[1][0] and seen[0][1] == seen[1][1]
    assert len(set(seen[0][1].values())) == 3000 and min(seen[0][1].values()) >= 0
    assert S._file_hash([f"s3://b/{i}" for i in range(5000)])[1] == 27


def test_anchors_meet_and_tile():
    r = random.Random(3)
    t = bytes(r.choice(b"abc") for _ in range(3000))
    texts = [t, b"Z" * 50 + t[500:1500], b"q" * 99, b"q" * 400, b""]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    for chunk in (1 << 20, 777, 64):
        x = S.anchors(data, offsets, chunk=chunk)
        windows = [w for lo, hi in zip(x["lo"], x["hi"], strict=True) for w in range(lo, hi + 1)]
        assert windows == [a + i for a, t in zip(offsets, texts, strict=False) for i in range(len(t) - S.LENGTH + 1)]
        owner = {w: g for g, lo, hi in zip(x["g"].tolist(), x["lo"].tolist(), x["hi"].tolist(), strict=True) for w in range(lo, hi + 1)}
        assert all(owner[offsets[1] + 50 + i] == owner[500 + i] for i in range(900))


def test_only_plain_scans_are_read_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert S._placed(docs).inputFiles() == docs.inputFiles()
    for other in (docs.repartition(3), docs.orderBy("text"), docs.distinct(), docs.unionByName(docs), docs.sample(0.5)):
        assert S._placed(other).inputFiles()[0].split("/keylog/")[-1].startswith("texts-")


def test_empty(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0

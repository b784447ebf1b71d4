import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pytest

from keylog.llm import packing as P


def one_by_one(sizes, cap):
    """Sequences used by the same rules, piece by piece."""
    large = sorted((s for s in sizes if 3 * s > cap), reverse=True)
    gaps = []
    while large:
        s = large.pop(0)
        t = next((i for i, t in enumerate(large) if s + t <= cap), None)
        insort(gaps, cap - s - (0 if t is None else large.pop(t)))
    for s in sorted((s for s in sizes if 3 * s <= cap), reverse=True):
        i = bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else cap
        insort(gaps, gap - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_packing_one_by_one(seed):
    r = random.Random(seed)
    cap = r.choice([30, 64, 1024])
    sizes = [r.choice([r.randrange(1, cap + 1), r.randrange(1, cap // 3 + 1), cap // 2]) for _ in range(r.choice([1, 50, 800]))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    placed, opened = P.plan(counts, cap)
    used, got = defaultdict(list), defaultdict(int)
    for p in placed:
        assert p.rank == got[p.length]
        for k in range(p.per * p.bins):
            used[p.first + k // p.per].append((p.offset + k % p.per * p.length, p.length))
        got[p.length] += p.per * p.bins
    assert dict(got) == counts
    for spans in used.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= cap
    assert sorted(used) == list(range(opened)) and opened == one_by_one(sizes, cap)


def test_encoder_equals_library():
    r = random.Random(5)
    from tokenizers import Tokenizer

    e, plain = P.Encoder(P.default_tokenizer()), Tokenizer.from_file(P.default_tokenizer())
    words = ["the", "<|endoftext|", "<|endoftext|><|endoftext|>", "Éau", "naïve", "don't", "I'LL", "<|endoftext|>", "123456", "½", "##", "  ", "\n\n", "\t", "”", "…", "漢字", "🙂", "́", " ", "ſ", "\x00", "ǅ", "x" * 300]
    for _ in range(400):
        t = "".join(r.choice(words) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(30)))
        assert e(t) == plain.encode(t, add_special_tokens=False).ids
    every = "".join(map(chr, range(0x250)))
    assert e(every) == plain.encode(every, add_special_tokens=False).ids
    assert 50256 in e("a <|endoftext|> b")


def test_documents(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (3, ""), (4, "word " * 5000), (5, "x"), *((i, f"number {i} " * (i % 40)) for i in range(6, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as piece", "'q' as _part", "4 as length").repartition(3)
    pieces = P.tokenised(docs, P.default_tokenizer())
    out = P.pack(pieces).collect()
    encode = P.Encoder(P.default_tokenizer())
    want = sorted(repr((i, len(encode(t or "")) + 1)) for i, t in rows)
    whole = defaultdict(int)
    for r in out:
        assert 1 <= r.length <= 1024
        whole[r.doc_id] += r.length
    one = [r for r in out if r.doc_id == 4]
    n = len(encode("word " * 5000)) + 1
    assert sorted((r.piece, r.start, r.length) for r in one) == [(0, 0, n % 1024), *((k, n % 1024 + 1024 * (k - 1), 1024) for k in range(1, n // 1024 + 1))]
    assert sum(whole.values()) == sum(eval(w)[1] for w in want)
    import numpy as np

    ids = np.array([*encode("x"), 2], dtype="<u4").tobytes()
    assert [r.ids_crc32 for r in out if r.doc_id == 5] == [zlib.crc32(ids)]
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for a, m in sorted(spans):
            assert a == at
            at += m
        assert at <= 1024


def test_query_equals_a_plain_reading_of_its_contract(spark):
    """Every column of op6's rows, but for which sequence and place a piece gets, from the library and plain Python."""
    import duckdb
    import numpy as np
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    plain, want = Tokenizer.from_file(P.default_tokenizer()), []
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = P.op6_packing(spark, d).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) <= 1.02 * -(-sum(w[3] for w in want) // 1024) + 1


def test_empty(spark):
    assert P.pack(P.tokenised(spark.createDataFrame([], "doc_id long, text string"), P.default_tokenizer())).count() == 0

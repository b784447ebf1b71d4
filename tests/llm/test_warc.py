import gzip
import io
import random

import pytest

from keylog.llm import warc as W
from keylog.llm.common import scratch


def test_round_trip(spark):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(r.choice("abcdef ghi\n") for _ in range(r.randrange(3000)))) for i in range(80)]
    rows += [(100, "u", rows[3][2]), (101, None, rows[3][2]), (102, "u\r\nX: y", None), (103, "v", ""), (None, "w", "lone"), (None, "w", ""), (104, "é", "é" * 9), (105, "z", "s" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as first", "3 as n").repartition(3)
    archives = W.write_archives(pages, scratch(spark, "w"), archive_bytes=20_000)
    assert archives.count() > 3
    for split in (997, 7919, W.SPLIT_BYTES):
        out = {(x.page_id, x.payload_digest): x for x in W.read_archives(archives, split).collect()}
        assert len(out) == len(rows)
        by = {k[0]: x for k, x in out.items()}
        assert by[100].record_type == by[101].record_type == "revisit" and by[100].refers_to == 3 and by[3].record_type == "response"
        assert by[103].refers_to == 102 and by[103].payload_bytes == 0 and by[100].payload_bytes == by[3].payload_bytes
        for i, _, html in rows:
            if i is not None and by[i].record_type == "response":
                assert bytes(by[i].payload) == (html or "").encode()


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    out = {x.page_id: x.refers_to for x in W.read_archives(W.write_archives(pages, scratch(spark, "w"), min_bytes=3)).collect()}
    assert out == {1: None, 2: None, 3: None, 4: 3}


@pytest.mark.parametrize("split", [1, 10, 100, 1000])
def test_ranges_and_false_magic(split):
    r = random.Random(2)
    bodies = [b"WARC/1.1\r\n\r\n" + bytes(r.randrange(256) for _ in range(r.randrange(300))) for _ in range(20)]
    stored = gzip.compress(b"WARC/1.1\r\n\r\n" + b"\x1f\x8b\x08\x00abc" * 5, 0)  # not compressed: magic inside
    data = b"junk\x1f\x8b" + b"".join(gzip.compress(b) for b in bodies) + gzip.compress(b"no record") + stored + gzip.compress(bodies[0])
    f = io.BytesIO(data)

    def read_at(n, at):
        f.seek(at)
        return f.read(n)

    found = [x for a in range(0, len(data), split) for x in W.members(read_at, a, min(a + split, len(data)), len(data), more=64)]
    assert [x for _, x in found] == [*bodies, gzip.decompress(stored), bodies[0]]


def test_archives_are_plain_warc(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string").coalesce(1)
    path = W.write_archives(pages, scratch(spark, "w")).collect()[0].path
    text = gzip.open(path.removeprefix("file://")).read()
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in text


def test_payloads_that_do_not_compress(spark):
    """Members with gzip magic inside are read back whole, whatever the ranges."""
    r = random.Random(7)
    rows = [(i, "u", "".join(chr(r.choice([0x1F, 0x8B, 8, 0, r.randrange(0x20, 0x7F)])) for _ in range(3000))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = W.write_archives(pages, scratch(spark, "w"))
    for split in (311, W.SPLIT_BYTES):
        assert {x.page_id: bytes(x.payload).decode() for x in W.read_archives(archives, split).collect()} == {i: t for i, _, t in rows}
    noise = bytes(r.randrange(256) for _ in range(1000)) + W.MAGIC + b"WARC/" + W.MAGIC
    data = b"".join(W.member(b"WARC/1.1\r\n\r\n" + noise, 0) for _ in range(5))
    assert data.count(W.MAGIC) == 15
    found = [x for a in range(0, len(data), 97) for x in W.members(lambda n, at: data[at : at + n], a, min(a + 97, len(data)), len(data))]
    assert [x for _, x in found] == [b"WARC/1.1\r\n\r\n" + noise] * 5


def test_records_without_a_page_id_have_ids_of_their_own():
    assert W.record_id(None) != W.record_id(None) and W.record_id(3) == W.record_id(3)


def test_empty(spark):
    assert W.read_archives(W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "w"))).count() == 0

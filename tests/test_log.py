import zlib

import pytest

from keylog.functions.bloom import BloomFilter, geometry
from keylog.functions.crc import crc32c, crc32c_many
from keylog.operators import resolve
from keylog.sources import log as L


def entries(df):
    return [(bytes(r.key), None if r.is_delete else bytes(r.value)) for r in df.orderBy("path", "ordinal").collect()]


def test_append_remove_reopen_truncate(tmp_path):
    p = str(tmp_path / "a.log")
    with L.LogFile(p) as log:
        assert log.recover() == []
        log.append(b"a", b"1")
        log.remove(b"a")
    with L.LogFile(p, sync_writes=True) as log:
        log.append(b"", b"\xff")
        assert log.recover() == [(b"a", b"1"), (b"a", None), (b"", b"\xff")]
        log.truncate()
        log.append(b"b", b"")
        assert log.recover() == [(b"b", b"")]


@pytest.mark.parametrize("damage", ["cut", "flip", "header"])
def test_recovery_ends_at_damage(spark, tmp_path, damage):
    want = [(f"k{i}".encode(), None if i % 5 == 4 else b"v" * i) for i in range(20)]
    data = bytearray(L.encode(want))
    ends = [len(L.encode(want[:i])) for i in range(21)]
    if damage == "cut":
        del data[ends[20] - 1 :]
        good = 19
    elif damage == "flip":
        data[ends[11] - 1] ^= 1
        good = 10
    else:
        data[ends[7] + 4 : ends[7] + 8] = b"\xff\xff\xff\x7f"
        good = 7
    (tmp_path / "000.log").write_bytes(bytes(data))
    (tmp_path / "001.log").write_bytes(L.encode([(b"k0", b"last")]))
    log = L.read_log(spark, str(tmp_path))
    assert entries(log) == want[:good] + [(b"k0", b"last")]
    live = {bytes(r.key): bytes(r.value) for r in resolve.live(L.replay(log)).collect()}
    model = {}
    for k, v in want[:good] + [(b"k0", b"last")]:
        model.pop(k, None) if v is None else model.__setitem__(k, v)
    assert live == model
    shown = L.dump(L.replay(log)).orderBy("idx").collect()
    assert shown[0].op == "PUT" and all(len(r.value or "") <= 23 for r in shown)


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"), False, 3), (bytearray(b"a"), None, True, 1)], "key binary, value binary, is_delete boolean, seq long")
    path = str(tmp_path / "x.log")
    assert L.write_log(df, path) == 2
    with L.LogFile(path) as log:
        assert log.recover() == [(b"a", None), (b"a", b"1")]


def test_crc32c():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0 and crc32c(b"\x00" * 32) == 0x8A9136AA
    assert crc32c(b"6789", crc32c(b"12345")) == 0xE3069283 != zlib.crc32(b"123456789")
    many = [b"x" * n for n in (5, 0, 300, 1)]
    assert list(crc32c_many(many)) == [crc32c(m) for m in many]


def test_bloom(spark):
    assert geometry(1000, 0.01) == (9585, 6)
    df = spark.range(5000).selectExpr("concat('key_', id) as key")
    f = BloomFilter.from_bytes(BloomFilter.of(df, "key").to_bytes())
    assert f.may_contain(df, "key").where("not may_contain").count() == 0
    other = spark.range(5000).selectExpr("concat('no_', id) as key")
    assert f.may_contain(other, "key").where("may_contain").count() < 200

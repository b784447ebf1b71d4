import os
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keylog.operators.compaction import Job, Leveled, Tiered, is_bottom
from keylog.plans.manifest import Run
from keylog.store import Store, StoreOptions
from keylog.workspace import scratch

SMALL = StoreOptions(partitions=2)


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


@pytest.fixture
def store(spark):
    return Store.open(spark, scratch(spark, "test"), SMALL)


def frame(spark, rows, schema="key string, value string"):
    return spark.createDataFrame(rows, schema).repartition(2)


def run(run_id, level, size, low=b"a", high=b"z", seq=1):
    return Run(run_id, run_id, level, low, high, 1, size, seq, seq, 0)


def test_put_get_update_delete(store):
    for k, v in (("a", "1"), ("b", "2"), ("c", "3"), ("key", "old"), ("key", "new")):
        store.put(k, v)
    store.delete("b")
    store.delete("missing")
    assert store.get("a") == b"1" and store.get("key") == b"new" and store.get("b") is None and store.get("missing") is None
    assert pairs(store.scan("a", "c")) == [(b"a", b"1"), (b"c", b"3")]
    store.flush()
    assert store.get("key") == b"new" and store.get("b") is None
    assert pairs(store.scan("a", "c")) == [(b"a", b"1"), (b"c", b"3")]
    assert pairs(store.scan("c", "a")) == []


def test_newest_run_wins_in_get_and_scan(spark, store):
    store.put_df(frame(spark, [("k", "old"), ("m", "1")]))
    store.put_df(frame(spark, [("k", "new")]))
    assert store.get("k") == b"new" and pairs(store.scan()) == [(b"k", b"new"), (b"m", b"1")]


def test_tombstone_hides_older_runs_through_compaction_and_reopen(spark, store):
    store.put_df(frame(spark, [("k", "1"), ("l", "2")]))
    store.compact_all()
    store.delete_df(frame(spark, [("k",)], "key string"))
    assert pairs(store.scan()) == [(b"l", b"2")]
    state = store.manifest.read()
    # a job that leaves out the deep run keeps the tombstone
    store.run_job(state, state.level(0), 1)
    assert store.get("k") is None and store.manifest.read().level(1)[0].n_tombstones == 1
    again = Store.open(spark, store.path)
    assert again.options == SMALL and again.get("k") is None
    again.compact_all()
    assert sum(r.rows for r in again.manifest.read().runs) == 1 and pairs(again.table()) == [(b"l", b"2")]
    assert again.vacuum() and pairs(again.table()) == [(b"l", b"2")]


def test_compaction_keeps_one_row_a_key(spark):
    s = Store.open(spark, scratch(spark, "test"), StoreOptions(partitions=2, style="tiered", fanout=3))
    for i in range(3):
        s.put_df(frame(spark, [("x", str(i)), (f"y{i}", "v")]))
    before = pairs(s.table().orderBy("key"))
    state = s.compact()
    assert [(r.level, r.rows) for r in state.runs] == [(1, 4)] and pairs(s.table().orderBy("key")) == before
    assert "Exchange" not in s.table()._jdf.queryExecution().executedPlan().toString()


def test_odd_values(spark, store):
    store.put(b"", b"empty key")
    store.put(b"\xff", b"\xff")
    store.put("e", "")
    store.flush()
    assert store.get(b"") == b"empty key" and store.get(b"\xff") == b"\xff" and store.get("e") == b""
    assert [k for k, _ in pairs(store.scan())] == [b"", b"e", b"\xff"]


def test_range_crosses_files_and_key_order(spark, store):
    store.put_df(spark.range(5000).selectExpr("format_string('key_%05d', id) as key", "cast(id as string) as value"), unique=True)
    got = pairs(store.scan("key_00123", "key_04321"))
    assert got == [(f"key_{i:05d}".encode(), str(i).encode()) for i in range(123, 4322)]
    store.put_df(frame(spark, [(f"product:{i}", "p") for i in range(1, 11)]))
    assert [k for k, _ in pairs(store.scan("product:3", "product:7"))] == [f"product:{i}".encode() for i in range(3, 8)]
    rows = [r for r in store.manifest.read().runs if r.overlaps(b"product:3", b"product:7")]
    assert len(rows) == 1


def test_deletes_count_toward_the_flush(spark):
    s = Store.open(spark, scratch(spark, "test"), StoreOptions(partitions=1, flush_bytes=32))
    s.put("x" * 15, "y" * 16)
    assert s.buffer_bytes() == 31 and not s.manifest.read().runs
    s.delete("z")
    assert len(s.manifest.read().runs) == 1 and not s.buffer_bytes()
    assert s.get("x" * 15) == b"y" * 16


def test_bad_input(spark, store):
    with pytest.raises(ValueError):
        store.put_df(frame(spark, [("a", "1"), ("a", "2")]))
    with pytest.raises(Exception, match="no key|null"):
        store.put_df(frame(spark, [(None, "1")]))
    with pytest.raises(ValueError):
        store.add_run(store.ops(), 99)
    assert store.manifest.read().level(99) == []
    store.put_df(spark.createDataFrame([("a", "1", 5), ("a", "2", 9), ("a", "3", 7)], "key string, value string, at int"), order="at")
    assert store.get("a") == b"2"
    assert store.put_df(frame(spark, [], "key string, value string")).runs and pairs(store.table()) == [(b"a", b"2")]


def test_racing_writers_and_batch_ids(spark, store):
    errors = []

    def write(t):
        try:
            Store.open(spark, store.path, SMALL).put_df(spark.createDataFrame([(f"key_{t}_{i}", "v") for i in range(25)], "key string, value string"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(t,)) for t in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    state = store.manifest.read()
    assert not errors and store.table().count() == 100 and sorted(r.seq for r in state.runs) == [1, 2, 3, 4] and state.version == 4
    for _ in range(2):
        state = store.put_df(frame(spark, [("z", "1")]), batch_id="b1")
    assert state.version == 5


def test_two_jobs_on_the_same_inputs(spark, store):
    from keylog.plans.manifest import Conflict

    store.put_df(frame(spark, [("a", "1")]))
    state = store.manifest.read()
    store.run_job(state, state.runs, 1)
    with pytest.raises(Conflict):
        store.run_job(state, state.runs, 1)


def test_strategies():
    one = [run(f"r{i}", 0, 1) for i in range(5)]
    assert Tiered(4).score(one, 0) > 1 and Tiered(4).pick(one[:4], 7) == Job(one[:4], 1) and not Tiered(4).pick(one[:2], 7)
    assert Leveled().score([], 0) == 0 and Leveled().pick([], 7).output_level == -1
    gib = 1 << 30
    f5 = [run("a", 0, 300 << 20), run("b", 1, gib, b"a", b"c"), run("c", 1, 2 * gib, b"zz", b"zzz"), *(run(x, 2, gib) for x in "defg")]
    assert [round(Leveled().score(f5, i), 6) for i in range(4)] == [1.171875, 1.2, 0.16, 0]
    job = Leveled().pick(f5, 4)
    assert [r.run_id for r in job.inputs] == ["a", "b"] and job.output_level == 1
    assert Tiered(4).pick(f5, 4).output_level == 3
    assert not is_bottom([f5[0]], f5, 1) and is_bottom(f5, f5, 3)


def test_orphans_are_invisible(spark, store):
    from keylog.sources.runs import write_run

    store.put_df(frame(spark, [("a", "1")]))
    write_run(store.ops(), store._run_path(), 0)  # a crash before the commit
    assert pairs(store.table()) == [(b"a", b"1")] and len(store.vacuum()) == 1
    assert store.files().count() >= 1 and store.runs().count() == 1


def test_predicates_reach_the_scan(spark, store):
    store.put_df(frame(spark, [(f"k{i:03d}", "v") for i in range(100)]))
    store.put_df(frame(spark, [("k050", "w")]))
    plan = store.scan("k010", "k020")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(key") == 2 or plan.count("GreaterThanOrEqual(key") == 1
    live = store.table().where("value = cast('v' as binary)")
    scan = live._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(value" not in scan  # it would bring k050's old value back
    assert live.count() == 99


keys = st.sampled_from(["", "a", "b", "ba", "\x00", "zz"])
step = st.one_of(
    st.tuples(st.just("put"), keys, st.sampled_from(["", "1", "\xff", "long value"])),
    st.tuples(st.just("delete"), keys),
    st.tuples(st.sampled_from(["flush", "compact", "compact_all", "reopen"])),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(step, min_size=4, max_size=12))
def test_behaves_like_a_dict(spark, steps):
    options = StoreOptions(partitions=1, style="tiered", fanout=2)
    s, model = Store.open(spark, scratch(spark, "model"), options), {}
    for op, *args in steps:
        if op == "put":
            s.put(*args)
            model[args[0].encode()] = args[1].encode()
        elif op == "delete":
            s.delete(*args)
            model.pop(args[0].encode(), None)
        elif op == "reopen":
            s.close()
            s = Store.open(spark, s.path)
        else:
            getattr(s, op)()
    assert pairs(s.scan()) == sorted(model.items())
    assert pairs(s.scan("a", "bz")) == sorted((k, v) for k, v in model.items() if b"a" <= k <= b"bz")


def test_manifest_survives_a_torn_temp_file(spark, store):
    store.put_df(frame(spark, [("a", "1")]))
    with open(os.path.join(store.manifest.folder, "00000000000000000009.json.x.tmp"), "w") as f:
        f.write("{")
    assert store.get("a") == b"1"


def test_a_large_batch_is_dealt_to_more_files_than_asked(spark, store):
    store.put_df(spark.range(1_000_000).selectExpr("format_string('key_%010d', id) as key", "repeat('v', 100) as value"), unique=True)
    (run,) = store.manifest.read().runs
    assert run.rows == 1_000_000 and store.files().count() == 3
    assert store.manifest.files.names(f"{store.manifest.files.root}/runs") == [run.path.rsplit("/", 1)[-1]]
    assert store.get("key_0000777777") == b"v" * 100


def test_many_asked_keys_are_sorted_once_whatever_the_runs(spark, store, monkeypatch):
    model = {}
    for n in range(3):
        rows = [(f"k{i:04d}", f"{n}:{i}") for i in range(n, 1500, n + 1)]
        store.put_df(frame(spark, rows))
        model |= dict(rows)
    store.delete_df(frame(spark, [("k0007",), ("k0008",)], "key string"))
    store.put("k0009", "new")
    model = {k: v for k, v in model.items() if k not in ("k0007", "k0008")} | {"k0009": "new"}
    asked = [f"k{i:04d}" for i in range(2000)] + ["k0003", "k0003", "k0007", None]
    keys = frame(spark, [(k,) for k in asked], "key string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.multi_get(keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        monkeypatch.setattr("keylog.operators.layout.TASK_BYTES", 32 << 10)
        got = store.multi_get(keys)
        n = got._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1:]
        assert len(n) == 2 and all(int(x.split(", ")[1].split(")")[0]) == 11 for x in n)  # 344 kB in parts of 32
        text = lambda x: None if x is None else bytes(x).decode()
        want = sorted(((k, k in model, model.get(k)) for k in asked), key=repr)
        assert sorted(((text(r.key), r.found, text(r.value)) for r in got.collect()), key=repr) == want
        assert sorted(((text(r.key), r.found) for r in store.contains(keys).collect()), key=repr) == [w[:2] for w in want]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_run_goes_down_many_levels_written_once(spark):
    s = Store.open(spark, scratch(spark, "test"), StoreOptions(partitions=2, base_bytes=64, multiplier=2))
    s.put_df(frame(spark, [(f"k{i:04d}", "v" * 20) for i in range(400)]))
    s.put_df(frame(spark, [(f"k{i:04d}", "w") for i in range(0, 400, 10)]))
    s.delete_df(frame(spark, [(f"k{i:04d}",) for i in range(0, 400, 7)], "key string"))
    want = [(f"k{i:04d}".encode(), b"w" if i % 10 == 0 else b"v" * 20) for i in range(400) if i % 7]
    s.compact()
    assert s.manifest.read().runs[0].level > 3
    s.compact_all()
    (run,) = s.manifest.read().runs
    assert (run.level, run.rows, run.n_tombstones) == (6, len(want), 0)
    assert len(s.manifest.files.names(f"{s.manifest.files.root}/runs")) == 4  # three batches and their merge
    assert len(s.vacuum()) == 3 and pairs(Store.open(spark, s.path).scan()) == want


def test_a_moved_run_keeps_what_the_merge_would(spark, store):
    store.delete_df(frame(spark, [("a",)], "key string"))
    assert store.compact_all().runs == []  # a tombstone with nothing to hide is not moved but dropped
    store.add_run(spark.createDataFrame([(b"a", b"1", False, 7), (b"a", b"2", False, 8)], store.ops().schema), 0)
    (run,) = store.compact_all().runs  # nor is a run with several versions of a key
    assert (run.rows, run.level) == (1, 6) and pairs(store.table()) == [(b"a", b"2")]

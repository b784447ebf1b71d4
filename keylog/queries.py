"""Queries over the key-value operators, each with the DuckDB SQL it must agree with.

F1: the events table as an op-log (user key, purchases delete). F2: the orders table as
three runs (all, an overwrite of every tenth, a delete of every seventh).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.functions import stats
from keylog.functions.bloom import BloomFilter
from keylog.operators import blocks, lookup, resolve
from keylog.operators.compaction import Leveled, Tiered, merge, pick_frame, replace_level, score_frame
from keylog.schema import as_text, ops
from keylog.sources import log as logs
from keylog.store import Store, StoreOptions
from keylog.streaming.ingest import ingest
from keylog.workspace import scratch


def events_log(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return events_ops(e)


def events_ops(e: DataFrame) -> DataFrame:
    value = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return ops(e, F.format_string("user:%08d", "user_id"), value, F.col("event_type") == "purchase", "event_id")


def orders_runs(spark: SparkSession, d: str) -> list[DataFrame]:
    o = spark.read.parquet(f"{d}/orders.parquet")
    key, n = F.format_string("order:%010d", "o_orderkey"), F.col("o_orderkey")
    return [
        ops(o, key, F.concat_ws("|", "o_orderstatus", "o_orderpriority"), seq=0),
        ops(o.where(n % 10 == 0), key, F.concat(F.lit("X|"), F.col("o_orderpriority")), seq=1),
        ops(o.where(n % 7 == 0), key, F.lit(None), True, 2),
    ]


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = orders_runs(spark, d)
    return a.unionByName(b).unionByName(c)


F1 = """f1 AS (SELECT printf('user:%08d', user_id) AS key, CASE WHEN event_type <> 'purchase' THEN event_type || ':' || event_id END AS value,
  event_type = 'purchase' AS is_delete, event_id AS seq FROM events)"""
F2 = """f2 AS (SELECT printf('order:%010d', o_orderkey) AS key, o_orderstatus || '|' || o_orderpriority AS value, false AS is_delete, 0 AS seq FROM orders
  UNION ALL SELECT printf('order:%010d', o_orderkey), 'X|' || o_orderpriority, false, 1 FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT printf('order:%010d', o_orderkey), NULL, true, 2 FROM orders WHERE o_orderkey % 7 = 0)"""


def _latest(name: str, source: str) -> str:
    return f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


L1 = f"WITH {F1}, {_latest('l', 'f1')}"
L2 = f"WITH {F2}, {_latest('l', 'f2')}"
LIVE1 = f"{L1} SELECT key, value FROM l WHERE NOT is_delete"
LIVE2 = f"{L2} SELECT key, value FROM l WHERE NOT is_delete"
LOW, HIGH = "user:00000010", "user:00000050"

#: A catalogue of levels: (level, run_id, bytes).
CATALOGUE = [(0, "a", 300 << 20), (1, "b", 1 << 30), (1, "c", 2 << 30), *((2, r, 1 << 30) for r in "defg")]
CATALOGUE_SQL = "c(level, run_id, bytes) AS (VALUES " + ", ".join(f"({lv}, '{r}', {n})" for lv, r, n in CATALOGUE) + ")"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "level int, run_id string, bytes long")


def _all_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all users, live or deleted, and as many that are absent."""
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return users.select(F.explode(F.array("user_id", F.col("user_id") + 50_000_000)).alias("id")).select(F.format_string("user:%08d", "id").cast("binary").alias("key"))


KEYS_SQL = "k AS (SELECT printf('user:%08d', unnest([user_id, user_id + 50000000])) AS key FROM (SELECT DISTINCT user_id FROM events))"


def _get(key: str) -> Callable:
    return lambda s, d: as_text(lookup.get(events_log(s, d), key))


def _get_sql(key: str) -> str:
    return f"{L1} SELECT '{key}' AS key, count(*) > 0 AS found, first(value) AS value FROM l WHERE key = '{key}' AND NOT is_delete"


# -- queries over a store on disk

_SMALL = StoreOptions(partitions=4, base_bytes=64 << 10, multiplier=4)


def _orders_store(s: SparkSession, d: str, options: StoreOptions = _SMALL) -> Store:
    store = Store.open(s, scratch(s, "store"), options)
    for run in orders_runs(s, d):
        store.put_df(run, unique=True)
    return store


def _store_live(s, d):
    return as_text(Store.open(s, _orders_store(s, d).path).table())


def _store_compacted(s, d):
    store = _orders_store(s, d)
    store.compact()
    store.compact_all()
    store.vacuum()
    return as_text(Store.open(s, store.path).table())


def _store_tiered(s, d):
    store = _orders_store(s, d, StoreOptions(partitions=4, style="tiered", fanout=2, auto_compact=True))
    return as_text(store.scan("order:0000000100", "order:0000000900"))


def _store_snapshot(s, d):
    store = _orders_store(s, d)
    return as_text(store.table(version=2))


def _store_multi_get(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.explode(F.array("o_orderkey", F.col("o_orderkey") + 10**9)).alias("id"))
    keys = o.select(F.format_string("order:%010d", "id").cast("binary").alias("key"))
    return as_text(_orders_store(s, d).multi_get(keys))


def _store_buffer(s, d):
    store = _orders_store(s, d)
    store.put("order:0000000001", "new")
    store.delete("order:0000000002")
    store.put("zzz", "")
    store.flush()
    return as_text(store.table())


def _store_runs(s, d):
    store = _orders_store(s, d)
    return as_text(store.runs()).select("level", "min_key", "max_key", "rows", "bytes", "min_seq", "max_seq", "n_tombstones")


def _stream_live(s, d):
    store = Store.open(s, scratch(s, "stream-store"), _SMALL)
    schema = s.read.parquet(f"{d}/events.parquet").schema
    # a pattern, since a stream refuses the path of a single file
    stream = events_ops(s.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))
    query = ingest(stream, store, scratch(s, "stream-checkpoint"), order="seq").trigger(availableNow=True).start()
    query.awaitTermination()
    return as_text(store.table())


def _store_levels(s, d):
    """Scores of both strategies and the level that each would merge, from a store's own manifest."""
    store = _orders_store(s, d)
    runs, n = store.manifest.read().runs, store.options.num_levels
    frame = store.runs().select("level", "run_id", "bytes")
    picks = [(style, strategy.pick(runs, n).output_level) for style, strategy in (("leveled", store.options.strategy()), ("tiered", Tiered(3)))]
    scores = score_frame(frame, store.options.strategy()).withColumn("style", F.lit("leveled")).unionByName(score_frame(frame, Tiered(3)).withColumn("style", F.lit("tiered")))
    return scores.join(s.createDataFrame(picks, "style string, to_level int"), "style")


def _store_level(s, d):
    """The runs of level 0, and those of a level that holds none."""
    state = _orders_store(s, d).manifest.read()
    return s.createDataFrame([(n, r.rows, r.bytes, r.n_tombstones) for n in (0, 1, 99) for r in state.level(n)], "level int, rows long, bytes long, n_tombstones long")


def _log_replay(s, d):
    """Export the op-log to the binary format, read it back, replay; all of it distributed."""
    return as_text(resolve.live(logs.replay(logs.decode_frame(logs.encode_frame(events_log(s, d))))))


def _log_dump(s, d):
    """The whole log as a table for people; its last record is cut off."""
    log = events_log(s, d).withColumn("value", F.concat("value", F.lit(b" and a long tail")))
    return logs.dump(logs.replay(logs.decode_frame(logs.torn(logs.encode_frame(log)))))


def _csv(s, d):
    """Samples through the CSV sink and back."""
    path = scratch(s, "samples")
    stats.write_samples(_samples(s, d), path)
    return stats.read_summary(s, path, "op string, latency_ns long").groupBy("op").agg(F.count("*").alias("n"), F.sum("latency_ns").alias("total_ns"))


def _bloom(s, d):
    log = events_log(s, d)
    f = BloomFilter.of(log, "key")
    return f.may_contain(log, "key").agg(F.count("*").alias("n"), F.count_if("may_contain").alias("n_maybe"))


def _crc(s, d):
    from keylog.functions.crc import crc32c_column

    return s.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (bytearray(b"\x00" * 32),)], "data binary").select(F.hex("data").alias("data"), crc32c_column("data").alias("crc"))


def _fixed(s, d):
    """24-byte keys and 128-byte values of the order ids: 160 bytes an entry, 26 to a block of 4 KiB."""
    o = s.read.parquet(f"{d}/orders.parquet")
    run = o.select(stats.make_key(F.col("o_orderkey")).cast("binary").alias("key"), stats.make_value(F.col("o_orderkey")).cast("binary").alias("value"))
    return as_text(blocks.block_index(run, 26), "first_key", "last_key")


def _samples(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "leveled").otherwise("tiered").alias("impl"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("event_id") % 4 + 1).cast("int")).alias("workload"),
        F.when(F.col("user_id") % 3 == 0, "write").otherwise("read").alias("op"), (F.col("event_id") * 7919 % 100003).alias("latency_ns"), F.lit(2.5).alias("elapsed_s"), (F.col("event_id") % 3).alias("run"),
    )


SAMPLES = """s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'leveled' ELSE 'tiered' END AS impl, substr('ABCD', CAST(event_id % 4 + 1 AS INT), 1) AS workload,
  CASE WHEN user_id % 3 = 0 THEN 'write' ELSE 'read' END AS op, event_id * 7919 % 100003 AS latency_ns, 2.5 AS elapsed_s, event_id % 3 AS run FROM events)"""


def _pct(op: str, p: int) -> str:
    return f"coalesce(list_sort(list(latency_ns / 1000.0) FILTER (op = '{op}'))[CAST(floor({p} / 100.0 * (count(*) FILTER (op = '{op}') - 1)) AS BIGINT) + 1], 0.0) AS {op}_p{p}"


def _multi_run(s, d):
    runs = _samples(s, d).groupBy("impl", "workload", "run").agg(F.floor(F.count("*") / 2.5).cast("long").alias("throughput"), F.avg(F.col("latency_ns") / 1000.0).alias("us"))
    return stats.average_runs(runs, ["throughput", "us"])


N_OPS, N_KEYS = 50_000, 100_000  #: operations of a workload and keys that they draw from


def _workloads(s, d):
    """The operations of every standard mix."""
    one = [stats.workload(s, N_OPS, N_KEYS, r).withColumn("mix", F.lit(n)) for n, r in stats.MIXES.items()]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


def _mix(s, d):
    return _workloads(s, d).groupBy("mix").agg(F.count_if(F.col("op") == "read").alias("reads"), F.count("*").alias("ops"), F.count_distinct("id").alias("keys"))


_DRAW = "CAST('0x' || substr(md5(i || ':{}'), 1, 8) AS BIGINT)"
WORKLOADS = "w AS (SELECT mix, i, CASE WHEN " + _DRAW.format(42) + " < r * 4294967296.0 THEN 'read' ELSE 'write' END AS op, " + _DRAW.format(43) + f" % {N_KEYS} AS id FROM range({N_OPS}) t(i), (VALUES " + ", ".join(f"('{n}', {r}::DOUBLE)" for n, r in stats.MIXES.items()) + ") m(mix, r))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kv_live": lambda s, d: as_text(resolve.live(events_log(s, d))),
    "kv_put_latest": lambda s, d: as_text(resolve.latest(events_log(s, d))),
    "kv_delete_absent": lambda s, d: as_text(resolve.live(events_log(s, d).unionByName(ops(s.range(1), F.lit("nobody"), F.lit(None), True, F.lit(10**9))))),
    "kv_get_hit": _get("user:00000003"),
    "kv_get_absent": _get("user:99999999"),
    "kv_get_deleted": lambda s, d: as_text(lookup.get(orders_log(s, d), "order:0000000007")),
    "kv_multi_get": lambda s, d: as_text(lookup.multi_get(events_log(s, d), _all_keys(s, d))),
    "kv_contains": lambda s, d: as_text(lookup.contains(events_log(s, d), _all_keys(s, d))),
    "kv_scan_all": lambda s, d: as_text(lookup.scan(orders_log(s, d))),
    "kv_scan_range": lambda s, d: as_text(lookup.scan(events_log(s, d), LOW, HIGH)),
    "kv_scan_bounds": lambda s, d: as_text(lookup.scan(orders_log(s, d), "order:0000000100", "order:0000000200")),
    "kv_scan_empty": lambda s, d: as_text(lookup.scan(events_log(s, d), HIGH, LOW)),
    "kv_scan_hides_deleted": lambda s, d: as_text(lookup.scan(orders_log(s, d), "order:0000000000", "order:0000000070")),
    "kv_newest_run_wins": lambda s, d: as_text(resolve.live(orders_log(s, d)).where("value like 'X|%'")),
    "kv_lower_bound": lambda s, d: as_text(lookup.lower_bound(orders_log(s, d), "order:0000000006x")),
    "kv_merge_all": lambda s, d: as_text(resolve.merge_all(*orders_runs(s, d))),
    "kv_size": lambda s, d: lookup.size(orders_log(s, d)),
    "kv_previous_value": lambda s, d: as_text(resolve.history(events_log(s, d))),
    "kv_memtable_bytes": lambda s, d: resolve.live_bytes(events_log(s, d)),
    "kv_running_bytes": lambda s, d: as_text(resolve.running_bytes(events_log(s, d))),
    "kv_block_index": _fixed,
    "kv_run_stats": lambda s, d: as_text(blocks.run_stats(orders_log(s, d), "seq").select("seq", "min_key", "max_key", "rows", "tombstones", "bytes")),
    "kv_score_leveled": lambda s, d: score_frame(catalogue(s), Leveled()),
    "kv_score_tiered": lambda s, d: score_frame(catalogue(s), Tiered()),
    "kv_pick_leveled": lambda s, d: pick_frame(catalogue(s), Leveled(), 4),
    "kv_pick_tiered": lambda s, d: pick_frame(catalogue(s), Tiered(), 4),
    "kv_get_level": lambda s, d: catalogue(s).where("level = 2"),
    "kv_compact_merge": lambda s, d: as_text(merge(orders_log(s, d), False)),
    "kv_compact_bottom": lambda s, d: as_text(merge(orders_log(s, d), True).select("key", "value")),
    "kv_replace_level": lambda s, d: replace_level(catalogue(s), catalogue(s).where("level = 0 or run_id = 'b'"), s.createDataFrame([(1, "n", 7)], "level int, run_id string, bytes long")),
    "kv_bloom_no_false_negative": _bloom,
    "kv_crc32c": _crc,
    "kv_store_live": _store_live,
    "kv_store_compacted": _store_compacted,
    "kv_store_tiered_scan": _store_tiered,
    "kv_store_snapshot": _store_snapshot,
    "kv_store_multi_get": _store_multi_get,
    "kv_store_buffer": _store_buffer,
    "kv_store_runs": _store_runs,
    "kv_store_levels": _store_levels,
    "kv_store_level": _store_level,
    "kv_stream_ingest": _stream_live,
    "wal_replay": _log_replay,
    "wal_dump": _log_dump,
    "bench_csv": _csv,
    "bench_percentile": lambda s, d: stats.percentile_frame(s.read.parquet(f"{d}/events.parquet"), ["event_type"], "value", [50.0, 90.0, 99.0]),
    "bench_percentile_exact": lambda s, d: stats.percentile_frame(s.read.parquet(f"{d}/events.parquet"), ["event_type"], "value", [99.0]).select("event_type", F.col("value").alias("p99")),
    "bench_summary": lambda s, d: stats.summary(_samples(s, d)),
    "bench_multi_run": _multi_run,
    "bench_workload_mix": _mix,
    "bench_workload": _workloads,
    "bench_population": lambda s, d: stats.population(s, 1000).select("id", "key", "value"),
}

ORACLE_SQL: dict[str, str] = {
    "kv_live": LIVE1,
    "kv_put_latest": f"{L1} SELECT key, value, is_delete, seq FROM l",
    "kv_delete_absent": LIVE1,
    "kv_get_hit": _get_sql("user:00000003"),
    "kv_get_absent": _get_sql("user:99999999"),
    "kv_get_deleted": f"{L2} SELECT 'order:0000000007' AS key, count(*) > 0 AS found, first(value) AS value FROM l WHERE key = 'order:0000000007' AND NOT is_delete",
    "kv_multi_get": f"{L1}, {KEYS_SQL} SELECT k.key, l.key IS NOT NULL AS found, l.value FROM k LEFT JOIN l ON k.key = l.key AND NOT l.is_delete",
    "kv_contains": f"{L1}, {KEYS_SQL} SELECT k.key, l.key IS NOT NULL AS found FROM k LEFT JOIN l ON k.key = l.key AND NOT l.is_delete",
    "kv_scan_all": f"{LIVE2} ORDER BY key",
    "kv_scan_range": f"{LIVE1} AND key BETWEEN '{LOW}' AND '{HIGH}' ORDER BY key",
    "kv_scan_bounds": f"{LIVE2} AND key BETWEEN 'order:0000000100' AND 'order:0000000200' ORDER BY key",
    "kv_scan_empty": f"{LIVE1} AND key BETWEEN '{HIGH}' AND '{LOW}'",
    "kv_scan_hides_deleted": f"{LIVE2} AND key BETWEEN 'order:0000000000' AND 'order:0000000070'",
    "kv_newest_run_wins": f"{LIVE2} AND value LIKE 'X|%'",
    "kv_lower_bound": f"{L2} SELECT key, value, is_delete, seq::BIGINT AS seq FROM l WHERE key >= 'order:0000000006x' ORDER BY key LIMIT 1",
    "kv_merge_all": f"WITH {F2} SELECT key, value, is_delete, seq::BIGINT AS seq FROM f2",
    "kv_size": f"WITH {F2} SELECT count(DISTINCT key) AS keys FROM f2",
    "kv_previous_value": f"WITH {F1} SELECT key, value, is_delete, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version, lag(value) OVER (PARTITION BY key ORDER BY seq) AS previous FROM f1",
    "kv_memtable_bytes": f"{L1} SELECT sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes, count(*) AS entries FROM l",
    "kv_running_bytes": f"WITH {F1}, z AS (SELECT key, seq, coalesce(strlen(value), 0) - coalesce(lag(coalesce(strlen(value), 0)) OVER (PARTITION BY key ORDER BY seq), -strlen(key)) AS delta FROM f1) SELECT key, seq, delta, sum(delta) OVER (ORDER BY seq)::BIGINT AS bytes FROM z",
    "kv_block_index": "SELECT rn // 26 AS block, min(key) AS first_key, max(key) AS last_key, count(*) AS entries, count(*) * 160 AS bytes FROM (SELECT printf('key_%020d', o_orderkey) AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY 1",
    "kv_run_stats": f"WITH {F2} SELECT seq::BIGINT AS seq, min(key) AS min_key, max(key) AS max_key, count(*) AS rows, count(*) FILTER (is_delete) AS tombstones, sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes FROM f2 GROUP BY seq",
    "kv_score_leveled": f"WITH {CATALOGUE_SQL} SELECT level, sum(bytes) / (268435456.0 * pow(10, level)) AS score FROM c GROUP BY level",
    "kv_score_tiered": f"WITH {CATALOGUE_SQL} SELECT level, count(*) / 4.0 AS score FROM c GROUP BY level",
    "kv_pick_leveled": f"WITH {CATALOGUE_SQL}, s AS (SELECT level, sum(bytes) / (268435456.0 * pow(10, level)) AS score FROM c GROUP BY level) SELECT min(level) AS from_level, min(level) + 1 AS to_level FROM s WHERE score > 1 AND level < 3 HAVING min(level) IS NOT NULL",
    "kv_pick_tiered": f"WITH {CATALOGUE_SQL}, s AS (SELECT level, count(*) AS n FROM c GROUP BY level) SELECT min(level) AS from_level, min(level) + 1 AS to_level FROM s WHERE n >= 4 AND level < 3 HAVING min(level) IS NOT NULL",
    "kv_get_level": f"WITH {CATALOGUE_SQL} SELECT * FROM c WHERE level = 2",
    "kv_compact_merge": f"{L2} SELECT key, value, is_delete, seq::BIGINT AS seq FROM l",
    "kv_compact_bottom": LIVE2,
    "kv_replace_level": f"WITH {CATALOGUE_SQL} SELECT * FROM c WHERE NOT (level = 0 OR run_id = 'b') UNION ALL SELECT 1, 'n', 7",
    "kv_bloom_no_false_negative": "SELECT count(*) AS n, count(*) AS n_maybe FROM events",
    "kv_crc32c": "SELECT * FROM (VALUES ('313233343536373839', 3808858755::BIGINT), ('', 0), (repeat('00', 32), 2324772522)) v(data, crc)",
    "kv_store_live": LIVE2,
    "kv_store_compacted": LIVE2,
    "kv_store_tiered_scan": f"{LIVE2} AND key BETWEEN 'order:0000000100' AND 'order:0000000900'",
    "kv_store_snapshot": f"WITH {F2}, {_latest('l', '(SELECT * FROM f2 WHERE seq < 2)')} SELECT key, value FROM l",
    "kv_store_multi_get": f"{L2}, k AS (SELECT printf('order:%010d', unnest([o_orderkey, o_orderkey + 1000000000])) AS key FROM orders) SELECT k.key, l.key IS NOT NULL AS found, l.value FROM k LEFT JOIN l ON k.key = l.key AND NOT l.is_delete",
    "kv_store_buffer": f"{LIVE2} AND key NOT IN ('order:0000000001', 'order:0000000002') UNION ALL VALUES ('order:0000000001', 'new'), ('zzz', '')",
    "kv_store_runs": f"WITH {F2} SELECT 0 AS level, min(key) AS min_key, max(key) AS max_key, count(*) AS rows, sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes, (seq + 1)::BIGINT AS min_seq, (seq + 1)::BIGINT AS max_seq, count(*) FILTER (is_delete) AS n_tombstones FROM f2 GROUP BY seq",
    "kv_store_levels": f"WITH {F2}, t AS (SELECT sum(strlen(key) + coalesce(strlen(value), 0)) AS bytes FROM f2), x AS (SELECT 'leveled' AS style, bytes / 65536.0 AS score, bytes > 65536 AS due FROM t UNION ALL SELECT 'tiered', 3 / 3.0, true) SELECT style, 0 AS level, score::DOUBLE AS score, CASE WHEN due THEN 1 ELSE -1 END AS to_level FROM x",
    "kv_store_level": f"WITH {F2} SELECT 0 AS level, count(*) AS rows, sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes, count(*) FILTER (is_delete) AS n_tombstones FROM f2 GROUP BY seq",
    "kv_stream_ingest": LIVE1,
    "wal_replay": LIVE1,
    "wal_dump": f"WITH {F1}, z AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS idx, count(*) OVER () AS n, * FROM f1) SELECT idx, CASE WHEN is_delete THEN 'DELETE' ELSE 'PUT' END AS op, key, CASE WHEN is_delete THEN NULL ELSE substr(value || ' and a long tail', 1, 20) || '...' END AS value FROM z WHERE idx < n - 1",
    "bench_csv": f"WITH {SAMPLES} SELECT op, count(*) AS n, sum(latency_ns)::BIGINT AS total_ns FROM s GROUP BY op",
    "bench_percentile": "WITH v AS (SELECT event_type, list_sort(list(value)) AS x FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, p, x[CAST(floor(p / 100.0 * (len(x) - 1)) AS BIGINT) + 1] AS value FROM v, (VALUES (50.0::DOUBLE), (90.0), (99.0)) t(p)",
    "bench_percentile_exact": "SELECT event_type, list_sort(list(value))[CAST(floor(0.99 * (count(value) - 1)) AS BIGINT) + 1] AS p99 FROM events GROUP BY 1",
    "bench_summary": f"WITH {SAMPLES} SELECT impl, workload, floor(count(*) / 2.5)::BIGINT AS throughput, {', '.join(_pct(o, p) for o in ('read', 'write') for p in (50, 99))} FROM s GROUP BY impl, workload",
    "bench_multi_run": f"WITH {SAMPLES}, r AS (SELECT impl, workload, run, floor(count(*) / 2.5)::BIGINT AS throughput, avg(latency_ns / 1000.0) AS us FROM s GROUP BY ALL) SELECT impl, workload, round_even(avg(throughput), 0) AS throughput_mean, round_even(stddev_samp(throughput), 0) AS throughput_stdev, round_even(avg(us), 2) AS us_mean, round_even(stddev_samp(us), 2) AS us_stdev FROM r GROUP BY ALL",
    "bench_workload_mix": f"WITH {WORKLOADS} SELECT mix, count(*) FILTER (op = 'read') AS reads, count(*) AS ops, count(DISTINCT id) AS keys FROM w GROUP BY mix",
    "bench_workload": f"WITH {WORKLOADS} SELECT mix, i, op, id FROM w",
    "bench_population": "SELECT i AS id, printf('key_%020d', i) AS key, rpad(CAST(i AS VARCHAR), 128, 'v') AS value FROM range(1000) t(i)",
}

import duckdb
import pytest
from pyspark.sql import functions as F

from keylog.functions import stats
from keylog.operators import blocks, resolve
from keylog.operators.order import running_total
from keylog.schema import ops


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_block_index_of_a_run_in_many_partitions(spark, adaptive):
    n = 1_000_000
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ids = spark.range(0, n, 1, 8).select(stats.make_key(F.col("id")).cast("binary").alias("key"), stats.make_value(F.col("id")).cast("binary").alias("value"))
        out = blocks.block_index(ids.repartition(8), 26).toArrow()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = duckdb.sql(f"SELECT i // 26 AS block, encode(printf('key_%020d', min(i))) AS first_key, encode(printf('key_%020d', max(i))) AS last_key, count(*) AS entries, count(*) * 160 AS bytes FROM range({n}) t(i) GROUP BY 1")
    assert out.num_rows == -(-n // 26)
    assert duckdb.sql("SELECT block, first_key, last_key, entries, bytes FROM out EXCEPT SELECT * FROM want").fetchall() == []


def test_running_total_of_groups_nulls_and_ties(spark):
    rows = [(g, i % 7, i) for i in range(200) for g in ("a", None, "b") if g != "b" or i < 3]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(5)
    got = sorted(((r.g, r.o, r.t) for r in running_total(df, ["g"], ["o"], F.lit(1).cast("long"), "t").collect()), key=repr)
    for g in ("a", None, "b"):
        mine = [(o, t) for x, o, t in got if x == g]
        assert sorted(t for _, t in mine) == list(range(1, len(mine) + 1)) and [o for o, _ in sorted(mine, key=lambda x: x[1])] == sorted(o for o, _ in mine)
    assert running_total(df.limit(0), ["g"], ["o"], F.col("v"), "t").count() == 0


def test_running_bytes_over_many_partitions(spark):
    log = ops(spark.range(5000).withColumn("k", F.col("id") % 70), F.col("k").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 13).cast("int")), F.col("id") % 11 == 0, "id").repartition(6)
    held, size, want = {}, 0, []
    for i in range(5000):
        k, v = str(i % 70), 0 if i % 11 == 0 else i % 13
        size += v - held.get(k, -len(k))
        held[k] = v
        want.append((i, size))
    assert sorted((r.seq, r.bytes) for r in resolve.running_bytes(log).collect()) == want


def test_half_even(spark):
    runs = spark.createDataFrame([("x", "A", 1, 0.125), ("x", "A", 2, 0.125)], "impl string, workload string, throughput long, us double")
    r = stats.average_runs(runs, ["throughput", "us"]).collect()[0]
    assert r.throughput_mean == 2 and r.us_mean == 0.12 and r.us_stdev == 0

"""Statistics over benchmark samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.operators.order import running_total


def percentile_frame(df: DataFrame, group: list[str], column: str, ps: list[float]) -> DataFrame:
    """(group.., p, value): the sample at index floor(p / 100 * (n - 1)) of the sorted samples of each group.

    Equal samples are counted before the shuffle, and ranks are running totals dealt out by value, so a group may be of any size.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, group, [column], F.col("_n"), "_hi")
    all_ = ranked.groupBy(*(F.col(c).alias(f"_g_{c}") for c in group)).agg(F.max("_hi").alias("_all"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_g_{c}")), group, F.lit(True))
    at = F.floor(F.col("p") / 100.0 * (F.col("_all") - 1))
    out = ranked.join(all_, same).withColumn("p", F.explode(F.array(*map(F.lit, [float(p) for p in ps]))))
    return out.where((at < F.col("_hi")) & (at >= F.col("_hi") - F.col("_n"))).select(*group, "p", F.col(column).alias("value"))


def summary(samples: DataFrame) -> DataFrame:
    """Per (impl, workload): throughput, and p50 and p99 of reads and writes in microseconds, 0 without samples.

    samples: (impl, workload, op, latency_ns, elapsed_s).
    """
    by = ["impl", "workload"]
    whole = samples.groupBy(*by).agg(F.floor(F.count("*") / F.max("elapsed_s")).cast("long").alias("throughput"))
    found = percentile_frame(samples.select(*by, "op", (F.col("latency_ns") / 1000.0).alias("us")), [*by, "op"], "us", [50.0, 99.0])
    wide = found.groupBy(*by).agg(*(F.max(F.when((F.col("op") == op) & (F.col("p") == p), F.col("value"))).alias(f"{op}_p{p}") for op in ("read", "write") for p in (50, 99)))
    picked = (F.coalesce(f"{op}_p{p}", F.lit(0.0)).alias(f"{op}_p{p}") for op in ("read", "write") for p in (50, 99))
    return whole.join(wide, by, "left").select(*by, "throughput", *picked)


def average_runs(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per (impl, workload): mean and sample deviation of each metric; throughput whole, others to two digits, half to even."""
    out = []
    for m in metrics:
        digits = 0 if m == "throughput" else 2
        out += [F.bround(F.avg(m), digits).alias(f"{m}_mean"), F.bround(F.coalesce(F.stddev_samp(m), F.lit(0.0)), digits).alias(f"{m}_stdev")]
    return runs.groupBy("impl", "workload").agg(*out)


#: Share of reads of the standard mixes.
MIXES = {"A": 0.5, "B": 0.95, "C": 1.0, "D": 0.05}


def make_key(id_: Column) -> Column:
    return F.format_string("key_%020d", id_)


def make_value(id_: Column, length: int = 128) -> Column:
    return F.rpad(id_.cast("string"), length, "v")


def population(spark: SparkSession, n: int) -> DataFrame:
    """(id, key, value) for ids 0 .. n - 1."""
    return spark.range(n).select("id", make_key(F.col("id")).alias("key"), make_value(F.col("id")).alias("value"))


def workload(spark: SparkSession, n_ops: int, n_keys: int, read_ratio: float, seed: int = 42) -> DataFrame:
    """(i, op, id): each operation's coin and key come from a hash of its number and the seed, so they never depend on partitioning."""

    def draw(s: int) -> Column:
        text = F.concat_ws(":", F.col("id").cast("string"), F.lit(str(s)))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")

    op = F.when(draw(seed) < F.lit(read_ratio * 2.0**32), "read").otherwise("write")
    return spark.range(n_ops).select(F.col("id").alias("i"), op.alias("op"), (draw(seed + 1) % n_keys).alias("id"))


def write_samples(samples: DataFrame, path: str) -> None:
    samples.select("op", "latency_ns").write.mode("overwrite").option("header", True).csv(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)

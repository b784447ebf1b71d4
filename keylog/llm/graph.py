"""Connected components of a table of links, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylog.llm.common import drop_saved, saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); component: the smallest node reachable.

    Rounds of hooking and jumping: every node and its parent take the least
    grandparent found among the node's neighbours, and every node its own
    grandparent, so trees of labels hook onto smaller ones and halve in depth at once
    and the number of rounds grows with the logarithm of the longest path. Minima are
    partial aggregates, joins are splittable, each round is written to the shared
    folder, and only one number, whether anything changed, reaches the driver.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")), "labels")
    for _ in range(most_rounds):
        up = labels.join(labels.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        near = both.join(up.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("near"))
        all_ = up.join(near, up["node"] == near["a"]).select("node", "parent", F.least("grand", "near").alias("low"))
        offers = all_.select(F.explode(F.array(F.struct("node", "low", F.col("parent").alias("was")), F.struct(F.col("parent").alias("node"), "low", F.lit(None).cast("long").alias("was")))).alias("x")).select("x.*")
        new = offers.groupBy("node").agg(F.min("low").alias("parent"), F.max("was").alias("was"))
        done = saved(new.select("node", F.least("parent", "was").alias("parent"), (F.col("parent") < F.col("was")).alias("changed")), "labels")
        drop_saved(labels)
        labels = done.select("node", "parent")
        if not done.where("changed").limit(1).count():
            drop_saved(both)
            return labels.withColumnRenamed("parent", "component")
    raise RuntimeError("components did not settle")

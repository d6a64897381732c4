"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.plans.lineage import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(node, component)``: every node of ``edges`` with the least node it is connected to.

    Every node points to a parent.  In a round a node takes the least
    grandparent among its neighbours as its own parent and as its parent's
    parent, and its grandparent as its parent; so whole trees are hooked at once
    and their height is halved, and few rounds are needed whatever the paths.
    Minima are aggregated map-side and lineage is cut once a round; links never
    reach the driver.  Null ends, loops and repeated edges do no harm.
    """
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut_lineage(clean.union(clean.select("b", "a")).distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("f"))
    labels = _with_grandparents(first)
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        state = cut_lineage(labels.join(near, "node"))
        # the least grandparent around every node is its own: both ends of every edge agree
        if state.where("m <> g or f <> g").limit(1).count() == 0:
            return state.select("node", F.col("g").alias("component"))
        hooked = state.select("node", F.least("f", "g", "m").alias("f")).unionByName(state.select(F.col("f").alias("node"), F.col("m").alias("f")))
        labels = _with_grandparents(hooked.groupBy("node").agg(F.min("f").alias("f")))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _with_grandparents(parents: DataFrame) -> DataFrame:
    return parents.join(parents.select(F.col("node").alias("f"), F.col("f").alias("g")), "f")

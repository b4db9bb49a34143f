"""Connected components of an edge table, by rounds of joins (no edge ever reaches the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postloom.session import materialize


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node of its component.

    Alternating star rounds: each node's larger neighbours are tied to its smallest one, then each
    node to the smallest of its own, until nothing changes; the number of rounds grows with the
    logarithm of the longest path.  Each round is written to the shared checkpoint folder, so its
    lineage is one round long; the driver sees two counts a round, taken while it is written.  With
    ``rounds`` the labels are those after so many: equal labels are connected, but a component may
    still have several."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, done, before = materialize(now, "edges"), 0, None
    while rounds is None or done < rounds:
        ends = both(now)
        low = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour or itself
        large = ends.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        # small star: the smaller neighbours of a node, and the node, are tied to the smallest of them
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        seen = Observation()
        now = materialize(small.where("a <> b").distinct().observe(seen, F.count("*").alias("n"), F.sum(
            F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("hash")), "edges")
        done, state = done + 1, seen.get
        if state == before:
            break
        before = state
    leaves = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    found = leaves.union(leaves.select(F.col("label").alias("node"), "label").distinct())
    return found if rounds is None else found.groupBy("node").agg(F.min("label").alias("label"))

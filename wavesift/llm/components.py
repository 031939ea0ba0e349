"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavesift.llm.shared import forget, settle


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours go to the smallest node it sees; and the table of these smallest nodes."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    met = both.where("b > a").join(least, "a")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours go to the smallest of those; and the table of these smallest nodes."""
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    met = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.union(least.select("a", F.col("m").alias("b"))), least


def connect(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b); root is the smallest node of the component.

    The number of rounds follows the logarithm of the longest path. A node may have any number of neighbours: their
    minimum is written first, so that the join that returns it is between two plain exchanges, which Spark splits
    where one key is large. Each round's edges are written to the shared
    folder and the round before is deleted; only their count and a checksum come to the driver. Repeated edges
    and edges from a node to itself are allowed; edges with a null end are ignored.
    """
    held = settle(edges.where("a is not null and b is not null and a != b").distinct(), "edges")
    before = None
    while True:
        mark = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        met, seen = _large(held)
        larger = settle(met, "large")
        met, below = _small(larger)
        again = settle(met.where("a != b").distinct(), "edges")
        for done in (held, seen, larger, below):
            forget(done)
        held = again
    pairs = held.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(held.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

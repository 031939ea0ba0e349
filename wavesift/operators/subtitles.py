"""Intervals of text against points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that one bin of an interval join spans.
BIN = 600


def covered(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: float = BIN) -> DataFrame:
    """Points joined with the spans of their key with start <= at < end, by equal bins of time, so that only
    neighbours in time meet. A span is in as many bins as it reaches over; a point is in one."""
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    met = points.withColumn("bin", F.floor(F.col(at) / width)).join(binned, [key, "bin"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bin")


def touched(spans: DataFrame, points: DataFrame, key: str, at: str, start: str, end: str, width: float = BIN) -> DataFrame:
    """Spans with a point strictly inside, once they are widened to a second around their middle."""
    mid = (F.col(start) + F.col(end)) / 2
    short = F.col(end) - F.col(start) < 1
    wide = spans.withColumns({"lo": F.when(short, mid - 0.5).otherwise(F.col(start)), "hi": F.when(short, mid + 0.5).otherwise(F.col(end))})
    binned = wide.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    p = points.select(F.col(key), F.col(at).alias("p_at"), F.floor(F.col(at) / width).alias("bin"))
    met = binned.join(p, (binned[key] == p[key]) & (binned["bin"] == p["bin"]) & (p["p_at"] > binned["lo"]) & (p["p_at"] < binned["hi"]), "left_semi")
    return met.select(*spans.columns).distinct()


def interleaved(points: DataFrame, spans: DataFrame, key: str, order: str, at: str, start: str, end: str) -> DataFrame:
    """key, place, kind, id: points in time with each span, in file order, after the points up to its middle."""
    mid = (F.col(start) + F.col(end)) / 2
    reach = F.max(mid).over(Window.partitionBy(key).orderBy(order))
    s = spans.select(key, reach.alias("t"), F.lit("span").alias("kind"), F.col(order).alias("id"))
    p = points.select(key, F.col(at).alias("t"), F.lit("point").alias("kind"), F.col("id"))
    by = Window.partitionBy(key).orderBy("t", "kind", "id")
    return p.unionByName(s).select(key, (F.row_number().over(by) - 1).cast("long").alias("place"), "kind", "id")

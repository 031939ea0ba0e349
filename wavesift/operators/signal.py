"""Wavelet bands, peaks and segments of sequences, as DataFrame operations and as kernels over a sequence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavesift.functions import signal_kernels as k
from wavesift.operators.walk import each_sequence


def _seq():
    return Window.partitionBy("seq_id")


def level(n: str = "n", taps: int = 8, drift: int = 3) -> F.Column:
    c = F.col(n)
    fit = F.least(F.floor(F.log2(c)) - drift, F.floor(F.log2(c / F.lit(float(taps - 1)))))
    return F.when(c <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), fit)).cast("long")


def min_distance(n: str = "n", ratio: float = 0.02, least: int = 5) -> F.Column:
    return F.greatest(F.lit(least), F.floor(F.col(n) * ratio)).cast("long")


def one_level(rows: DataFrame, high: bool, wavelet: str = "db4") -> DataFrame:
    """Rows (seq_id, pos, coef): the first level's detail or approximation. Each row is sent to the coefficients
    that use it: a tap each, reflected at the borders, repeatedly where a sequence is shorter than the filter."""
    low, detail = k.filters(wavelet)
    f, taps = (detail if high else low)[::-1], len(low)
    held = rows.withColumn("n", F.count("*").over(_seq()))
    turns = F.ceil(F.lit(float(taps)) / F.col("n"))
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda t: F.array(2 * F.col("n") * t + F.col("idx"), 2 * F.col("n") * t - 1 - F.col("idx"))))
    near = F.filter(places, lambda at: (at >= 2 - taps) & (at <= F.col("n") + taps - 2))
    each = held.select("seq_id", "score", "n", F.explode(near).alias("at"))
    spread = each.select("seq_id", "score", "n", "at", F.posexplode(F.array(*[F.lit(float(x)) for x in f])).alias("j", "tap"))
    hit = spread.where((F.col("at") + F.col("j") - 1) % 2 == 0).withColumn("pos", F.floor((F.col("at") + F.col("j") - 1) / 2))
    hit = hit.where((F.col("pos") >= 0) & (F.col("pos") < F.floor((F.col("n") + taps - 1) / 2)))
    return hit.groupBy("seq_id", "pos").agg(F.sum(F.col("tap") * F.col("score")).alias("coef"))


def band(rows: DataFrame, wavelet: str = "db4", drift: int = 3) -> DataFrame:
    """Rows (seq_id, idx, detail): each sequence's coarsest band, by a kernel over the sequence."""
    taps = len(k.LOW_PASS[wavelet])

    def each(own):
        x = own["score"].astype(float)
        return {"idx": own["idx"], "detail": k.coarsest_band(x, k.level_of(len(x), taps, drift), wavelet)}

    return each_sequence(rows, ["score"], each, "idx long, detail double")


def thresholds(rows: DataFrame, value: str, height: float = 0.5, share: float = 0.05) -> DataFrame:
    v = F.abs(F.col(value))
    return rows.groupBy("seq_id").agg((F.avg(v) + height * F.stddev_pop(v)).alias("height"), (share * (F.max(v) - F.min(v))).alias("prominence"))


def local_maxima(rows: DataFrame, value: str) -> DataFrame:
    """Rows (seq_id, idx, v) of local maxima; a flat top counts once, at its middle rounded down."""
    by = _seq().orderBy("idx")
    step = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = rows.select("seq_id", "idx", F.col(value).alias("v"), step.alias("new")).withColumn("run", F.sum("new").over(by))
    tops = runs.groupBy("seq_id", "run").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.first("v").alias("v"))
    next_ = _seq().orderBy("run")
    tops = tops.withColumns({"before": F.lag("v").over(next_), "after": F.lead("v").over(next_)})
    return tops.where((F.col("v") > F.col("before")) & (F.col("v") > F.col("after"))).select("seq_id", F.floor((F.col("a") + F.col("b")) / 2).alias("idx"), "v")


def high_maxima(rows: DataFrame, value: str, height: float = 0.5) -> DataFrame:
    found = local_maxima(rows, value)
    return found.join(thresholds(rows, value, height), "seq_id").where(F.col("v") >= F.col("height")).select("seq_id", "idx", "v")


def spaced(found: DataFrame, distance: int) -> DataFrame:
    """Maxima that stay when the highest removes its neighbours nearer than distance, and so on, by a kernel."""

    def each(own):
        kept = k.spaced(own["v"].astype(float), own["idx"], distance)
        return {"idx": own["idx"][kept], "v": own["v"][kept]}

    return each_sequence(found, ["v"], each, "idx long, v double")


def prominences(rows: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """seq_id, idx and prominence of each maximum, from the signal on both sides up to a higher point, by a kernel."""
    marks = found.select("seq_id", "idx").distinct().withColumn("own", F.lit(True))
    marked = rows.select("seq_id", "idx", F.col(value).alias("v")).join(marks, ["seq_id", "idx"], "left").withColumn("own", F.coalesce("own", F.lit(False)))

    def each(own):
        at = np.flatnonzero(own["own"].astype(bool))
        v = own["v"].astype(float)
        return {"idx": own["idx"][at], "prominence": np.array([k.prominence(v, p) for p in at.tolist()], float)}

    return each_sequence(marked, ["v", "own"], each, "idx long, prominence double")


def peaks(rows: DataFrame, value: str, settings: k.Settings = k.Settings()) -> DataFrame:
    """seq_id and idx of each sequence's peaks of |value|: high enough, then far enough apart, then prominent enough."""

    def each(own):
        v = own["v"].astype(float)
        distance = k.distance_of(len(v), settings.distance_ratio, settings.distance_least)
        return {"idx": own["idx"][k.peaks(v, distance, settings.height, settings.prominence)]}

    return each_sequence(rows.withColumn("v", F.col(value)), ["v"], each, "idx long")


def segmented(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with seg, the ordinal of the segment that the boundaries found cut."""
    marks = found.select("seq_id", "idx").distinct().withColumn("cut", F.lit(1))
    return rows.join(marks, ["seq_id", "idx"], "left").withColumn("seg", F.sum(F.coalesce("cut", F.lit(0))).over(_seq().orderBy("idx"))).drop("cut")


def segments(rows: DataFrame, found: DataFrame) -> DataFrame:
    """seq_id, seg, start, end (exclusive)."""
    return segmented(rows, found).groupBy("seq_id", "seg").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))

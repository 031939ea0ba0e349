"""Importance of segments and the budget that each gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavesift.functions.signal_kernels import Settings

def _seq():
    return Window.partitionBy("seq_id")



def importance(rows: DataFrame, weights=Settings.weights) -> DataFrame:
    """seq_id, seg, importance from rows with seg."""
    whole = rows.groupBy("seq_id").agg(F.count("*").alias("n"), F.var_pop("score").alias("spread"))
    own = rows.groupBy("seq_id", "seg").agg(F.count("*").alias("len"), F.avg("score").alias("mean"), F.max("score").alias("most"), F.var_pop("score").alias("var"))
    d, m, x, v = weights
    value = d * F.col("len") / F.col("n") + m * F.col("mean") + x * F.col("most") + v * F.col("var") / (F.col("spread") + 1e-8)
    return own.join(whole, "seq_id").select("seq_id", "seg", value.alias("importance"))


def strong(values: DataFrame, strictness: float = Settings.strictness, least: float = Settings.least_importance) -> DataFrame:
    """Segments that are kept: all of three or fewer, else those at or above the threshold, or all if none is."""
    cut = F.greatest(F.lit(least), F.avg("importance").over(_seq()) - strictness * F.stddev_pop("importance").over(_seq()))
    marked = values.withColumn("ok", (F.count("*").over(_seq()) <= 3) | (F.col("importance") >= cut))
    return marked.withColumn("any", F.max("ok").over(_seq())).where(F.col("ok") | ~F.col("any")).select("seq_id", "seg", "importance")


def softmax(values: DataFrame, temperature: float = Settings.temperature) -> DataFrame:
    z = F.col("importance") / max(temperature, 1e-8)
    e = values.withColumn("e", F.exp(z - F.max(z).over(_seq())))
    return e.withColumn("weight", F.col("e") / F.sum("e").over(_seq())).drop("e")


def allocate(values: DataFrame, budget: int) -> DataFrame:
    """seq_id, seg, n_alloc: largest remainders; of equal ones the later segment."""
    shares = softmax(values).withColumn("exact", F.col("weight") * budget).withColumn("whole", F.floor("exact"))
    order = _seq().orderBy(F.desc(F.col("exact") - F.col("whole")), F.desc("seg"))
    ranked = shares.withColumns({"rank": F.row_number().over(order), "left": budget - F.sum("whole").over(_seq())})
    return ranked.select("seq_id", "seg", (F.col("whole") + (F.col("rank") <= F.col("left")).cast("long")).alias("n_alloc"))

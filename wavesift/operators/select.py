"""Choice of items: anchors, greedy relevance against likeness, fallbacks, and the way back to original places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavesift.functions import signal_kernels as k
from wavesift.operators.frames import linspace
from wavesift.operators.walk import each_sequence


def _seq():
    return Window.partitionBy("seq_id")


def anchors(rows: DataFrame) -> DataFrame:
    """The first best item of each segment."""
    by = Window.partitionBy("seq_id", "seg").orderBy(F.desc("score"), "idx")
    return rows.withColumn("r", F.row_number().over(by)).where("r = 1").select("seq_id", "seg", "idx", "score")


def trimmed(rows: DataFrame, budget: int) -> DataFrame:
    by = _seq().orderBy(F.desc("score"), "idx")
    return rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= budget).select("seq_id", "idx")


def hybrid(rows: DataFrame, budget: int) -> DataFrame:
    """Half of the budget spread evenly over each sequence, the rest its best other items; of equals the later."""
    counted = rows.withColumn("n", F.count("*").over(_seq()))
    marked = counted.withColumn("even", F.array_contains(linspace(F.col("n"), budget // 2), F.col("idx"))) if budget // 2 else counted.withColumn("even", F.lit(False))
    by = Window.partitionBy("seq_id", "even").orderBy(F.desc("score"), F.desc("idx"))
    ranked = marked.withColumn("r", F.row_number().over(by))
    return ranked.where(F.col("even") | (F.col("r") <= budget - budget // 2)).select("seq_id", "idx", "orig_idx")


def greedy(rows: DataFrame, budget: int, balance: float = 0.5, vectors: bool = False) -> DataFrame:
    """seq_id, rank, idx: each sequence as one segment, in order of choice. rows may have a vector column; a sequence
    that lacks a vector is chosen from by time."""

    def each(own):
        x = own["score"].astype(float)
        held = own["vector"] if vectors else None
        chosen = k.Greedy(x, balance, None if held is None else held.astype(float)).segment(0, len(x), budget)
        return {"rank": np.arange(len(chosen)), "idx": own["idx"][chosen]}

    return each_sequence(rows, ["score"] + ["vector"] * vectors, each, "rank long, idx long")


def filled(rows: DataFrame, chosen: DataFrame, budget: int, balance: float = 0.5) -> DataFrame:
    """Chosen items (seq_id, idx) of each sequence brought to the budget."""
    marked = rows.join(chosen.select("seq_id", "idx").distinct().withColumn("own", F.lit(True)), ["seq_id", "idx"], "left").withColumn("own", F.coalesce("own", F.lit(False)))

    def each(own):
        return {"idx": own["idx"][k.Greedy(own["score"].astype(float), balance).fill(np.flatnonzero(own["own"].astype(bool)).tolist(), budget)]}

    return each_sequence(marked, ["score", "own"], each, "idx long")


def to_original(chosen: Column, original: Column, budget: int) -> Column:
    """Original places of chosen sampled places: those out of range are dropped; if fewer than the budget are
    left, evenly spread places are merged in, the first budget taken, and the last repeated."""
    n = F.size(original)
    places = F.array_sort(F.array_distinct(F.transform(F.filter(chosen, lambda i: (i >= 0) & (i < n)), lambda i: F.get(original, i.cast("int")))))
    spread = F.transform(linspace(n, budget), lambda i: F.get(original, i.cast("int")))
    merged = F.slice(F.array_sort(F.array_union(places, spread)), 1, budget)
    padded = F.concat(merged, F.array_repeat(F.element_at(merged, -1), budget - F.size(merged)))
    full = F.when(F.size(places) >= budget, F.slice(places, 1, budget)).otherwise(padded)
    return F.when(n > 0, full).otherwise(F.sequence(F.lit(0), F.lit(budget - 1)).cast(original_type))


original_type = "array<bigint>"


def keyframes(rows: DataFrame, settings: k.Settings = k.Settings(), vectors: bool = False) -> DataFrame:
    """seq_id, idx, orig_idx of the selected items: bands, peaks, segments, budget and greedy choice in one kernel,
    so that each sequence is shuffled once."""

    def each(own):
        held = own["vector"] if vectors else None
        chosen = k.select(own["score"].astype(float), settings, None if held is None else held.astype(float))
        return {"idx": own["idx"][chosen], "orig_idx": own["orig_idx"][chosen]}

    return each_sequence(rows, ["orig_idx", "score"] + ["vector"] * vectors, each, "idx long, orig_idx long")

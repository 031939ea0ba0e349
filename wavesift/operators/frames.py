"""Sequences as rows (seq_id, idx, orig_idx, score), samplers, slices and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.session import table


def sequences(events: DataFrame) -> DataFrame:
    """Events of each user in order of time as a scored sequence; scores are scaled to 0 .. 1, 0.5 if all are equal."""
    own = Window.partitionBy("user_id")
    low, high = F.min("value").over(own), F.max("value").over(own)
    scaled = F.when(high == low, F.lit(0.5)).otherwise(F.try_divide(F.col("value") - low, high - low))
    place = F.row_number().over(own.orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("seq_id"), place.cast("long").alias("idx"), F.col("event_id").alias("orig_idx"), scaled.alias("score"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "events"))


def lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"))


def linspace(n: Column, k: int) -> Column:
    """k places spread over 0 .. n - 1 as an array."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    step = (n - 1) / F.lit(float(k - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i * step)).cast("long"))


def stride(fps: Column, target: float) -> Column:
    return F.when(fps <= 0, F.lit(1)).otherwise(F.greatest(F.floor(fps / max(target, 1e-6)), F.lit(1)).cast("int"))


def stride_sample(rows: DataFrame, fps: Column, target: float) -> DataFrame:
    return rows.where(F.col("idx") % stride(fps, target) == 0)


def spread_or_range(n: Column, k: int) -> Column:
    """k places spread over a video of n frames; 0 to k - 1 where n is null or not positive; none for k below 1."""
    if k < 1:
        return F.array().cast("array<bigint>")
    return F.when(n > 0, linspace(n, k)).otherwise(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))


def default_places(places: Column, n: Column) -> Column:
    """Original places of n sampled frames: 0 to n - 1 where none are given."""
    each = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(places) > 0, places).otherwise(each)


def by_rate(n: Column, rate: Column, wanted: float, most: int, forced: bool = False) -> Column:
    """Every so many frames that wanted are left a second, or most spread ones if those are more, or if forced."""
    stride = F.greatest(F.bround(rate / wanted), F.lit(1.0)).cast("long")
    many = F.ceil(n / stride) > most
    return F.when(F.lit(forced) | many, linspace(n, most)).otherwise(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, stride))


def midpoints(n: Column, k: int) -> Column:
    """Middles of k equal parts, halves rounded to even."""
    part = (n - 1) / F.lit(float(k))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(part / 2 + F.bround(part * i)).cast("long"))


def parse_indices(text: Column) -> Column:
    """Comma-separated numbers as an array; null for none."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(parts, lambda x: x.cast("int")))


def pick(rows: DataFrame, indices: list[int]) -> DataFrame:
    """Rows of each sequence at the listed places, in that order and as often as listed; others are ignored."""
    wanted = F.posexplode(F.array(*[F.lit(i).cast("long") for i in indices]))
    keys = rows.select("seq_id").distinct().select("seq_id", wanted.alias("rank", "idx"))
    return keys.join(rows, ["seq_id", "idx"]).select("seq_id", F.col("rank").cast("long").alias("rank"), "idx", "orig_idx")


def between(rows: DataFrame, start: int, end: int) -> DataFrame:
    low = max(0, start)
    kept = rows.where(F.col("idx") >= low)
    return kept.where(F.col("idx") < end) if end >= 0 else kept


def shard(rows: DataFrame, key: str, rank: int, world: int, limit: int) -> DataFrame:
    return rows.where((F.col(key) % world == rank) & (F.col(key) < limit))


def length_batches(docs: DataFrame, size: int, length: str | Column = "n_chars", group: str = "lang", text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, group and batch: batches of each group's documents from the longest to the shortest, ties by text and id.

    length is a column of characters, or of tokens where these are counted. A document's place is the number of
    longer ones in its group, from a count of documents by length, and its place among those of its length, so that
    no task holds a whole group.
    """
    own = docs.select(id, group, (F.col(length) if isinstance(length, str) else length).alias("length"), F.col(text).alias("batch_text"))
    longer = Window.partitionBy(group).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = own.groupBy(group, "length").agg(F.count("*").alias("n")).select(F.col(group).alias("g"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("ahead"))
    alike = Window.partitionBy(group, "length").orderBy("batch_text", id)
    placed = own.withColumn("place", F.row_number().over(alike) - 1)
    met = placed.join(ahead, placed[group].eqNullSafe(ahead["g"]) & placed["length"].eqNullSafe(ahead["l"]))
    return met.select(id, group, F.floor((F.col("ahead") + F.col("place")) / size).cast("long").alias("batch"))


def batched(rows: DataFrame, size: int, order: str) -> DataFrame:
    """rows in runs of at most size of each sequence, with the run's ordinal and its vectors as one list: what a model
    takes at once. flat() undoes it."""
    return rows.withColumn("run", F.floor((F.row_number().over(Window.partitionBy("seq_id").orderBy(order)) - 1) / size).cast("long")).groupBy("seq_id", "run").agg(F.sort_array(F.collect_list(F.struct(order, "vector"))).alias("items"))


def flat(batches: DataFrame) -> DataFrame:
    """The items of batches as rows again, in place of their lists."""
    return batches.select("seq_id", "run", F.inline("items"))

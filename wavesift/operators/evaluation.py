"""Accuracy and run roll-ups over rows of single results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavesift.functions.prompts import Hooks
from wavesift.session import settle


def _percent() -> F.Column:
    return F.coalesce(F.try_divide(100.0 * F.sum("correct"), F.count("*")), F.lit(0.0))


def by_each(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Accuracy for each value of each dimension, and overall: columns dimension, label, n, accuracy."""
    one = rows.select("correct", F.explode(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("").alias("label")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dims])).alias("g"))
    return one.groupBy("g.dimension", "g.label").agg(F.count("*").alias("n"), _percent().alias("accuracy"))


def over_domain(rows: DataFrame, dim: str, domain: list[str]) -> DataFrame:
    """label, n, accuracy for every label of a fixed domain, zero where there are no rows."""
    counted = rows.groupBy(F.col(dim).alias("label")).agg(F.count("*").alias("n"), _percent().alias("accuracy"))
    labels = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias("label"))
    return labels.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def macro(rows: DataFrame, dim: str, domain: list[str]) -> DataFrame:
    """Mean of the domain's accuracies; a label without rows counts as zero."""
    return over_domain(rows, dim, domain).agg(F.avg("accuracy").alias("accuracy"))


def weighted(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Mean of the subsets' rounded accuracies weighted by their sizes; each row is in a subset of each dimension."""
    parts = by_each(rows, dims).where("dimension != 'overall'").withColumn("accuracy", F.round(F.col("accuracy") / 100, 5))
    return parts.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("accuracy") * F.col("n")) / F.sum("n"), 5).alias("accuracy"))


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def latest_runs(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Rows of each key's latest time, all of them on a tie. The times are found by a partial aggregation first, and
    rows meet them by key and time, so that a key with many rows is not one task."""
    latest = rows.groupBy(key).agg(F.max(time).alias(time))
    return rows.join(latest, [key, time]).select(*rows.columns)


def lowest_choice(losses: F.Column, lengths: F.Column) -> tuple[F.Column, F.Column]:
    """Places of the least loss and of the least loss per length, the first on a tie."""
    each = F.zip_with(losses, lengths, lambda a, b: a / b)
    return F.array_position(losses, F.array_min(losses)) - 1, F.array_position(each, F.array_min(each)) - 1


def expanded(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, member and level of all members below each root, from edges (parent, child), level by level until there
    is no new one. A member is told once for each root, at its first level, so that cycles end. Each level is
    written to the shared folder."""
    edges = settle(edges.where("parent is not null and child is not null").distinct(), "edges")
    front = seen = settle(roots.where("root is not null").distinct().select("root", F.col("root").alias("member"), F.lit(0).alias("level")), "level")
    while not front.isEmpty():
        met = front.join(edges, front["member"] == edges["parent"]).select("root", F.col("child").alias("member"), (F.col("level") + 1).alias("level")).distinct()
        front = settle(met.join(seen.select("root", "member"), ["root", "member"], "left_anti"), "level")
        seen = seen.unionByName(front)
    return seen.where("level > 0")


def members(edges: DataFrame, roots: DataFrame, spark: SparkSession) -> DataFrame:
    """root, member and what the last edge (parent, child, ordinal, value) that leads to the member says: of several
    edges to one child a later one wins."""
    last = edges.groupBy("child").agg(F.max_by(F.struct("parent", "value"), "ordinal").alias("last"))
    return expanded(spark, edges.select("parent", "child"), roots).join(last, F.col("member") == F.col("child")).select("root", "member", "level", "last.value")


def competing(groups: DataFrame) -> DataFrame:
    """group and member where a member belongs to more than one group: the members that several have, met with each
    group's own."""
    several = groups.distinct().groupBy("member").agg(F.count("*").alias("n")).where("n > 1").select("member")
    return groups.select("group", "member").intersect(groups.select("group").distinct().join(groups.join(several, "member", "left_semi"), "group").select("group", "member"))


def judged(rows: DataFrame, id: str, gold: F.Column, pred: F.Column, order: str) -> DataFrame:
    """id and judge, Correct or Wrong, of each sample; of repeated ids the last counts. gold may be a list, of which
    any may be met."""
    return rows.groupBy(id).agg(F.max_by(F.when(F.coalesce(F.array_contains(gold, pred), F.lit(False)), "Correct").otherwise("Wrong"), order).alias("judge"))


#: Stands for a gold index that is not among the choices.
NO_GOLD = -100


def gold_index(gold: F.Column, choices: F.Column) -> F.Column:
    """Places of gold answers, a list of numbers or of texts, among the choices; NO_GOLD for one that is beyond them."""
    return F.transform(gold, lambda g: F.coalesce(F.when(g.try_cast("int").isNotNull() & (g.try_cast("int") < F.size(choices)), g.try_cast("int")), F.nullif(F.array_position(choices, g.cast("string")).cast("int") - 1, F.lit(-1)), F.lit(NO_GOLD)))


def mutual_information(losses: F.Column) -> F.Column:
    """For answers with 2n losses, of n choices in turn with and without the question, what the question adds to
    each choice."""
    with_, without = F.filter(losses, lambda _, i: i % 2 == 0), F.filter(losses, lambda _, i: i % 2 == 1)
    return F.zip_with(with_, without, lambda a, b: a - b)


def run_hash(rows: DataFrame, run: str, order: str, digest: str) -> DataFrame:
    """run and hash: one digest over the digests of a run's samples in order, each behind "sample_" and its place
    from 0 on. A run's digests are one list, a line for each sample of a benchmark."""
    held = F.transform(F.sort_array(F.collect_list(F.struct(order, digest))), lambda x, i: F.concat(F.lit("sample_"), i.cast("string"), x[digest]))
    return rows.groupBy(run).agg(F.sha2(F.array_join(held, ""), 256).alias("hash"))


def known_only(rows: DataFrame, dim: str, domain: list[str]) -> DataFrame:
    """rows, with an error for a label outside of the domain."""
    return rows.withColumn(dim, F.when(F.col(dim).isin(domain), F.col(dim)).otherwise(F.raise_error(F.concat(F.lit(f"{dim}: unknown label "), F.coalesce(F.col(dim), F.lit("null"))))))


def by_substring(rows: DataFrame, dims: list[str], domain: list[str]) -> DataFrame:
    """label, n, accuracy of every label of the domain over the rows with a label of any dimension that contains it;
    the domain is fixed and small."""
    joined = F.concat_ws("_", *dims)
    hits = F.filter(F.array(*map(F.lit, domain)), lambda x: F.contains(joined, x))
    counted = rows.select("correct", F.explode(hits).alias("label"))
    return over_domain(counted, "label", domain)


#: Aggregates of results by name.
AGGREGATES = Hooks()
AGGREGATES.add("mean", "acc")(F.avg)
AGGREGATES.add("sum")(F.sum)
AGGREGATES.add("max")(F.max)
AGGREGATES.add("percent")(lambda c: F.coalesce(F.try_divide(100.0 * F.sum(c), F.count(c)), F.lit(0.0)))


def rolled_up(rows: DataFrame, by: list[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """by, and each metric: a name, the column it is of and the aggregate's name."""
    return rows.groupBy(*by).agg(*[AGGREGATES[how](F.col(c)).alias(name) for name, (c, how) in metrics.items()])

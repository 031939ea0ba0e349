"""Annotation, score and subtitle files as tables, and sinks for results."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wavesift.functions.parsers import clock_seconds
from wavesift.operators.frames import linspace


def annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file whose root is a list, as rows in its order with their ordinal; an error for another root."""
    text = spark.read.text(path, wholetext=True)
    checked = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.lit("the root is no list")))
    items = text.select(F.posexplode(F.from_json(checked, F.lit(f"array<struct<{schema}>>"))).alias("ordinal", "item"))
    return items.select(F.col("ordinal").cast("long"), "item.*")


def grouped_questions(rows: DataFrame, key: str, fields: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """Questions of each key in file order, keys in order of first appearance; first: columns of the key's first row."""
    held = F.sort_array(F.collect_list(F.struct("ordinal", *fields)))
    return rows.groupBy(key).agg(F.min("ordinal").alias("first_ordinal"), *[F.min_by(c, "ordinal").alias(c) for c in first], held.alias("questions"))


def question_places(rows: DataFrame, key: str, question_id: str = "question_id") -> DataFrame:
    """rows with question_index: the last part of the id by dashes, less one, or else the question's place among those
    of its key, in file order from 0 on."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ordinal")) - 1
    return rows.withColumn("question_index", F.coalesce(F.element_at(F.split(F.col(question_id).cast("string"), "-"), -1).try_cast("int") - 1, place))


def dataset(spark: SparkSession, settings: dict) -> DataFrame:
    """The data files that settings name: load_from_disk (Parquet), or data_files, JSON lists, JSON lines or Parquet by
    their extension. There is no hub."""
    files = settings.get("load_from_disk") or settings.get("data_files")
    if not files:
        raise ValueError("settings name no data files")
    paths = [files] if isinstance(files, str) else list(files)
    if settings.get("load_from_disk") or all(p.endswith(".parquet") for p in paths):
        return spark.read.parquet(*paths)
    return spark.read.option("multiLine", not all(p.endswith((".jsonl", ".ndjson")) for p in paths)).json(paths)


def features(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """feature_id, idx and vector of all samples' features by one model; none where it has written none."""
    rows = spark.read.schema("feature_id string, idx long, vector array<float>, feature_model string").parquet(folder)
    return rows.where(F.col("feature_model") == model).select("feature_id", "idx", "vector")


def write_features(rows: DataFrame, folder: str, model: str) -> None:
    """Add a model's features (feature_id, idx, vector) to the folder, in place of those it had."""
    own = rows.select("feature_id", "idx", F.col("vector").cast("array<float>").alias("vector"), F.lit(model).alias("feature_model"))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_model").parquet(folder)


def binaries(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and content of the files below a folder whose names fit the pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def decoded(files: DataFrame, decoder: Callable[[str, bytes], Iterable[tuple[int, Any]]], schema: str) -> DataFrame:
    """path, frame and the value of schema (a column "value ...") of each frame that decoder(path, content) gives: the
    place where a decoder of videos or images is plugged in; none is built in."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(decoder(path, content))
                yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array([n for n, _ in found], pa.int64()), pa.array([v for _, v in found], kind)], ["path", "frame", "value"])

    kind = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema).field("value").type
    return files.select("path", "content").mapInArrow(each, f"path string, frame long, {schema}")


def archive_parts(files: DataFrame, path: str = "path") -> DataFrame:
    """archive and parts: the paths of each archive's numbered parts (name_1.tar, name_2.tar and so on) in order of name,
    to be put together; how they are fetched and unpacked is left to the user."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.tar.*$", ""), r"_\d+$", "")
    return files.groupBy(base.alias("archive")).agg(F.sort_array(F.collect_list(path)).alias("parts"))


def image_frames(spark: SparkSession, folder: str, k: int = 10, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """directory, rank and path of k images of each directory, spread over its files in order of name."""
    own = Window.partitionBy("directory")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.regexp_extract("path", "^(.*)/", 1).alias("directory"))
    placed = listed.withColumns({"n": F.count("*").over(own), "idx": F.row_number().over(own.orderBy("path")) - 1})
    return placed.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("idx") == linspace(F.col("n"), k)[F.col("rank")]).select("directory", "rank", "path")


def scores(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Score files <folder>/<feature_id>/similarity_scores.json with their feature_id."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/similarity_scores.json")
    return rows.withColumn("feature_id", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/similarity_scores[.]json$", 1))


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """SRT blocks as start_s, end_s, text; of equal intervals the later block."""
    block = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\n\s*\n")).alias("n", "block"))
    lines = block.withColumn("lines", F.split("block", "\n")).where(F.size("lines") >= 3)
    times = F.split(F.col("lines")[1], " --> ")
    made = lines.select("n", clock_seconds(F.trim(times[0])).alias("start_s"), clock_seconds(F.trim(times[1])).alias("end_s"), F.array_join(F.slice("lines", 3, F.size("lines")), " ").alias("text"))
    return made.groupBy("start_s", "end_s").agg(F.max_by("text", "n").alias("text"))


def subtitle_list(spark: SparkSession, path: str, duration: float, start: float = 0.0) -> DataFrame:
    """A JSON list of subtitles as ordinal, start_s, end_s and text, less the time at which they start: entries with a
    timestamp of two seconds and a text, or with start and end by the clock and a line. An end that is no decimal
    number is the duration."""
    kind = "array<struct<timestamp:array<string>,text:string,start:string,end:string,line:string>>"
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("ordinal", "x"))
    timed = F.col("x.timestamp").isNotNull()
    end = F.when(F.get("x.timestamp", F.lit(1)).rlike("[.eE]"), F.get("x.timestamp", F.lit(1)).try_cast("double"))
    made = each.select(
        F.col("ordinal").cast("long").alias("ordinal"),
        F.when(timed, F.get("x.timestamp", F.lit(0)).cast("double")).otherwise(clock_seconds(F.col("x.start"))).alias("s"),
        F.when(timed, F.coalesce(end, F.lit(float(duration)))).otherwise(clock_seconds(F.col("x.end"))).alias("e"),
        F.when(timed, F.col("x.text")).otherwise(F.col("x.line")).alias("text"),
    )
    return made.select("ordinal", (F.col("s") - start).alias("start_s"), (F.col("e") - start).alias("end_s"), "text")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def keyframe_path(benchmark: str, model: str, k: int, folder: str = "outputs", prefix: str = "keyframes") -> str:
    """Where a run's keyframes go by default."""
    return f"{folder}/{benchmark}/{prefix}_{benchmark}_{model}_{k}f.json"


def export_list(rows: DataFrame, path: str, order: str) -> int:
    """Write rows, in order, as one JSON list for readers that want a single local file; how many there are. Rows pass
    through the driver one by one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, r in enumerate(rows.orderBy(order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("r")).toLocalIterator(), 1):
            f.write((",\n" if n > 1 else "\n") + r.r)
        f.write("\n]")
    return n


def export_map(rows: DataFrame, path: str, key: str, value: str) -> None:
    """Write key and value of rows, which repeat no key, as one JSON object."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({str(r[0]): r[1] for r in rows.select(key, value).toLocalIterator()}, f, ensure_ascii=False)


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)

"""From annotation rows and score files to keyframes: records, payloads, the decision for each record, and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavesift.functions.parsers import question_index
from wavesift.functions.prompts import Hooks, scores_of
from wavesift.functions.signal_kernels import Settings
from wavesift.operators import frames, select

#: For each benchmark, a record's columns from its annotation: the name of its scores' folder, its video, its question.
ADAPTERS = Hooks()

SELECTED, MISSING, NO_SCORES, SHORT = "selected", "missing_payload", "missing_scores", "too_short"


def _nothing() -> Column:
    return F.lit(None).cast("int")


@ADAPTERS.add("videomme")
def _by_video(root: str) -> dict[str, Column]:
    return {"feature_id": F.col("video_id").cast("string"), "video_path": F.concat(F.lit(f"{root}/data/"), F.col("videoID"), F.lit(".mp4")), "question_index": question_index(F.col("question_id").cast("string"))}


@ADAPTERS.add("lvb", "longvideobench")
def _by_ordinal(root: str) -> dict[str, Column]:
    return {"feature_id": F.col("ordinal").cast("string"), "video_path": F.concat(F.lit(f"{root}/videos/"), F.col("video_path")), "question_index": _nothing()}


@ADAPTERS.add("mlvu")
def _by_question(root: str) -> dict[str, Column]:
    return {"feature_id": F.col("question_id").cast("string"), "video_path": F.concat(F.lit(f"{root}/video/"), F.col("video_name")), "question_index": _nothing()}


def records(annotations: DataFrame, benchmark: str, root: str) -> DataFrame:
    """ordinal, raw (the whole annotation), feature_id, video_path and question_index of each annotation."""
    made = ADAPTERS[benchmark](root)
    return annotations.select("ordinal", F.struct(*[c for c in annotations.columns if c != "ordinal"]).alias("raw"), *[c.alias(n) for n, c in made.items()])


def decided(records: DataFrame, payloads: DataFrame, model: str, k: int) -> DataFrame:
    """records with status, scores and frame_indices. payloads (feature_id, frame_indices, and either questions, each
    with a column of scores, or that column itself, named after the model) are joined by feature_id; a record without
    one, without scores in it, or with fewer scores than k is not selected from. Frame indices that are missing are
    0 to n - 1."""
    key = f"{model}_similarities"
    found = scores_of(F.col("questions"), F.col("question_index"), key, position=F.col("ordinal")) if "questions" in payloads.columns else F.col(key)
    held = payloads.select("feature_id", "frame_indices", *[c for c in ("questions", key) if c in payloads.columns], F.lit(True).alias("there"))
    met = records.join(held, "feature_id", "left").withColumn("scores", found)
    status = F.when(F.col("there").isNull(), MISSING).when(F.coalesce(F.size("scores"), F.lit(0)) <= 0, NO_SCORES).when(F.size("scores") < k, SHORT).otherwise(SELECTED)
    places = frames.default_places(F.col("frame_indices").cast("array<bigint>"), F.size("scores"))
    return met.select(*records.columns, status.alias("status"), F.col("scores").cast("array<double>").alias("scores"), places.alias("frame_indices"))


def keyframes(decided: DataFrame, settings: Settings = Settings(), features: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """ordinal, status and keyframe_indices of every record.

    Selected records are chosen from by their scores and, where there are features (feature_id, idx, vector) for all
    of a sample's frames, by their vectors; chosen frames are mapped to original ones. The others get the budget
    spread over the video's frames where lengths (video_path, n_frames) know them, else 0 to budget - 1.
    """
    k = settings.budget
    chosen_from = decided.where(F.col("status") == SELECTED)
    rows = chosen_from.select(F.col("ordinal").alias("seq_id"), "feature_id", F.posexplode("scores").alias("idx", "score")).withColumn("idx", F.col("idx").cast("long")).withColumn("orig_idx", F.col("idx"))
    if features is not None:
        own = features.select(F.col("feature_id").cast("string").alias("feature_id"), F.col("idx").cast("long").alias("idx"), "vector")
        rows = rows.join(own, ["feature_id", "idx"], "left")
    found = select.keyframes(rows, settings, features is not None).groupBy(F.col("seq_id").alias("ordinal")).agg(F.collect_list("idx").alias("chosen"))
    mapped = chosen_from.select("ordinal", "status", "frame_indices").join(found, "ordinal").select("ordinal", "status", select.to_original(F.col("chosen"), F.col("frame_indices"), k).alias("keyframe_indices"))
    rest = decided.where(F.col("status") != SELECTED).select("ordinal", "status", "video_path")
    rest = rest.join(lengths.select("video_path", "n_frames"), "video_path", "left") if lengths is not None else rest.withColumn("n_frames", F.lit(None).cast("long"))
    return mapped.unionByName(rest.select("ordinal", "status", frames.spread_or_range(F.col("n_frames"), k).alias("keyframe_indices")))


def outputs(records: DataFrame, keyframes: DataFrame) -> DataFrame:
    """ordinal, and the raw annotations with their keyframe_indices."""
    return records.select("ordinal", "raw").join(keyframes, "ordinal").select("ordinal", "raw.*", "keyframe_indices")


def summary(keyframes: DataFrame) -> DataFrame:
    """num_records, success, fallback and missing_scores of a run, in one row."""
    status = F.col("status")
    return keyframes.agg(F.count("*").alias("num_records"), F.count_if(status == SELECTED).alias("success"), F.count_if(status != SELECTED).alias("fallback"), F.count_if(status == MISSING).alias("missing_scores"))


def without_videos(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records whose video_path is among files (video_path), and those without."""
    listed = files.select("video_path").distinct()
    return records.join(listed, "video_path", "left_semi"), records.join(listed, "video_path", "left_anti")


def prepared(attempts: DataFrame) -> DataFrame:
    """total, success, failed, read_time and model_time over attempts (feature_id, status of done, failed or skipped,
    read_time, model_time), in one row; failed is the ids in order, a list that grows with the failures alone."""
    failed = F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.col("feature_id"))))
    return attempts.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("success"), failed.alias("failed"), F.coalesce(F.sum("read_time"), F.lit(0.0)).alias("read_time"), F.coalesce(F.sum("model_time"), F.lit(0.0)).alias("model_time"))


def of_class(rows: DataFrame, value: str, column: str = "duration") -> DataFrame:
    return rows.where(F.col(column) == value)


#: Types of columns that are media and are not needed to make requests.
MEDIA = ("binary", "array<binary>")


def without_media(rows: DataFrame, names: tuple[str, ...] = ("image", "video", "audio", "images", "visual")) -> DataFrame:
    """rows without columns of media, by type or by name."""
    return rows.drop(*[f.name for f in rows.schema.fields if f.dataType.simpleString() in MEDIA or f.name in names])


def with_documents(keyframes: DataFrame, docs: DataFrame) -> DataFrame:
    """docs met with their own keyframes by task, split and doc_id."""
    return docs.join(keyframes.select("task", "split", "doc_id", "keyframe_indices"), ["task", "split", "doc_id"])

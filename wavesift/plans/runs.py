"""What surrounds a run: its settings, names, cached requests and printed results. None of it grows with the data,
but for the cache, which is a table."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys that name a model, the first that is found wins; seeds that stand where none is given.
MODEL_KEYS = ["peft=", "delta=", "pretrained=", "model=", "model_version=", "model_name=", "model_id=", "path=", "engine="]
SEEDS = "0,1234,1234,1234"


def model_name(arguments: Column) -> Column:
    """What follows the first known key in "key=value,key=value", up to a comma; empty without any."""
    found = [F.when(F.contains(arguments, F.lit(k)), F.split_part(F.split_part(arguments, F.lit(k), F.lit(2)), F.lit(","), F.lit(1))) for k in MODEL_KEYS]
    return F.coalesce(*found, F.lit(""))


def safe_name(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\w.]", "_")


def without_extension(s: Column, extension: str = ".mp4") -> Column:
    return F.replace(s, F.lit(extension), F.lit(""))


def data_name(path: Column) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def first_existing(stem: Column, present: Column, extensions: tuple[str, ...] = (".mp4", ".MP4", ".mkv")) -> Column:
    """The first of the stem's files in the array present; null if none is."""
    return F.coalesce(*[F.when(F.array_contains(present, F.concat(stem, F.lit(e))), F.concat(stem, F.lit(e))) for e in extensions])


def seeds(given: str, least: int = 3, most: int = 4, default: str = SEEDS) -> list[int | None]:
    """Whole numbers or none, separated by commas: one stands for all, and a short list goes on with the default."""
    parse = lambda s: [None if x.strip().lower() == "none" else int(x) for x in s.split(",")]
    found = parse(given)
    if len(found) == 1:
        return found * most
    if not least <= len(found) <= most:
        raise ValueError(f"{most} numbers are wanted, separated by commas")
    return found + parse(default)[len(found) :]


def matching(patterns: list[str], names: list[str]) -> list[str]:
    """Names that fit any of the wildcard patterns, sorted."""
    return sorted({n for p in patterns for n in names if fnmatch.fnmatchcase(n, p)})


def merged(*settings: dict) -> dict:
    """One dictionary; later values win, and dictionaries within are merged alike."""
    out: dict = {}
    for s in settings:
        for k, v in s.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_settings(path: str) -> dict:
    """A YAML file's settings, without the lines that name functions."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("settings files need the yaml package") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load("".join(line for line in f if "!function" not in line)) or {}


def task_files(*folders: str, extension: str = ".yaml") -> dict[str, str]:
    """Path of each task file below the folders by its name; of equal names the first folder's, then the first path's."""
    found: dict[str, str] = {}
    for folder in folders:
        for at, below, names in os.walk(folder):
            below.sort()
            for n in sorted(names):
                if n.endswith(extension):
                    found.setdefault(n[: -len(extension)], os.path.join(at, n))
    return found


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame], renew: bool = False) -> DataFrame:
    """The table of requests for key, made and written at the first call and read at later ones."""
    name = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if renew or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def logged(results: DataFrame, kept_apart: tuple[str, ...] = ("doc", "arguments")) -> DataFrame:
    """Rows for a log of results: without bulky columns, targets as text, responses only if filtering changed them."""
    out = results.drop(*kept_apart)
    if "target" in out.columns:
        out = out.withColumn("target", F.col("target").cast("string"))
    if {"resps", "filtered_resps"} <= set(out.columns):
        out = out.withColumn("resps", F.when(~F.col("resps").eqNullSafe(F.col("filtered_resps")), F.col("resps")))
    return out


def printed(results: DataFrame, rows: int = 200) -> str:
    """The first rows of a table of results as Markdown; a report, so the number of rows is its feature."""
    held = results.limit(rows).collect()
    lines = [results.columns, ["---"] * len(results.columns), *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in held]]
    return "\n".join("| " + " | ".join(re.sub(r"\s*\n\s*", " ", c).replace("|", "\\|") for c in line) + " |" for line in lines)


def write_report(results: DataFrame, folder: str, name: str, date: str) -> str:
    """One JSON file <name>+<date>.json of a small table of aggregated results; its path."""
    path = os.path.join(folder, f"{name}+{re.sub(r'[^\w.]', '_', date)}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in results.collect()], f, ensure_ascii=False, default=str)
    return path

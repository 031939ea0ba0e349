"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPOSITORY = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package; where they already can, nothing changes."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if REPOSITORY not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (REPOSITORY, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    application = spark.sparkContext.applicationId
    if application not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[application] = "file://" + tempfile.mkdtemp(prefix="wavesift-")
    return _own[application]


def settle(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write df as a table in the folder, by default a new one in the shared folder, and read it again: a lost
    executor then costs no recomputation of what lies before it. The path is in the result's attribute settled_at."""
    spark = df.sparkSession
    path = folder or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.settled_at = path
    return again


def forget(df: DataFrame) -> None:
    """Delete a settled table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

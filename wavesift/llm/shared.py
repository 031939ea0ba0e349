"""What the operators of this package share: the shared folder, and how Arrow batches are sized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavesift.session import forget, prepare, settle, shared_folder, table

__all__ = ["documents", "forget", "prepared", "settle", "shared_folder", "table"]

#: Rows in an Arrow batch sent to Python; with long texts the default of 10,000 would be gigabytes.
ARROW_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark) and table(spark, sf_dir, "documents")


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with workers that can import the package and Arrow batches of bounded length."""
    prepare(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark

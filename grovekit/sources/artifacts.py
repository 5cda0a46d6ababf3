"""Results that are kept by name: what is there is read, what is not is made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .folder import Folder


def kept(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` under ``root``; made and written first if it is not there whole."""
    path = f"{root.rstrip('/')}/{name}"
    if "_SUCCESS" not in Folder(spark, path).names():
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

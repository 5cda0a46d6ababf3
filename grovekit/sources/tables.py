"""JSON lines and CSV sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH = T.ArrayType(T.StringType())
#: The fields of placement tasks, all versions together; what a file lacks is null.
TASK = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("kind", T.StringType()), ("text", T.StringType()), ("gold_path", PATH), ("roots", PATH), ("source_file", T.StringType()), ("frozen", T.BooleanType()), ("tree_id", T.StringType()), ("existing_dirs", T.ArrayType(PATH)), ("intent", T.StringType()), ("twin_key", T.StringType()), ("from_path", PATH), ("cue", T.StringType()), ("fact_id", T.StringType()))])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = TASK) -> DataFrame:
    """One object a line, by a fixed schema; blank lines are skipped, and lines that are no object are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV with every field quoted and a header."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet, all text; a byte order mark before the first name goes."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])


def check_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows with a value in ``column``; any value that is not allowed is an error. Blank rows are skipped."""
    filled = df.filter(F.coalesce(F.trim(column), F.lit("")) != "")
    bad = filled.filter(~F.trim(column).isin(*allowed)).select(F.trim(column)).distinct().limit(5).collect()
    if bad:
        raise ValueError(f"unknown values in {column}: {[r[0] for r in bad]}")
    return filled

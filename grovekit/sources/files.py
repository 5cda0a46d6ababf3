"""Files as notes: a recursive scan, and the reasons why a file is not taken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import path_for_file, path_is_valid
from ..functions.text import short_sha1

BODY_CHARS, TASK_CHARS = 2000, 500
MAX_BYTES, MAX_PER_ROOT = 80_000, 80


def scan_files(spark: SparkSession, root: str, suffixes: Sequence[str] = (".md", ".txt"), skip: Sequence[str] = (".git", "node_modules", ".obsidian")) -> DataFrame:
    """path (below the root), length, content of the files of some suffixes, without those in folders to skip."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = F.split(rel, "/")
    ending = F.lower(F.regexp_extract(rel, r"(\.[^./]+)$", 1))
    return raw.select(rel.alias("path"), "length", "content").filter(ending.isin(*suffixes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, skip))) if skip else ending.isin(*suffixes))


def ingest(files: DataFrame, max_bytes: int = MAX_BYTES, max_per_root: int = MAX_PER_ROOT, max_depth: int = 5) -> DataFrame:
    """root, source, path, ok, reason, id, body, text, folder.

    files: root, source, path, content (bytes; null if it could not be read). Reasons rank: cap (accepted files only
    count, in path order), unreadable, too_large, not_utf8, empty, bad_path.
    """
    body = F.regexp_replace(F.decode(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content")), "utf-8"), r"^\s+|\s+$", "")
    parents = F.filter(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda s: s != "")
    folder = path_for_file(F.col("root"), F.col("source"), parents, max_depth)
    reason = (
        F.when(F.col("content").isNull(), F.lit("unreadable"))
        .when(F.length("content") > max_bytes, F.lit("too_large"))
        .when(~F.is_valid_utf8(F.col("content").cast("string")), F.lit("not_utf8"))
        .when(body == "", F.lit("empty"))
        .when(~path_is_valid(folder), F.lit("bad_path"))
    )
    seen = files.withColumn("reason", reason).withColumn("body", body).withColumn("folder", folder)
    # a file is past the cap when its root has accepted that many before it: those after the last one accepted. Only the
    # paths of the first accepted files are ranked, and contents are not moved
    place = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    last = seen.filter("reason IS NULL").select("root", "path").withColumn("_r", place).filter(F.col("_r") <= max_per_root).groupBy("root").agg(F.max("path").alias("_last"), F.max("_r").alias("_n"))
    seen = seen.join(last, "root", "left")
    seen = seen.withColumn("reason", F.when((F.col("_n") >= max_per_root) & (F.col("path") > F.col("_last")), F.lit("cap")).otherwise(F.col("reason")))
    ok = F.col("reason").isNull()
    cut = F.when(F.length("body") > BODY_CHARS, F.concat(F.substring("body", 1, BODY_CHARS), F.lit("…"))).otherwise(F.col("body"))
    return seen.select(
        "root", "source", "path", ok.alias("ok"), "reason", F.when(ok, F.concat(F.col("root"), F.lit("_"), short_sha1(F.concat_ws("/", "source", "path")))).alias("id"),
        F.when(ok, cut).alias("body"), F.when(ok, F.substring(cut, 1, TASK_CHARS)).alias("text"), F.when(ok, F.col("folder")).alias("folder"),
    )

"""Accuracy of predictors: by occupancy of the gold folder, by vault, pooled, conditional; recall and percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTLIERS = ("src1", "src2")


def share(flag: Column) -> Column:
    """Mean of a verdict; null verdicts take no part."""
    return F.avg(flag.cast("double"))


def occupancy_table(v: DataFrame) -> DataFrame:
    """arm, bucket, n, n_scored, accuracy: by bucket, and over all (items of empty folders are in "all" only)."""
    part = v.groupBy("arm", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count("exact").alias("n_scored"), F.count_if("exact").alias("hits"))
    both = part.filter("bucket <> '0'").unionByName(part.groupBy("arm").agg(F.sum("n").alias("n"), F.sum("n_scored").alias("n_scored"), F.sum("hits").alias("hits")).withColumn("bucket", F.lit("all")))
    return both.select("arm", "bucket", "n", "n_scored", F.round(F.try_divide("hits", "n_scored"), 6).alias("accuracy"))


def vault_hits(v: DataFrame, *keys: str) -> DataFrame:
    """vault, arm (and keys), h, n: hits and scored items."""
    return v.groupBy("vault", "arm", *keys).agg(F.count_if("exact").alias("h"), F.count("exact").alias("n"))


def rollup_all(v: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Aggregates by key and over all, which is named ALL."""
    return v.rollup(key).agg(F.grouping(key).alias("_g"), *aggs).withColumn(key, F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(key))).drop("_g")


def pooled(per_vault: DataFrame, rate: str, n: str, rounded: bool = False) -> Column:
    """The n-weighted mean of rates by vault, of rates rounded to four places if that is how they were kept."""
    r = F.round(rate, 4) if rounded else F.col(rate)
    return F.sum(r * F.col(n)) / F.sum(n)


def exclude(v: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the vaults whose name has one of the strings in it."""
    out = v
    for s in names:
        out = out.filter(~F.col("vault").contains(s))
    return out


def crossing(v: DataFrame, a: str, b: str, sparse: str = "1-2", dense: str = "10+") -> DataFrame:
    """By vault the gap of arm a over arm b in sparse and in dense folders."""
    paired = v.groupBy("vault", "id", "bucket").agg(*[F.max(F.when(F.col("arm") == x, F.col("exact").cast("int"))).alias(n) for x, n in ((a, "ea"), (b, "eb"))]).filter("ea IS NOT NULL AND eb IS NOT NULL")
    gap = lambda k: F.avg(F.when(F.col("bucket") == k, (F.col("ea") - F.col("eb")).cast("double")))
    return paired.groupBy("vault").agg(gap(sparse).alias("sparse"), gap(dense).alias("dense"))


def nested_choice(hits: DataFrame, prefer: int = 5) -> DataFrame:
    """vault, k, h, n: for each vault the k with most hits over the other vaults (the nearest to ``prefer`` of equals)."""
    total = hits.groupBy("k").agg(F.sum("h").alias("all_h"))
    rest = hits.join(F.broadcast(total), "k").withColumn("others", F.col("all_h") - F.col("h"))
    best = rest.groupBy("vault").agg(F.max_by("k", F.struct("others", -F.abs(F.col("k") - prefer), -F.col("k"))).alias("k"))
    return best.join(hits, ["vault", "k"])


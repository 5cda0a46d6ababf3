"""Ranks and percentiles of tables of any size, without a task that holds all rows or all rows of a group.

Ranks: rows are sorted by range into partitions; counts by partition (and group) say how many rows come before each
partition, and a row's rank is that and its place in the partition. Percentiles: histograms between the least and the
greatest value that can be the one asked for, refined until one value is left; only counts by bucket are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: The partition's number is above these bits of the row numbers that Spark gives.
_PART_BITS = 33
#: Buckets of a histogram.
BUCKETS = 1024


def ranked(df: DataFrame, by: Sequence, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """The rows with their rank from 1 on in the order of ``by`` (columns or names), within each value of ``keys`` where there are
    such. Rows that are equal in ``by`` get ranks of their own, in any order. Null keys are a group."""
    order = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in by]]
    base = Scratch(df.sparkSession).save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    base = base.withColumn("_part", F.shiftright("_at", _PART_BITS))
    count = base.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        count = count.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    else:  # a row for each partition
        before, rows = 0, []
        for r in sorted(count.collect(), key=lambda r: r["_part"]):
            rows.append((r["_part"], r["_first"], before))
            before += r["_n"]
        count = df.sparkSession.createDataFrame(rows, "_part long, _first long, _before long")
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    right = count.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for k, v in names.items():
        same &= F.col(k).eqNullSafe(F.col(v))
    return base.join(right, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def percentiles(df: DataFrame, group: str, value: str, shares: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """group, share, value: exact percentiles, interpolated between the two nearest values; null values take no part.

    Each round counts the values between the bounds of a percentile in so many buckets and keeps the bucket (or the two) of
    its place, with the least and the greatest value in it as the new bounds.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    start = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    start = start.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("place", F.col("share") * (F.col("n") - 1))
    now = start.select("g", "share", F.floor("place").alias("a"), F.ceil("place").alias("b"), (F.col("place") - F.floor("place")).alias("part"), "low", "high", F.lit(0).cast("long").alias("before"))
    at = lambda c, e: F.max(F.when((F.col("from") <= F.col(c)) & (F.col(c) < F.col("to")), F.col(e)))
    done = []
    while True:
        now = scratch.save(now)
        # one value left, or the two of the place in buckets of their own
        done.append(now.filter("low = high OR before IS NULL"))
        now = now.filter("low < high AND before IS NOT NULL")
        if not now.limit(1).count():
            break
        found = rows.join(now.select(F.col("g").alias("_g"), "share", "low", "high"), F.col("g").eqNullSafe(F.col("_g")) & F.col("x").between(F.col("low"), F.col("high")))
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * buckets)).cast("int")
        found = found.groupBy("g", "share", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        w = Window.partitionBy("g", "share").orderBy("bucket")
        found = found.join(now.select(F.col("g").alias("_g"), F.col("share").alias("_s"), "a", "b", "part", "before"), F.col("g").eqNullSafe(F.col("_g")) & (F.col("share") == F.col("_s")))
        found = found.withColumn("to", F.col("before") + F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
        found = found.groupBy("g", "share", "a", "b", "part").agg(at("a", "bucket").alias("ba"), at("b", "bucket").alias("bb"), at("a", "least").alias("l"), at("a", "most").alias("ha"), at("b", "least").alias("lb"), at("b", "most").alias("h"), at("a", "from").alias("f"))
        one = F.col("ba") == F.col("bb")
        now = found.select("g", "share", "a", "b", "part", F.when(one, F.col("l")).otherwise(F.col("ha")).alias("low"), F.when(one, F.col("h")).otherwise(F.col("lb")).alias("high"), F.when(one, F.col("f")).alias("before"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select(F.col("g").alias(group), "share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias(value))

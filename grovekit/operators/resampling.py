"""Bootstrap over whole vaults and permutation tests. Draws are hashes, so arms share them and runs repeat them.

Replicates are dealt into blocks. A task takes a block of them with the figures of all vaults, counts how often each
replicate draws each vault, and multiplies the counts with the figures; what it hands on are a few numbers for each
replicate, or, for a permutation test, how many of its replicates reach the statistic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Draws of a block, and blocks, at most.
BLOCK_DRAWS, BLOCKS = 200_000, 256


def _digest(*parts) -> str:
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def draw_counts(vaults: int, rep: int, seed: int) -> np.ndarray:
    """How often a replicate draws each vault: as many draws as vaults, with replacement."""
    return np.bincount([int(_digest(seed, rep, j)[:15], 16) % vaults for j in range(vaults)], minlength=vaults)


def _in_blocks(figures: DataFrame, keys: list[str], vaults: int, reps: int, run: Callable[[pa.Table, range], pa.Table], schema: str) -> DataFrame:
    """``run`` on the figures of each value of the keys, with each block of replicates."""
    n = max(1, min(BLOCKS, reps, -(-reps * max(1, vaults) // BLOCK_DRAWS)))
    dealt = figures.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def block(t: pa.Table) -> pa.Table:
        b = t.column("_block")[0].as_py()
        return run(t, range(b * reps // n, (b + 1) * reps // n))

    return dealt.groupBy(*keys, "_block").applyInArrow(block, schema)


def _resampled(figures: DataFrame, columns: list[str], reps: int, seed: int) -> DataFrame:
    """bucket, arm, rep, x: the statistic of each replicate; columns: hits of an arm, and what they are a share of.

    figures: bucket, vault, arm and the columns, one row for each vault and arm that there is.
    """
    vaults = figures.groupBy("bucket").agg(F.count_distinct("vault").alias("v")).agg(F.max("v")).first()[0] or 0

    def run(t: pa.Table, these: range) -> pa.Table:
        names, arms = sorted(set(t.column("vault").to_pylist())), sorted(set(t.column("arm").to_pylist()))
        row, col = {v: i for i, v in enumerate(names)}, {a: i for i, a in enumerate(arms)}
        i, j = np.array([row[v] for v in t.column("vault").to_pylist()]), np.array([col[a] for a in t.column("arm").to_pylist()])
        h, n = np.zeros((len(names), len(arms))), np.zeros((len(names), len(arms)))
        np.add.at(h, (i, j), t.column(columns[0]).to_numpy())
        np.add.at(n, (i, j), t.column(columns[1]).to_numpy())
        there = np.zeros((len(names), len(arms)))
        there[i, j] = 1
        x, seen = np.empty((len(these), len(arms))), np.empty((len(these), len(arms)), bool)
        for k, rep in enumerate(these):
            counts = draw_counts(len(names), rep, seed)
            x[k], seen[k] = (counts @ h) / np.maximum(counts @ n, 1), counts @ there > 0
        r, a = np.nonzero(seen)  # an arm that no drawn vault has gives no figure
        bucket = t.column("bucket")[0].as_py()
        return pa.table({"bucket": [bucket] * len(r), "arm": pa.array(arms).take(pa.array(a)), "rep": pa.array(np.array(these, np.int64)[r]), "x": x[r, a]})

    return _in_blocks(figures, ["bucket"], vaults, reps, run, "bucket string, arm string, rep long, x double")


def bootstrap(hits: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """bucket, arm, acc, low, high: accuracy and its 95 % interval; hits: bucket, vault, arm, h, n."""
    stat = _resampled(hits, ["h", "n"], reps, seed)
    ci = stat.groupBy("bucket", "arm").agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    acc = hits.groupBy("bucket", "arm").agg((F.sum("h") / F.greatest(F.sum("n"), F.lit(1))).alias("acc"))
    return acc.join(ci, ["bucket", "arm"])


def paired_bootstrap(pairs: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """bucket, diff, low, high, n_vaults: of items that both arms scored; pairs: bucket, vault, ha, hb, n."""
    stat = _resampled(pairs.select("bucket", "vault", F.lit("").alias("arm"), (F.col("ha") - F.col("hb")).alias("d"), "n"), ["d", "n"], reps, seed)
    ci = stat.groupBy("bucket").agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    own = pairs.groupBy("bucket").agg(((F.sum("ha") - F.sum("hb")) / F.greatest(F.sum("n"), F.lit(1))).alias("diff"), F.count_if(F.col("n") > 0).alias("n_vaults"))
    return own.join(ci, "bucket")


def rank_correlation(df: DataFrame, keys: tuple[str, ...], x: str, y: str, reps: int = 500, seed: int = 0) -> DataFrame:
    """keys, rho, p: Spearman's correlation on ordinal ranks; p by permuting the ranks of y. A group of one vault has none."""
    w = Window.partitionBy(*keys)
    ranks = df.withColumn("rx", F.row_number().over(w.orderBy(x, "vault"))).withColumn("ry", F.row_number().over(w.orderBy(y, "vault"))).select(*keys, "vault", "rx", "ry")
    vaults = ranks.agg(F.max("rx")).first()[0] or 0

    def run(t: pa.Table, these: range) -> pa.Table:
        names, rx, ry = t.column("vault").to_pylist(), t.column("rx").to_numpy().astype(float), t.column("ry").to_numpy().astype(float)
        own = [t.column(k).slice(0, 1) for k in keys]
        if len(names) < 2:
            return pa.table([*own, pa.array([None], pa.float64()), pa.array([0]), pa.array([0])], names=[*keys, "rho", "reached", "n"])
        # a shuffled rank is the rank of y of the vault in that place, which are the numbers 1..n
        centred, norm = rx - rx.mean(), ((rx - rx.mean()) ** 2).sum()
        rho, reached = float(centred @ ry / norm), 0
        place = np.empty(len(names))
        for rep in these:
            place[sorted(range(len(names)), key=lambda i: (_digest(seed, rep, names[i]), names[i]))] = np.arange(1, len(names) + 1)
            reached += abs(centred @ place / norm) >= abs(rho) - 1e-9
        return pa.table([*own, pa.array([rho]), pa.array([reached]), pa.array([len(these)])], names=[*keys, "rho", "reached", "n"])

    part = _in_blocks(ranks, list(keys), vaults, reps, run, ", ".join(f"{k} string" for k in keys) + ", rho double, reached long, n long")
    return part.groupBy(*keys).agg(F.first("rho").alias("rho"), F.try_divide(F.sum("reached"), F.sum("n")).alias("p"))

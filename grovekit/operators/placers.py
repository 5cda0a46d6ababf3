"""Predictors of the folder that a note goes to. Votes that tie go to the folder whose first note ranks earlier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import bucket, parse_key
from ..functions.vectors import dot, unit
from .retrieval import bm25_scores, top_k

K_GRID = (1, 3, 5, 8, 12)
#: Places where sums of one folder are added up before they come together.
SPREAD = 64


def support(train: DataFrame, scope: str = "vault", folder: str = "path_key") -> DataFrame:
    """Notes of each folder, and the first of them."""
    return train.groupBy(scope, folder).agg(F.count(F.lit(1)).alias("support"), F.min("ord").alias("first_ord"))


def majority(train: DataFrame, scope: str = "vault", folder: str = "path_key") -> DataFrame:
    """scope, pred: the folder with the most notes; of equal ones the first seen."""
    s = support(train, scope, folder)
    return s.groupBy(scope).agg(F.max_by(folder, F.struct("support", -F.col("first_ord"))).alias("pred"))


def vote(ranked: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """keys, pred, top_score: the folder with the largest sum of scores among ranked rows."""
    sums = ranked.groupBy(*keys, folder).agg(F.sum("score").alias("_s"), F.min("rk").alias("_r"))
    return sums.groupBy(*keys).agg(F.max_by(folder, F.struct(F.round("_s", 9), -F.col("_r"))).alias("pred"), F.max(F.round("_s", 6)).alias("top_score"))


def bm25_vote(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Of notes that share a term; an item without any has no row here."""
    return vote(ranked.filter((F.col("rk") <= k) & (F.col("score") > 0)), ["vault", "id"], "doc_key")


def ranked_train(it: DataFrame, k: int) -> DataFrame:
    """The k best training notes of each item to place, by BM25, with their folder."""
    train, val = it.filter("split = 'train'"), it.filter("split = 'val'")
    scores = bm25_scores(train.select("vault", "id", "ord", "text"), val.select("vault", "id", "text"), k=k)
    return top_k(scores, ["vault", "id"], k).join(train.select("vault", F.col("id").alias("doc"), F.col("path_key").alias("doc_key")), ["vault", "doc"])


def knn_vote(ranked: DataFrame, grid: Sequence[int] = K_GRID, folder: str = "doc_folder") -> DataFrame:
    """vault, id, k, pred for each k: neighbours are ranked once."""
    each = ranked.withColumn("k", F.explode(F.array(*map(F.lit, grid)))).filter("rk <= k")
    return vote(each, ["vault", "id", "k"], folder).drop("top_score")


def centroids(train: DataFrame, folder: str = "folder") -> DataFrame:
    """vault, folder, vector: the mean of the folder's unit vectors, of unit length. Sums of whole vectors, one for each folder
    that a batch of rows has, are what is shuffled, and they are added up in batches again."""
    unit_rows = train.select(F.col("vault").cast("string").alias("vault"), F.col(folder).cast("string").alias("folder"), unit(F.col("vector"), 0.0, 1e-9).alias("vector"), F.lit(1).cast("long").alias("n"))
    schema = "vault string, folder string, vector array<double>, n long"

    def add(t: pa.Table | pa.RecordBatch) -> pa.Table:
        t = pa.table(t.columns, names=t.schema.names).combine_chunks()
        keys = t.select(["vault", "folder"]).append_column("i", pa.array(np.arange(t.num_rows))).group_by(["vault", "folder"]).aggregate([("i", "list"), ("i", "min")]).sort_by("i_min")
        rows = keys.column("i_list").combine_chunks()
        which = np.empty(t.num_rows, np.int64)
        which[rows.flatten().to_numpy()] = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
        vectors = t.column("vector").combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        total, n = np.zeros((len(rows), x.shape[1])), np.zeros(len(rows), np.int64)
        np.add.at(total, which, x)
        np.add.at(n, which, t.column("n").to_numpy())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), pa.array(total.ravel()))
        return pa.table([keys.column("vault"), keys.column("folder"), lists, pa.array(n)], names=["vault", "folder", "vector", "n"])

    def partial(batches):
        for b in batches:
            if b.num_rows:
                yield from add(b).to_batches()

    part = unit_rows.mapInArrow(partial, schema)
    # a large folder's sums are first added up in a few places
    part = part.withColumn("_at", F.spark_partition_id() % SPREAD)
    part = part.groupBy("vault", "folder", "_at").applyInArrow(add, schema).groupBy("vault", "folder").applyInArrow(add, schema)
    mean = F.transform("vector", lambda x: x / F.col("n"))
    return part.select("vault", F.col("folder").alias(folder), unit(mean, 0.0, 1e-9).alias("vector"))


def nearest_folder(folders: DataFrame, queries: DataFrame, folder: str = "folder") -> DataFrame:
    """vault, id, pred: the folder whose vector is nearest; of equal ones the first by name."""
    q = queries.select("vault", "id", unit(F.col("vector"), 0.0, 1e-9).alias("q"))
    pairs = q.join(folders.select("vault", folder, unit(F.col("vector"), 0.0, 1e-9).alias("v")), "vault").withColumn("score", F.round(dot(F.col("q"), F.col("v")), 9))
    w = Window.partitionBy("vault", "id").orderBy(F.col("score").desc(), F.col(folder))
    return pairs.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("vault", "id", F.col(folder).alias("pred"), "score")


def project_to_existing(preds: DataFrame, dirs: DataFrame, scope: str = "vault") -> DataFrame:
    """A predicted folder that does not exist becomes the existing one with the longest common prefix; then the
    closest in depth, the shallower, the first by key."""
    # an index of prefixes: for each beginning of an existing folder, and each size, the best folder that has it
    segments = lambda c: parse_key(F.col(c))
    index = dirs.select(scope, F.col("path_key").alias("_dir")).distinct().withColumn("_a", segments("_dir")).withColumn("_size", F.size("_a"))
    index = index.withColumn("_p", F.explode(_beginnings(F.col("_a")))).groupBy(scope, "_p", "_size").agg(F.min("_dir").alias("_dir"))
    # each prediction asks for its own beginnings; no pair of a prediction and a folder is made that shares none but the root
    asked = preds.select(scope, "pred").distinct().withColumn("_a", segments("pred")).withColumn("_depth", F.size("_a")).withColumn("_p", F.explode(_beginnings(F.col("_a"))))
    near = asked.join(index, [scope, "_p"])
    best = near.groupBy(scope, "pred").agg(F.min_by("_dir", F.struct(F.col("pred") != F.col("_dir"), -F.size("_p"), F.abs(F.col("_depth") - F.col("_size")), F.col("_size"), F.col("_dir"))).alias("projected"))
    return preds.join(best, [scope, "pred"], "left")


def _beginnings(segments: Column) -> Column:
    """All beginnings of a list, the empty one and the whole included."""
    return F.transform(F.sequence(F.lit(0), F.size(segments)), lambda n: F.slice(segments, 1, n))


def verdicts(it: DataFrame) -> DataFrame:
    """vault, id, gold, support, arm, pred for the arms majority, bm25 (vote of five) and first (best note's folder).

    An arm that has no folder to offer predicts "/" (the vote and the majority) or nothing (first: null).
    """
    train, val = it.filter("split = 'train'"), it.filter("split = 'val'").select("vault", "id", "path_key")
    ranked = ranked_train(it, 5)
    base = val.join(support(train).select("vault", "path_key", "support"), ["vault", "path_key"], "left").select("vault", "id", F.col("path_key").alias("gold"), F.coalesce("support", F.lit(0)).alias("support"))
    votes = ranked.groupBy("vault", "id", "doc_key").agg(F.sum("score").alias("_s"), F.min("rk").alias("_r"))
    both = votes.groupBy("vault", "id").agg(F.max_by("doc_key", F.struct(F.round("_s", 9), -F.col("_r"))).alias("bm25"), F.min_by("doc_key", "_r").alias("first"))
    wide = base.join(both, ["vault", "id"], "left").join(majority(train), "vault", "left")
    slash = lambda c: F.coalesce(F.col(c), F.lit("/"))
    arm = F.explode(F.array(F.struct(F.lit("majority").alias("arm"), slash("pred").alias("p")), F.struct(F.lit("bm25").alias("arm"), slash("bm25").alias("p")), F.struct(F.lit("first").alias("arm"), F.col("first").alias("p"))))
    return wide.withColumn("_a", arm).select("vault", "id", "gold", "support", F.col("_a.arm").alias("arm"), F.col("_a.p").alias("pred"))


def with_soft(v: DataFrame) -> DataFrame:
    """Verdicts with exact, bucket of the gold folder and relation; a prediction that is missing has a null verdict."""
    from ..functions.paths import soft_relation

    rel = soft_relation(parse_key(F.col("gold")), parse_key(F.col("pred")))
    return v.withColumn("exact", F.col("pred") == F.col("gold")).withColumn("bucket", bucket(F.col("support"))).withColumn("relation", rel)


def flat_placer(tasks: DataFrame, dirs: DataFrame, ask: Callable[[list[str]], list[str]]) -> DataFrame:
    """vault, id, gold, pred, parsed, picker_error: a model is shown a note and all folders of its vault, and names one.

    tasks: vault, id, text, path_key; dirs: vault, path_key. A reply that names no path gives no prediction (null), which
    counts as wrong: ``parsed`` tells. A vault's folders are gathered once and joined to its tasks.
    """
    from ..functions.paths import path_key
    from ..functions.text import parse_path_json
    from .pickers import with_picker

    listed = dirs.groupBy("vault").agg(F.array_sort(F.collect_set("path_key")).alias("folders"))
    prompt = F.to_json(F.struct(F.col("id").alias("task"), F.col("text").alias("fact_text"), F.col("folders").alias("existing_dirs")))
    asked = with_picker(tasks.join(listed, "vault").select("vault", "id", F.col("path_key").alias("gold"), prompt.alias("prompt")), ask)
    path = parse_path_json(F.col("raw"))
    return asked.select("vault", "id", "gold", path_key(path).alias("pred"), path.isNotNull().alias("parsed"), "picker_error")

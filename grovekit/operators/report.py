"""Text renderings: folder trees, fixed-width tables, training dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key, path_prefixes


def tree_lines(notes: DataFrame) -> DataFrame:
    """sort_key, line: folders by name and notes below them (invalid ones marked), in the order of a depth-first walk."""
    dirs = notes.select(F.explode(path_prefixes(F.col("path"))).alias("p")).distinct()
    folder = dirs.select(F.concat(path_key(F.col("p")), F.lit("/")).alias("sort_key"), F.concat(F.repeat(F.lit("  "), F.size("p") - 1), F.element_at("p", -1), F.lit("/")).alias("line"))
    mark = F.when(F.col("valid"), F.lit("- ")).otherwise(F.lit("× "))
    note = notes.select(F.concat(path_key(F.col("path")), F.lit("/"), F.lit("￿"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("sort_key"), F.concat(F.repeat(F.lit("  "), F.size("path")), mark, F.col("id").cast("string")).alias("line"))
    return folder.unionByName(note)


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """line: columns padded to their widths, numbers with four places."""
    cells = []
    for c, w in widths.items():
        text = F.format_string("%.4f", F.col(c)) if dict(df.dtypes)[c] == "double" else F.col(c).cast("string")
        cells.append(F.rpad(F.coalesce(text, F.lit("-")), w, " "))
    return df.select(F.rtrim(F.concat_ws(" ", *cells)).alias("line"))


def sft_rows(tasks: DataFrame, dirs: DataFrame, system: str) -> DataFrame:
    """vault, id, messages: system, user (the note and the vault's folders, as JSON), assistant (the folder, as JSON).

    A vault's folders are gathered once and joined to its tasks.
    """
    listed = dirs.groupBy("vault").agg(F.array_sort(F.collect_set("path_key")).alias("folders"))
    t = tasks.join(listed, "vault")
    user = F.to_json(F.struct(F.col("text").alias("note"), F.col("folders").alias("folders")))
    answer = F.to_json(F.struct(F.col("path").alias("path")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return t.select("vault", "id", F.array(message("system", F.lit(system)), message("user", user), message("assistant", answer)).alias("messages"))


def pooled_sft(tasks: DataFrame, dirs: DataFrame, system: str) -> DataFrame:
    """vault, id, split, messages, meta: training dialogues of all vaults in one table, each rendered with the folders, roots
    and depth of its own vault.

    tasks: vault, id, split, kind, text, path; dirs: vault, path, and the vault's folders are gathered once. ``system`` may
    hold {roots} and {max_depth}. meta: id, vault, gold_path, root.
    """
    own = dirs.groupBy("vault").agg(F.array_sort(F.collect_set(path_key(F.col("path")))).alias("folders"), F.array_sort(F.collect_set(F.get("path", F.lit(0)))).alias("roots"), F.max(F.size("path")).alias("max_depth"))
    t = tasks.join(own, "vault")
    intro = F.replace(F.replace(F.lit(system), F.lit("{roots}"), F.to_json("roots")), F.lit("{max_depth}"), F.col("max_depth").cast("string"))
    user = F.concat(F.to_json(F.struct(F.col("kind").alias("task"), F.col("text").alias("fact_text"), F.col("folders").alias("existing_dirs"))), F.lit("\n\nChoose the destination path. JSON only."))
    answer = F.to_json(F.struct(F.col("path").alias("path"), F.lit(0.9).alias("confidence")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    meta = F.struct("id", "vault", F.col("path").alias("gold_path"), F.get("path", F.lit(0)).alias("root"))
    return t.select("vault", "id", "split", F.array(message("system", intro), message("user", user), message("assistant", answer)).alias("messages"), meta.alias("meta"))


def place_gold(tasks: DataFrame) -> DataFrame:
    """Operations that put the notes of placement tasks where they belong: the folder is made, then the note added.

    tasks: ord, id, text, gold_path and fact_id, if there is one.
    """
    fact = F.coalesce(F.col("fact_id"), F.concat(F.lit("f_"), F.col("id").cast("string"))) if "fact_id" in tasks.columns else F.concat(F.lit("f_"), F.col("id").cast("string"))
    each = tasks.withColumn("fact_id", fact).withColumn("o", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("MKDIR").alias("op")), F.struct(F.lit(1).alias("k"), F.lit("ADD").alias("op")))))
    add = F.col("o.op") == "ADD"
    return each.select((2 * F.col("ord") + F.col("o.k")).alias("seq"), F.col("o.op").alias("op"), F.when(add, F.col("fact_id")).alias("fact_id"), F.when(add, F.col("text")).alias("text"), F.col("gold_path").alias("path"), F.lit(None).cast("string").alias("project"), F.lit(False).alias("hard"))

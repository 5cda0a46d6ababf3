"""Corpus preparation: copies, filters, splits, selections and samples. All choices are made by hash, so they repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import order_key
from ..sources.scratch import Scratch
from .ranks import ranked


def drop_copies(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text no other row has: every copy of a repeated text goes. Copies are combined before the shuffle."""
    rest = [c for c in df.columns if c != text]
    one = df.groupBy(text).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    return one.filter("_n = 1").select(*df.columns)


def n_validation(n: Column, fraction: float) -> Column:
    """Items of a group of n that go to validation: none of fewer than 3, else one at least; halves round to even."""
    return F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("long"))).otherwise(F.lit(0))


def item_split(df: DataFrame, group: Sequence[str], item: str, fraction: float, seed: int) -> DataFrame:
    """Adds split (train, val), drawn within each group."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(order_key(seed, F.col(item)), F.col(item))))
    return ranked.withColumn("split", F.when(F.col("_r") <= n_validation(F.col("_n"), fraction), F.lit("val")).otherwise(F.lit("train"))).drop("_n", "_r")


def folder_split(df: DataFrame, vault: str, folder: str, fraction: float, seed: int) -> DataFrame:
    """Adds split so that no folder is in both parts: folders, in hash order, go to validation while the items there are
    fewer than the share asked for."""
    sizes = df.groupBy(vault, folder).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(vault).orderBy(order_key(seed, F.col(vault), F.col(folder)), F.col(folder))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(vault))
    part = sizes.withColumn("split", F.when(before < total * F.lit(fraction), F.lit("val")).otherwise(F.lit("train"))).drop("_n")
    return df.join(part, [vault, folder])


def split_metadata(it: DataFrame) -> DataFrame:
    """Per vault: folders, folders of one note, share of the largest, items by part, validation items in seen folders."""
    sizes = it.groupBy("vault", "path_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("tr"), F.count_if(F.col("split") == "val").alias("va"))
    return sizes.groupBy("vault").agg(
        F.count(F.lit(1)).alias("n_dirs"), F.count_if(F.col("n") == 1).alias("singleton_dirs"), (F.max("n") / F.sum("n")).alias("majority_share"),
        F.sum("tr").alias("n_train"), F.sum("va").alias("n_val"), F.sum(F.when(F.col("tr") > 0, F.col("va")).otherwise(0)).alias("val_in_seen_folder"),
    )


def classify_repositories(files: DataFrame) -> DataFrame:
    """repo, n_files, n_code, manifests, md_in_docs_frac, is_software of a list of files (repo, path)."""
    from ..functions.text import DOC_ROOTS, is_code, is_manifest

    p = F.col("path")
    md = F.lower(p).rlike(r"\.(md|markdown)$")
    docs = md & F.lower(F.substring_index(p, "/", 1)).isin(*DOC_ROOTS)
    out = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(is_code(p)).alias("n_code"), F.array_sort(F.collect_set(F.when(is_manifest(p), F.lower(F.substring_index(p, "/", -1))))).alias("manifests"),
        F.bround(F.count_if(docs) / F.greatest(F.count_if(md), F.lit(1)), 3).alias("md_in_docs_frac"),
    )
    return out.withColumn("is_software", (F.size("manifests") > 0) | (F.col("n_code") > 30))


def reject_reason(software: Column, name: Column, n_notes: Column, has_marker: Column, least: int) -> Column:
    """Why a repository is no vault; null if it is one. Reasons rank in this order."""
    from ..functions.text import denied

    return F.when(software, F.lit("software")).when(denied(name).isNotNull(), F.lit("denylist")).when(n_notes < least, F.lit("too_few_notes")).when(~has_marker, F.lit("no_marker"))


def spread_sample(df: DataFrame, size: str, name: str, most: int) -> DataFrame:
    """``most`` rows spread evenly over the order of sizes: those at floor(i * n / most)."""
    spark, order = df.sparkSession, ranked(df, [size, name], name="_i")
    n = df.count()
    picks = spark.createDataFrame([(i * n // most + 1,) for i in range(most)] if n else [], "_i long").distinct()
    return order.join(F.broadcast(picks), "_i", "left_semi").drop("_i")


def capped_sample(df: DataFrame, plan: Sequence[tuple[str, int]], bucket: str, vault: str, item: str, cap: int, seed: int) -> DataFrame:
    """Adds the sample's order to rows drawn by bucket: in hash order, at most ``cap`` a vault over all buckets.

    Buckets follow one another, as what a vault gave to one counts for the next.
    """
    scratch = Scratch(df.sparkSession)
    names = [name for name, _ in plan]
    draw = order_key(seed, F.col(bucket), F.col(item))
    w = Window.partitionBy(vault, bucket).orderBy("_h", item)
    # no vault gives more than ``cap`` to a bucket, so the rounds run on few rows
    pool = scratch.save(df.filter(F.col(bucket).isin(*names)).withColumn("_h", draw).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap))
    taken = None
    for name, quota in plan:
        rows = pool.filter(F.col(bucket) == name)
        if taken is not None:
            rows = rows.join(taken.groupBy(vault).agg(F.count(F.lit(1)).alias("_used")), vault, "left").filter(F.col("_r") <= F.lit(cap) - F.coalesce("_used", F.lit(0)))
        part = scratch.save(rows.orderBy("_h", item).limit(quota).select(*df.columns))
        taken = part if taken is None else taken.unionByName(part)
    return taken


def pinned_sample(df: DataFrame, pinned: DataFrame, item: str, n: int, seed: int) -> DataFrame:
    """The pinned items and others in hash order, n together (or all pinned ones, if more)."""
    marked = df.join(pinned.select(item).distinct().withColumn("_p", F.lit(True)), item, "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    first = marked.filter("_p").drop("_p")
    rest = marked.filter("NOT _p").drop("_p").orderBy(order_key(seed, F.col(item)), item)
    return first.unionByName(rest.limit(max(0, n - first.count())))


def class_sample(df: DataFrame, label: str, item: str, n: int, seed: int) -> DataFrame:
    """n rows of each class, in hash order."""
    w = Window.partitionBy(label).orderBy(order_key(seed, F.col(item)), item)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def text_leaks(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """How many distinct texts both have."""
    return a.select(text).intersect(b.select(text)).agg(F.count(F.lit(1)).alias("n_leaked"))


#: What a synthetic tree has: tasks of life, of the dump, of their own, shared with twins in other trees; twins of
#: the same text within a tree; folders of topics.
LIFE, DUMP, OWN, SHARED, SAME, TOPICS = ("health", "family"), 1, 15, 12, 4, ("budget", "results", "meeting", "ideas", "plans")


def synthetic_trees(trees: DataFrame, tree: str) -> DataFrame:
    """tree, kind (dir, fact, task, query), id, path_key, text, twin_key, gold, n_distractors, for each name in column ``tree``.

    A tree has 11 folders; 34 notes: 30 of them are placed by tasks, and 4 say the same as one of those in another folder; and
    16 queries: 12 for a note whose twins in all other trees differ by the tree's name alone (the distractors), and 4 whose
    gold are both notes of the same text. Trees are exploded by templates of a fixed number, so nothing is joined.
    """
    t, name = F.col("t"), F.col("tree")
    topic = lambda i: F.element_at(F.array(*map(F.lit, TOPICS)), (i % len(TOPICS) + 1).cast("int"))
    each = lambda n: trees.select(F.col(tree).alias("tree")).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    home = F.concat(F.lit("/work/"), name)
    own_from, shared_from, same_from = len(LIFE) + DUMP, len(LIFE) + DUMP + OWN, len(LIFE) + DUMP + OWN + SHARED
    ident = lambda i: F.concat(name, F.lit(":"), i.cast("string"))
    shared = lambda i: F.concat(F.lit("Point "), i.cast("string"), F.lit(" on "), topic(i), F.lit(" of "), name)
    i = t - F.when(t < own_from, 0).when(t < shared_from, own_from).when(t < same_from, shared_from).otherwise(same_from)
    life = F.element_at(F.array(*map(F.lit, LIFE)), F.least(t + 1, F.lit(len(LIFE))).cast("int"))
    path = F.when(t < len(LIFE), F.concat(F.lit("/personal/"), life)).when(t < own_from, "/inbox").when(t < same_from, F.concat(home, F.lit("/"), topic(i))).otherwise(F.concat(home, F.lit("/"), topic(i + 1)))
    text = (
        F.when(t < len(LIFE), F.concat(F.lit("My "), life)).when(t < own_from, F.concat(F.lit("Unsorted of "), name))
        .when(t < shared_from, F.concat(F.lit("Only here: "), i.cast("string"), F.lit(" of "), name)).otherwise(shared(i))
    )
    twin = F.when(t >= shared_from, F.concat(F.lit("twin"), i.cast("string")))
    facts = each(same_from + SAME).select(name, F.lit("fact").alias("kind"), ident(t).alias("id"), path.alias("path_key"), text.alias("text"), twin.alias("twin_key"))
    tasks = facts.filter(F.substring_index("id", ":", -1).cast("int") < same_from).withColumns({"kind": F.lit("task"), "id": F.concat(F.lit("task_"), F.substring(F.sha1(F.col("id").cast("binary")), 1, 10)), "gold": F.col("path_key")})
    names = ["/personal", "/personal/health", "/personal/family", "/inbox", "/work", ""] + [f"/{x}" for x in TOPICS]
    folder = F.element_at(F.array(*map(F.lit, names)), t + 1)
    folder = F.when(t < 5, folder).otherwise(F.concat(home, folder))
    dirs = each(len(names)).select(name, F.lit("dir").alias("kind"), F.concat(name, folder).alias("id"), folder.alias("path_key"))
    q = t - F.when(t < SHARED, 0).otherwise(SHARED)
    first, second = ident(q + shared_from), ident(q + same_from)
    asked = each(SHARED + SAME).crossJoin(F.broadcast(trees.agg(F.count_distinct(tree).alias("n"))))  # one row
    asked = asked.select(
        name, F.lit("query").alias("kind"), F.concat(name, F.lit("?"), t.cast("string")).alias("id"), F.concat(F.lit("What of "), F.lower(shared(q)), F.lit("?")).alias("text"), F.concat(F.lit("twin"), q.cast("string")).alias("twin_key"),
        F.when(t >= SHARED, F.concat(first, F.lit(","), second)).when(t < SAME, F.concat(first, F.lit(","), second)).otherwise(first).alias("gold"), F.when(t < SHARED, F.col("n") - 1).otherwise(0).alias("n_distractors"),
    )
    out = facts
    for part in (tasks, dirs, asked):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


#: The notes and queries of a corpus of confusable projects.
GLOBALS, PROJECTS, TEMPLATES = 8, 8, 12
QUERIES = (("project", 64), ("global", 5), ("mixed", 6), ("adversarial", 3), ("identity", 1))


def confusable_corpora(df: DataFrame, corpus: str) -> DataFrame:
    """corpus, kind (fact, or the kind of a query), id, project, text, gold, distractors, for each value of column ``corpus``.

    104 notes: 8 of no project, and in each of 8 projects the same 12 claims with values of its own (the last one with the same
    value in all). 79 queries, each with the ids of its gold notes and of those that mislead: 64 ask a project for a claim
    (misled by the other projects'), 5 for a note of no project, 6 for both, 3 deny what the next projects say, 1 asks for a
    note that another project has word for word.
    """
    c, t = F.col("c"), F.col("t")
    each = lambda n: df.select(F.col(corpus).cast("string").alias("c")).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    note = lambda p, i: F.concat(c, F.lit(":"), p.cast("string"), F.lit(":"), i.cast("string"))
    world = lambda i: F.concat(c, F.lit(":g:"), i.cast("string"))
    div = lambda x, n: F.floor(x / n).cast("int")
    p, k = div(t - GLOBALS, TEMPLATES), (t - GLOBALS) % TEMPLATES
    value = F.when(k == TEMPLATES - 1, F.lit(0)).otherwise((p * 13 + k * 7) % 10)
    facts = each(GLOBALS + PROJECTS * TEMPLATES).select(
        c.alias("corpus"), F.lit("fact").alias("kind"), F.when(t < GLOBALS, world(t)).otherwise(note(p, k)).alias("id"), F.when(t >= GLOBALS, F.concat(F.lit("p"), p.cast("string"))).alias("project"),
        F.when(t < GLOBALS, F.concat(F.lit("Rule "), t.cast("string"))).otherwise(F.concat(F.lit("Setting "), k.cast("string"), F.lit(" is "), value.cast("string"))).alias("text"),
    )
    edges, at = {}, 0
    for kind, n in QUERIES:
        edges[kind] = (at, at + n)
        at += n
    kind = F.coalesce(*[F.when(t < b, F.lit(x)) for x, (_, b) in edges.items()])
    i = t - F.coalesce(*[F.when(t < b, F.lit(a)) for a, b in edges.values()])
    qp = F.when(kind == "project", div(i, 8)).when(kind.isin("mixed", "adversarial"), i).when(kind == "identity", F.lit(0))
    qk = F.when(kind == "project", i % 8).when(kind == "mixed", F.lit(8)).when(kind == "adversarial", F.lit(9)).when(kind == "identity", F.lit(TEMPLATES - 1))
    others = lambda keep, number: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(PROJECTS - 1)), keep), lambda x: note(x, number)), ",")
    wrong = (
        F.when(kind.isin("project", "mixed"), others(lambda x: x != qp, qk)).when(kind == "global", others(lambda x: x >= 0, i))
        .when(kind == "adversarial", others(lambda x: (x > qp) & (x <= qp + 2), qk)).otherwise(others(lambda x: x == 1, qk))
    )
    gold = F.when(kind == "global", world(i)).when(kind == "mixed", F.concat(note(qp, qk), F.lit(","), world(i))).otherwise(note(qp, qk))
    asks = F.when(kind == "global", F.concat(F.lit("Which is rule "), i.cast("string"), F.lit("?"))).otherwise(F.concat(F.when(kind == "adversarial", F.lit("It is not so elsewhere: what is setting ")).otherwise(F.lit("What is setting ")), qk.cast("string"), F.lit("?")))
    asked = each(at).select(c.alias("corpus"), kind.alias("kind"), F.concat(c, F.lit("?"), t.cast("string")).alias("id"), F.concat(F.lit("p"), qp.cast("string")).alias("project"), asks.alias("text"), gold.alias("gold"), wrong.alias("distractors"))
    return facts.unionByName(asked, allowMissingColumns=True)

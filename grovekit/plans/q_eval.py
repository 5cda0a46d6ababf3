"""Queries that measure: accuracy, recall, resampling, statistics, agreement, joins and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import branch_ok, lcp_len, parse_key, soft_hit
from ..operators import agreement, metrics, placers, ranks, report, resampling, retrieval
from .q_retrieval import SQL as RETRIEVAL_SQL
from .q_retrieval import _VR, KEYS, _note_ranks, _vec_scores, f3_knn_grid, f8_cascade, f9_project
from .views import arms, held, items, notes, table, vec_items, with_views

#: Replicates of the resampling queries.
REPS = 10_000


def _v(spark, sf):
    return placers.with_soft(arms(spark, sf))


def i2_occupancy(spark, sf):
    return metrics.occupancy_table(_v(spark, sf))


def i3_by_kind(spark, sf):
    """By language, and over all."""
    v = _v(spark, sf).withColumn("kind", F.get(parse_key(F.col("gold")), F.lit(0)))
    return metrics.rollup_all(v, "kind", F.count(F.lit(1)).alias("n"), F.round(metrics.share(F.col("exact")), 6).alias("exact"))


def i4_summary(spark, sf):
    v = _v(spark, sf)
    g, p = parse_key(F.col("gold")), parse_key(F.coalesce("pred", F.lit("/")))
    lcp = lcp_len(g, p) / F.greatest(F.size(g), F.size(p), F.lit(1))
    return v.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(metrics.share(F.col("exact")), 6).alias("path_exact"), F.round(metrics.share(soft_hit(F.col("relation"))), 6).alias("path_soft"),
        F.round(metrics.share(branch_ok(g, p)), 6).alias("branch_ok"), F.count_if(F.col("pred").isNull()).alias("no_answer"), F.round(F.avg(lcp), 6).alias("lcp_ratio"), F.count_if(F.col("relation") == "pred_prefix").alias("n_pred_prefix"),
    )


def i5_conditional(spark, sf):
    c = f8_cascade(spark, sf)
    hit = F.col("pred") == F.col("gold")
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(metrics.share(F.col("gold_in_shortlist")), 6).alias("candidate_recall"), F.round(metrics.share(hit), 6).alias("exact"), F.round(F.avg(F.when(F.col("gold_in_shortlist"), hit.cast("double"))), 6).alias("exact_given_recall"))


def i6_recall_grid(spark, sf):
    r = _note_ranks(spark, sf, 40)
    from pyspark.sql import Window

    first = r.groupBy(*KEYS, "doc_folder").agg(F.min("rk").alias("rk")).withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS).orderBy("rk", "doc_folder")))
    v = vec_items(spark, sf).filter("split = 'val'").select(*KEYS, F.col("folder").alias("doc_folder"))
    found = v.join(first, [*KEYS, "doc_folder"], "left").withColumn("n", F.explode(F.array(*map(F.lit, (1, 3, 5)))))
    return found.groupBy("n").agg(F.round(F.avg(F.coalesce((F.col("pos") <= F.col("n")) & (F.col("rk") <= 8 * F.col("n")), F.lit(False)).cast("double")), 6).alias("recall")).select(F.lit("note").alias("mode"), "n", "recall")


def i7_pooled(spark, sf):
    h = metrics.vault_hits(_v(spark, sf)).withColumn("rate", F.try_divide("h", "n"))
    return h.groupBy("arm").agg(F.round(metrics.pooled(h, "rate", "n"), 6).alias("pooled"), F.round(metrics.pooled(h, "rate", "n", True), 4).alias("pooled_rounded"))


def i8_retrieval_quality(spark, sf):
    """Of the five nearest: the share of the gold folder's notes that are found, and whether a note of the next folder intrudes."""
    top = retrieval.top_k(_vec_scores(spark, sf, 5), KEYS, 5)
    it = vec_items(spark, sf)
    gold = it.filter("split = 'train'").groupBy("vault", "folder").agg(F.count(F.lit(1)).alias("n_gold"))
    q = it.filter("split = 'val'").select(*KEYS, "folder").join(gold, ["vault", "folder"], "left")
    twin = F.concat(F.lit("/f"), ((F.substring("folder", 3, 1).cast("int") + 1) % 10).cast("string"))
    hits = q.join(top.select(*KEYS, "doc_folder"), KEYS, "left").groupBy(*KEYS, "n_gold").agg(F.count_if(F.col("doc_folder") == F.col("folder")).alias("got"), F.bool_or(F.col("doc_folder") == twin).alias("twin"))
    return hits.groupBy("vault").agg(F.round(F.avg(F.coalesce(F.try_divide("got", "n_gold"), F.lit(0.0))), 6).alias("recall"), F.round(metrics.share(F.col("twin")), 6).alias("twin_intrusion"))


def i9_percentiles(spark, sf):
    e = table(spark, sf, "events")
    p = ranks.percentiles(e, "event_type", "value", (0.5, 0.95)).groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 6).alias(n) for s, n in ((0.5, "p50"), (0.95, "p95"))])
    return p.join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 3).alias("total")), "event_type")


def i10_per_vault(spark, sf):
    return metrics.vault_hits(_v(spark, sf))


def i11_worst_margin(spark, sf):
    """The eight vaults where the vote loses most to the best note, in folders of three notes and more."""
    h = _v(spark, sf).filter("bucket IN ('3-9', '10+')").groupBy("vault").agg((metrics.share(F.when(F.col("arm") == "bm25", F.col("exact"))) - metrics.share(F.when(F.col("arm") == "first", F.col("exact")))).alias("m"))
    return h.filter("m IS NOT NULL").orderBy(F.round("m", 9), "vault").limit(8).select("vault", F.round("m", 6).alias("margin"))


def i12_failure_mode(spark, sf):
    v = _v(spark, sf).filter("relation <> 'none'")
    return v.groupBy("arm", "bucket").agg(F.round(metrics.share(F.col("relation") == "pred_prefix"), 6).alias("pred_prefix_share"))


def i13_distinct(spark, sf):
    return notes(spark, sf).agg(F.countDistinct("vault").alias("vaults"), F.countDistinct("vault", "path_key").alias("folders"), F.countDistinct("text").alias("texts"), F.countDistinct(F.element_at("path", -1)).alias("leaves"))


def i15_tokens(spark, sf):
    from ..functions.text import token_estimate

    return items(spark, sf).groupBy("vault", "split").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def _buckets(v):
    return v.filter("bucket <> '0'").unionByName(v.withColumn("bucket", F.lit("all")))


def m1_bootstrap(spark, sf):
    h = _buckets(metrics.vault_hits(_v(spark, sf), "bucket").select("vault", "arm", "bucket", "h", "n")).groupBy("bucket", "vault", "arm").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
    r = resampling.bootstrap(held(h), REPS)
    return r.select("bucket", "arm", *[F.round(c, 6).alias(c) for c in ("acc", "low", "high")])


def _paired(spark, sf):
    v = _v(spark, sf)
    one = v.groupBy("vault", "id", "bucket").agg(*[F.max(F.when(F.col("arm") == a, F.col("exact").cast("int"))).alias(n) for a, n in (("bm25", "a"), ("first", "b"))]).filter("a IS NOT NULL AND b IS NOT NULL")
    return _buckets(one.groupBy("bucket", "vault").agg(F.sum("a").alias("ha"), F.sum("b").alias("hb"), F.count(F.lit(1)).alias("n"))).groupBy("bucket", "vault").agg(F.sum("ha").alias("ha"), F.sum("hb").alias("hb"), F.sum("n").alias("n"))


def m2_paired(spark, sf):
    return resampling.paired_bootstrap(held(_paired(spark, sf)), REPS).select("bucket", "n_vaults", *[F.round(c, 6).alias(c) for c in ("diff", "low", "high")])


def m3_crossing(spark, sf):
    c = metrics.crossing(_v(spark, sf), "first", "majority")
    up, down = F.col("sparse") > 0, F.col("dense") < 0
    return c.agg(F.count_if(F.col("sparse").isNotNull() & F.col("dense").isNotNull()).alias("both"), F.count_if(up).alias("sparse_up"), F.count_if(down).alias("dense_down"), F.count_if(up & down).alias("crossings"), F.count_if((F.col("sparse") < 0) & (F.col("dense") > 0)).alias("reverse"))


def m4_nested_k(spark, sf):
    gold = vec_items(spark, sf).filter("split = 'val'").select(*KEYS, "folder")
    hits = f3_knn_grid(spark, sf).join(gold, KEYS).groupBy("vault", "k").agg(F.count_if(F.col("pred") == F.col("folder")).alias("h"), F.count(F.lit(1)).alias("n"))
    return metrics.nested_choice(hits)


def m5_exclusion(spark, sf):
    return metrics.occupancy_table(metrics.exclude(_v(spark, sf), metrics.OUTLIERS))


def _descriptors(n):
    sizes = n.groupBy("vault", "path_key").agg(F.count(F.lit(1)).alias("c"), F.max(F.size("path")).alias("depth"))
    d = sizes.groupBy("vault").agg(F.log(F.count(F.lit(1))).alias("ln_dirs"), F.max("depth").cast("double").alias("max_depth"), F.avg("c").alias("mean_notes"), (F.max("c") / F.sum("c")).alias("top_share"))
    return d.join(agreement.gini(sizes, "vault", "c"), "vault")


def n2_descriptors(spark, sf):
    return _descriptors(items(spark, sf)).select("vault", *[F.round(c, 6).alias(c) for c in ("ln_dirs", "max_depth", "mean_notes", "top_share", "gini")])


def _margins(v):
    acc = lambda a: metrics.share(F.when(F.col("arm") == a, F.col("exact")))
    return v.groupBy("vault").agg((acc("bm25") - acc("majority")).alias("vote_majority"), (acc("first") - acc("bm25")).alias("first_vote"), (acc("first") - acc("majority")).alias("first_majority"))


def _structure(spark, sf):
    """Descriptors and margins of each vault; a written table of a row each."""
    it = items(spark, sf)
    return held(_descriptors(it).join(_margins(placers.with_soft(arms(spark, sf, it))), "vault"))


def n1_spearman(spark, sf):
    d = _structure(spark, sf).select("vault", F.round("ln_dirs", 9).alias("x"), F.round("vote_majority", 9).alias("y"), F.lit("ln_dirs").alias("descriptor"))
    return resampling.rank_correlation(held(d), ("descriptor",), "x", "y", REPS).select("descriptor", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))


def n3_structure(spark, sf):
    """Every margin against every descriptor."""
    d = _structure(spark, sf)
    long = d.unpivot(["vault", "vote_majority", "first_vote", "first_majority"], ["ln_dirs", "max_depth", "mean_notes", "top_share", "gini"], "descriptor", "x")
    long = long.unpivot(["vault", "descriptor", "x"], ["vote_majority", "first_vote", "first_majority"], "margin", "y").withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    return resampling.rank_correlation(held(long), ("margin", "descriptor"), "x", "y", REPS).select("margin", "descriptor", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))


def n4_kappa(spark, sf):
    k = agreement.kappa(table(spark, sf, "labels"), "quality", "toxic")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("po", "pe", "kappa", "pabak")])


def n5_wilson(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = agreement.wilson(F.col("k"), F.col("n"))
    return d.select("source", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def n6_agreement(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return metrics.rollup_all(d, "lang", F.count(F.lit(1)).alias("n"), F.round(metrics.share(F.col("quality") == F.col("toxic")), 6).alias("agree"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("only_first"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("only_second"))


def n7_lenient(spark, sf):
    v = held(_v(spark, sf))
    acc = v.groupBy("arm").agg(metrics.share(F.col("exact")).alias("acc"))
    wrong = v.filter("NOT exact").groupBy("arm", "bucket").agg(F.count(F.lit(1)).alias("wrong"))
    judged = v.filter("NOT exact AND arm = 'bm25'").join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    return agreement.lenient(acc, wrong, judged.select("bucket", F.col("quality").cast("double").alias("sensible"))).select("arm", F.round("lenient", 6).alias("lenient"))


def n8_class_errors(spark, sf):
    """Each annotator's rate by class, and that of items they agree on."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "quality", "toxic")
    views = d.select("lang", F.lit("first").alias("view"), F.col("quality").alias("x")).unionByName(d.select("lang", F.lit("second").alias("view"), F.col("toxic").alias("x"))).unionByName(d.filter("quality = toxic").select("lang", F.lit("agreed").alias("view"), F.col("quality").alias("x")))
    return views.groupBy("view", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 - F.col("x")), 6).alias("error"))


def n9_mcnemar(spark, sf):
    v = _v(spark, sf).groupBy("vault", "id").agg(*[F.bool_or(F.when(F.col("arm") == a, F.coalesce("exact", F.lit(False)))).alias(n) for a, n in (("bm25", "x"), ("first", "y"))])
    return agreement.mcnemar(v, "x", "y").select("b", "c", F.round("p", 6).alias("p"))


def n10_pabak(spark, sf):
    d = table(spark, sf, "labels").agg(metrics.share(F.col("quality") == F.col("toxic")).alias("po"))
    return d.select(F.round(agreement.pabak(F.col("po"), F.lit(4)), 6).alias("pabak"))


def n11_win_tie_loss(spark, sf):
    m = _margins(_v(spark, sf))
    d = F.round("first_vote", 9)
    return m.agg(F.count_if(d > 0).alias("win"), F.count_if(d == 0).alias("tie"), F.count_if(d < 0).alias("loss"))


def n12_valid_rate(spark, sf):
    """Predictions that name a folder that exists, how they fare, and too deep or too shallow ones."""
    it = items(spark, sf)
    p = f9_project(spark, sf).join(it.select("vault", "id", F.col("path_key").alias("gold")), KEYS).join(it.select("vault", F.col("path_key").alias("pred")).distinct().withColumn("known", F.lit(True)), ["vault", "pred"], "left")
    deeper = F.size(parse_key(F.col("pred"))) - F.size(parse_key(F.col("gold")))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("known", F.lit(False)).cast("double")), 6).alias("valid_rate"), F.round(F.avg(F.when(F.col("known"), (F.col("pred") == F.col("gold")).cast("double"))), 6).alias("exact_within_valid"), F.count_if(deeper > 0).alias("too_deep"), F.count_if(deeper < 0).alias("too_shallow"))


def h1_h2_predictions(spark, sf):
    """Items to place with their predictions: missing arms stay, as null."""
    it = items(spark, sf)
    val = it.filter("split = 'val'").select("vault", "id")
    arm = placers.with_soft(arms(spark, sf, it)).filter("arm = 'first' AND pred IS NOT NULL").select("vault", "id", "exact")
    inner = val.join(arm, KEYS).agg(F.count(F.lit(1)).alias("n_inner"))
    return inner.crossJoin(val.join(arm, KEYS, "left").agg(F.count(F.lit(1)).alias("n_left"), F.count_if(F.col("exact").isNull()).alias("n_missing")))


def h3_support(spark, sf):
    it = items(spark, sf)
    s = placers.support(it.filter("split = 'train'")).drop("first_ord")
    return it.filter("split = 'val'").join(s, ["vault", "path_key"], "left").select("vault", "id", F.coalesce("support", F.lit(0)).alias("support"))


def h4_h5_seen(spark, sf):
    """Validation items in seen folders (semi join) and in unseen ones (anti join)."""
    it = items(spark, sf)
    seen = it.filter("split = 'train'").select("vault", "path_key").distinct()
    val = it.filter("split = 'val'").select("vault", "path_key", "id")
    return val.join(seen, ["vault", "path_key"], "left_semi").select("id", F.lit("seen").alias("part")).unionByName(val.join(seen, ["vault", "path_key"], "left_anti").select("id", F.lit("unseen").alias("part")))


def h6_membership(spark, sf):
    """Whether the gold folder is among an item's nearest folders."""
    short = retrieval.folder_candidates(_note_ranks(spark, sf, 24), KEYS, "doc_folder", 3, 8).groupBy(*KEYS).agg(F.collect_set("doc_folder").alias("s"))
    v = vec_items(spark, sf).filter("split = 'val'").select(*KEYS, "folder").join(short, KEYS, "left")
    return v.select(*KEYS, F.coalesce(F.array_contains("s", F.col("folder")), F.lit(False)).alias("found"))


def h7_all_pairs(spark, sf):
    """All pairs within a vault: how many, and their best score."""
    it = vec_items(spark, sf)
    scores = retrieval.cosine_scores(it.filter("split = 'train'").select("id", "vault", "vector"), it.filter("split = 'val'").select("id", "vault", "vector"))
    return scores.groupBy("vault").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("worst"))


def h9_siblings(spark, sf):
    """Folders of one parent, by self join."""
    n = notes(spark, sf).select("path_key", F.slice("path", F.lit(1), F.size("path") - 1).alias("up")).distinct()
    return n.alias("a").join(n.alias("b"), F.col("a.up") == F.col("b.up")).filter("a.path_key < b.path_key").select(F.col("a.path_key").alias("a"), F.col("b.path_key").alias("b"))


def h10_cross(spark, sf):
    r = table(spark, sf, "region").select("r_name")
    return r.crossJoin(F.broadcast(spark.range(8).withColumnRenamed("id", "template"))).select("r_name", "template", F.md5(F.concat_ws("/", "r_name", F.col("template").cast("string")).cast("binary")).alias("key"))


def h11_paired(spark, sf):
    return _paired(spark, sf)


def h12_full_outer(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    a, b = l.groupBy(F.col("quality").alias("v")).agg(F.count(F.lit(1)).alias("na")), l.groupBy((F.col("toxic") * 2).alias("v")).agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, "v", "full_outer").select("v", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))


def j2_running_total(spark, sf):
    """Notes before each folder, in key order."""
    from pyspark.sql import Window

    s = notes(spark, sf).groupBy("vault", "path_key").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("vault").orderBy("path_key").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("vault", "path_key", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def j3_ordinal_rank(spark, sf):
    """Customers by segment: within their nation, and over all."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    within = ranks.ranked(c, ["c_mktsegment", "c_custkey"], ["c_nationkey"])
    return ranks.ranked(within, ["c_mktsegment", "c_custkey"], name="overall").select("c_custkey", "rank", "overall")


def k1_sort_limit(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def l1_set_ops(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n")
    return count(c.union(s).distinct(), "union").unionByName(count(c.intersect(s), "intersect")).unionByName(count(c.subtract(s), "except")).unionByName(count(c.exceptAll(s), "except_all"))


def l2_ordered_dedup(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))


def o1_ascii_tree(spark, sf):
    return report.tree_lines(notes(spark, sf).select("id", "path", (F.col("id") % 5 != 0).alias("valid")))


def o2_tree_groups(spark, sf):
    g = notes(spark, sf).groupBy("vault", "path_key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return g.select("vault", "path_key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def o3_project_counts(spark, sf):
    return notes(spark, sf).groupBy("vault").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "vault")


def o5_fixed_width(spark, sf):
    return report.fixed_width(i2_occupancy(spark, sf), {"arm": 10, "bucket": 6, "n": 6, "accuracy": 8})


def o6_rescore(spark, sf):
    """Predictions scored again, by relation."""
    v = _v(spark, sf)
    return v.groupBy("arm", "relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lcp_len(parse_key(F.col("gold")), parse_key(F.coalesce("pred", F.lit("/")))).cast("double")), 6).alias("mean_lcp"))


def c19_sft_rows(spark, sf):
    it = items(spark, sf)
    rows = report.sft_rows(it.filter("split = 'train'"), it.select("vault", "path_key"), "File the note.")
    # the texts of JSON differ between engines; what they parse to does not
    m = F.col("messages")
    user = F.from_json(m[1]["content"], "note string, folders array<string>")
    answer = F.from_json(m[2]["content"], "path array<string>")
    return rows.select("vault", "id", F.size("messages").alias("n_messages"), F.md5(user["note"].cast("binary")).alias("note"), F.array_join(user["folders"], ",").alias("folders"), F.array_join(answer["path"], "/").alias("path"), m[0]["content"].alias("system"))


_VH = "vh AS (SELECT vault, arm, bucket, count(*) FILTER (WHERE exact) AS h, count(exact) AS n FROM soft GROUP BY ALL), bh AS (SELECT bucket, vault, arm, h, n FROM vh WHERE bucket <> '0' UNION ALL SELECT 'all', vault, arm, sum(h), sum(n) FROM vh GROUP BY vault, arm)"
_PAIR = "one AS (SELECT vault, id, bucket, max(CASE WHEN arm = 'bm25' THEN exact::INT END) AS a, max(CASE WHEN arm = 'first' THEN exact::INT END) AS b FROM soft GROUP BY ALL), p0 AS (SELECT bucket, vault, sum(a)::BIGINT AS ha, sum(b)::BIGINT AS hb, count(*) AS n FROM one WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), pa AS (SELECT * FROM p0 WHERE bucket <> '0' UNION ALL SELECT 'all', vault, sum(ha)::BIGINT, sum(hb)::BIGINT, sum(n)::BIGINT FROM p0 GROUP BY vault)"
_DRAWS = "pl AS (SELECT bucket, vault, row_number() OVER (PARTITION BY bucket ORDER BY vault) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS v FROM (SELECT DISTINCT bucket, vault FROM {0})), dr AS (SELECT s.bucket, rep, pl.vault FROM (SELECT DISTINCT bucket, v FROM pl) s CROSS JOIN range({1}) r(rep) CROSS JOIN LATERAL (SELECT unnest(range(v)) AS j) JOIN pl ON pl.bucket = s.bucket AND pl.i = ('0x' || substr(md5('0|' || rep || '|' || j), 1, 15))::BIGINT % s.v)"
_ACC = "avg(CASE WHEN arm = '{0}' THEN exact::INT END)"
_MARG = f"mg AS (SELECT vault, {_ACC.format('bm25')} - {_ACC.format('majority')} AS vote_majority, {_ACC.format('first')} - {_ACC.format('bm25')} AS first_vote, {_ACC.format('first')} - {_ACC.format('majority')} AS first_majority FROM soft GROUP BY vault)"
_DESCR = """sz AS (SELECT vault, path_key, count(*) AS c, max(len(path)) AS depth FROM items GROUP BY ALL), gi AS (SELECT vault, sum((2 * i - n - 1) * c) / (max(n) * sum(c)) AS gini FROM (SELECT vault, c, row_number() OVER (PARTITION BY vault ORDER BY c) AS i, count(*) OVER (PARTITION BY vault) AS n FROM sz) GROUP BY vault),
de AS (SELECT vault, ln(count(*)) AS ln_dirs, max(depth)::DOUBLE AS max_depth, avg(c) AS mean_notes, max(c) / sum(c) AS top_share, any_value(gini) AS gini FROM sz JOIN gi USING (vault) GROUP BY vault)"""


def _corr_sql(keys: str, source: str) -> str:
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, vault) AS rx, row_number() OVER (PARTITION BY {keys} ORDER BY y, vault) AS ry FROM {source}), rh AS (SELECT {keys}, corr(rx, ry) AS rho FROM rk GROUP BY ALL),
nu AS (SELECT {keys}, rep, corr(rx, pos) AS c FROM (SELECT {keys}, rep, rx, row_number() OVER (PARTITION BY {keys}, rep ORDER BY md5('0|' || rep || '|' || vault), vault) AS pos FROM rk CROSS JOIN range({REPS}) r(rep)) GROUP BY ALL)
SELECT {keys}, round(any_value(rho), 6) AS rho, round(avg((abs(c) >= abs(rho) - 1e-9)::INT), 6) AS p FROM nu JOIN rh USING ({keys}) GROUP BY ALL"""


_OCC = "SELECT arm, bucket, count(*) AS n, count(exact) AS n_scored, round(count(*) FILTER (WHERE exact) / nullif(count(exact), 0), 6) AS accuracy FROM (SELECT * FROM soft WHERE bucket <> '0' UNION ALL SELECT * REPLACE ('all' AS bucket) FROM soft) {0} GROUP BY arm, bucket"
_LCP = "len(list_filter(range(1, least(len(g), len(p)) + 1), lambda i: g[1:i] = p[1:i]))"
_GP = "(SELECT *, list_filter(string_split(gold, '/'), lambda s: s <> '') AS g, list_filter(string_split(coalesce(pred, '/'), '/'), lambda s: s <> '') AS p FROM soft)"
_DL = "d AS (SELECT * FROM documents JOIN labels USING (doc_id))"

SQL = {
    "i2_occupancy": with_views(_OCC.format(""), "verdicts"),
    "i3_by_kind": with_views("SELECT coalesce(kind, 'ALL') AS kind, count(*) AS n, round(avg(exact::INT), 6) AS exact FROM (SELECT split_part(gold, '/', 2) AS kind, exact FROM soft) GROUP BY ROLLUP (kind)", "verdicts"),
    "i4_summary": with_views(f"SELECT arm, count(*) AS n, round(avg(exact::INT), 6) AS path_exact, round(avg((relation IN ('exact', 'gold_prefix', 'pred_prefix'))::INT), 6) AS path_soft, round(avg(coalesce(g[1] = p[1], false)::INT), 6) AS branch_ok, count(*) FILTER (WHERE pred IS NULL) AS no_answer, round(avg({_LCP} / greatest(len(g), len(p), 1)), 6) AS lcp_ratio, count(*) FILTER (WHERE relation = 'pred_prefix') AS n_pred_prefix FROM {_GP} GROUP BY arm", "verdicts"),
    "i6_recall_grid": with_views(f"WITH {_VR}, f AS (SELECT *, row_number() OVER (PARTITION BY vault, id ORDER BY rk, doc_folder) AS pos FROM (SELECT vault, id, doc_folder, min(rk) AS rk FROM vr WHERE rk <= 40 GROUP BY ALL)) SELECT 'note' AS mode, n, round(avg(coalesce(pos <= n AND rk <= 8 * n, false)::INT), 6) AS recall FROM vec_items v CROSS JOIN (VALUES (1), (3), (5)) t(n) LEFT JOIN f ON f.vault = v.vault AND f.id = v.id AND f.doc_folder = v.folder WHERE split = 'val' GROUP BY n", "vec_items"),
    "i7_pooled": with_views("WITH h AS (SELECT vault, arm, count(*) FILTER (WHERE exact) / nullif(count(exact), 0) AS rate, count(exact) AS n FROM soft GROUP BY ALL) SELECT arm, round(sum(rate * n) / sum(n), 6) AS pooled, round(sum(round(rate, 4) * n) / sum(n), 4) AS pooled_rounded FROM h GROUP BY arm", "verdicts"),
    "i8_retrieval_quality": with_views(f"WITH {_VR}, gd AS (SELECT vault, folder, count(*) AS n_gold FROM vec_items WHERE split = 'train' GROUP BY ALL), q AS (SELECT v.vault, v.id, v.folder, n_gold FROM vec_items v LEFT JOIN gd USING (vault, folder) WHERE split = 'val'), h AS (SELECT q.vault, q.id, n_gold, count(*) FILTER (WHERE doc_folder = folder) AS got, bool_or(doc_folder = '/f' || ((substr(folder, 3, 1)::INT + 1) % 10)) AS twin FROM q LEFT JOIN (SELECT * FROM vr WHERE rk <= 5) t ON t.vault = q.vault AND t.id = q.id GROUP BY ALL) SELECT vault, round(avg(coalesce(got / n_gold, 0)), 6) AS recall, round(avg(twin::INT), 6) AS twin_intrusion FROM h GROUP BY vault", "vec_items"),
    "i9_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(sum(value), 3) AS total FROM events GROUP BY event_type",
    "i10_per_vault": with_views("SELECT vault, arm, count(*) FILTER (WHERE exact) AS h, count(exact) AS n FROM soft GROUP BY ALL", "verdicts"),
    "i11_worst_margin": with_views("SELECT vault, round(m, 6) AS margin FROM (SELECT vault, avg(CASE WHEN arm = 'bm25' THEN exact::INT END) - avg(CASE WHEN arm = 'first' THEN exact::INT END) AS m FROM soft WHERE bucket IN ('3-9', '10+') GROUP BY vault) WHERE m IS NOT NULL ORDER BY round(m, 9), vault LIMIT 8", "verdicts"),
    "i12_failure_mode": with_views("SELECT arm, bucket, round(avg((relation = 'pred_prefix')::INT), 6) AS pred_prefix_share FROM soft WHERE relation <> 'none' GROUP BY ALL", "verdicts"),
    "i13_distinct": with_views("SELECT count(DISTINCT vault) AS vaults, count(DISTINCT vault || path_key) AS folders, count(DISTINCT text) AS texts, count(DISTINCT path[-1]) AS leaves FROM notes", "notes"),
    "i15_tokens": with_views("SELECT vault, split, sum(length(text) // 4)::BIGINT AS tokens, count(*) AS calls FROM items GROUP BY ALL", "items"),
    "m1_bootstrap": with_views(f"WITH {_VH}, {_DRAWS.format('bh', REPS)}, st AS (SELECT bucket, arm, rep, sum(h) / greatest(sum(n), 1) AS x FROM dr JOIN bh USING (bucket, vault) GROUP BY ALL), ci AS (SELECT bucket, arm, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM st GROUP BY ALL) SELECT bucket, arm, round(acc, 6) AS acc, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT bucket, arm, sum(h) / greatest(sum(n), 1) AS acc FROM bh GROUP BY ALL) JOIN ci USING (bucket, arm)", "verdicts"),
    "m2_paired": with_views(f"WITH {_PAIR}, {_DRAWS.format('pa', REPS)}, st AS (SELECT bucket, rep, (sum(ha) - sum(hb)) / greatest(sum(n), 1) AS x FROM dr JOIN pa USING (bucket, vault) GROUP BY ALL), ci AS (SELECT bucket, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM st GROUP BY ALL) SELECT bucket, n_vaults, round(diff, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT bucket, (sum(ha) - sum(hb)) / greatest(sum(n), 1) AS diff, count(*) FILTER (WHERE n > 0) AS n_vaults FROM pa GROUP BY ALL) JOIN ci USING (bucket)", "verdicts"),
    "m3_crossing": with_views("WITH o AS (SELECT vault, id, bucket, max(CASE WHEN arm = 'first' THEN exact::INT END) AS a, max(CASE WHEN arm = 'majority' THEN exact::INT END) AS b FROM soft GROUP BY ALL), c AS (SELECT vault, avg(CASE WHEN bucket = '1-2' THEN a - b END) AS s, avg(CASE WHEN bucket = '10+' THEN a - b END) AS d FROM o WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY vault) SELECT count(*) FILTER (WHERE s IS NOT NULL AND d IS NOT NULL) AS both, count(*) FILTER (WHERE s > 0) AS sparse_up, count(*) FILTER (WHERE d < 0) AS dense_down, count(*) FILTER (WHERE s > 0 AND d < 0) AS crossings, count(*) FILTER (WHERE s < 0 AND d > 0) AS reverse FROM c", "verdicts"),
    "m4_nested_k": with_views(f"WITH {_VR}, t AS (SELECT vault, id, k, doc_folder, sum(score) AS s, min(rk) AS r FROM vr JOIN (VALUES (1), (3), (5), (8), (12)) g(k) ON rk <= k GROUP BY ALL), pk AS (SELECT vault, id, k, arg_max(doc_folder, (round(s, 9), -r)) AS pred FROM t GROUP BY ALL), h AS (SELECT p.vault, k, count(*) FILTER (WHERE pred = folder) AS h, count(*) AS n FROM pk p JOIN vec_items v ON v.vault = p.vault AND v.id = p.id GROUP BY ALL), o AS (SELECT *, sum(h) OVER (PARTITION BY k) - h AS others FROM h) SELECT vault, k, h, n FROM (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY others DESC, abs(k - 5), k) AS r FROM o) WHERE r = 1", "vec_items"),
    "m5_exclusion": with_views(_OCC.format("WHERE NOT contains(vault, 'src1') AND NOT contains(vault, 'src2')"), "verdicts"),
    "n1_spearman": with_views(f"WITH {_DESCR}, {_MARG}, xs AS (SELECT de.vault, 'ln_dirs' AS descriptor, round(ln_dirs, 9) AS x, round(vote_majority, 9) AS y FROM de JOIN mg ON mg.vault = de.vault), {_corr_sql('descriptor', 'xs')}", "verdicts"),
    "n2_descriptors": with_views(f"WITH {_DESCR} SELECT vault, round(ln_dirs, 6) AS ln_dirs, max_depth, round(mean_notes, 6) AS mean_notes, round(top_share, 6) AS top_share, round(gini, 6) AS gini FROM de", "items"),
    "n3_structure": with_views(f"WITH {_DESCR}, {_MARG}, jn AS (SELECT * FROM de JOIN mg USING (vault)), u1 AS (UNPIVOT jn ON ln_dirs, max_depth, mean_notes, top_share, gini INTO NAME descriptor VALUE x), u2 AS (UNPIVOT u1 ON vote_majority, first_vote, first_majority INTO NAME margin VALUE y), xs AS (SELECT vault, margin, descriptor, round(x, 9) AS x, round(y, 9) AS y FROM u2), {_corr_sql('margin, descriptor', 'xs')}", "verdicts"),
    "n4_kappa": "WITH m AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po FROM labels), a AS (SELECT quality AS v, count(*) AS na FROM labels GROUP BY 1), b AS (SELECT toxic AS v, count(*) AS nb FROM labels GROUP BY 1), x AS (SELECT sum(coalesce(na, 0) * coalesce(nb, 0)) AS c, count(*) AS k FROM a FULL JOIN b USING (v)) SELECT n, round(po, 6) AS po, round(c / (n * n), 6) AS pe, round((po - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa, round((k * po - 1) / (k - 1), 6) AS pabak FROM m, x",
    "n5_wilson": f"WITH {_DL}, w AS (SELECT source, sum(quality)::BIGINT AS k, count(*) AS n, sum(quality) / count(*) AS p FROM d GROUP BY source), z AS (SELECT *, 1 + 1.96::DOUBLE * 1.96 / n AS q, (p + 1.96::DOUBLE * 1.96 / (2 * n)) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96 / (4 * n * n)) AS h FROM w) SELECT source, k, n, round(c / q - h / q, 6) AS low, round(c / q + h / q, 6) AS high FROM z",
    "n6_agreement": f"WITH {_DL} SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agree, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_first, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_second FROM d GROUP BY ROLLUP (lang)",
    "n7_lenient": with_views("WITH ac AS (SELECT arm, avg(exact::INT) AS acc FROM soft GROUP BY arm), wr AS (SELECT arm, bucket, count(*) AS w FROM soft WHERE NOT exact GROUP BY ALL), ju AS (SELECT bucket, quality AS s FROM soft JOIN labels ON doc_id = id WHERE NOT exact AND arm = 'bm25'), ce AS (SELECT bucket, avg(s) AS cell FROM ju GROUP BY bucket), sh AS (SELECT arm, sum(w * coalesce(cell, (SELECT avg(s) FROM ju))) / sum(w) AS s FROM wr LEFT JOIN ce USING (bucket) GROUP BY arm) SELECT arm, round(acc + (1 - acc) * s, 6) AS lenient FROM ac JOIN sh USING (arm)", "verdicts"),
    "n8_class_errors": f"WITH {_DL}, x AS (SELECT lang, 'first' AS view, quality AS x FROM d UNION ALL SELECT lang, 'second', toxic FROM d UNION ALL SELECT lang, 'agreed', quality FROM d WHERE quality = toxic) SELECT view, lang, count(*) AS n, round(avg(1 - x), 6) AS error FROM x GROUP BY ALL",
    "n9_mcnemar": with_views("WITH o AS (SELECT vault, id, bool_or(coalesce(exact, false)) FILTER (WHERE arm = 'bm25') AS x, bool_or(coalesce(exact, false)) FILTER (WHERE arm = 'first') AS y FROM soft GROUP BY ALL), n AS (SELECT count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c FROM o), t AS (SELECT b, c, exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE)) AS t FROM n, LATERAL (SELECT unnest(range(least(b, c) + 1)) AS i)) SELECT b, c, round(least(1.0, 2 * sum(t)), 6) AS p FROM t GROUP BY b, c", "verdicts"),
    "n10_pabak": "SELECT round((4 * avg((quality = toxic)::INT) - 1) / 3, 6) AS pabak FROM labels",
    "n11_win_tie_loss": with_views(f"WITH {_MARG} SELECT count(*) FILTER (WHERE round(first_vote, 9) > 0) AS win, count(*) FILTER (WHERE round(first_vote, 9) = 0) AS tie, count(*) FILTER (WHERE round(first_vote, 9) < 0) AS loss FROM mg", "verdicts"),
    "n12_valid_rate": with_views("WITH d AS (SELECT DISTINCT vault, path_key FROM items), p AS (SELECT vault, id, path_key AS gold, len(path) AS lg, CASE id % 3 WHEN 0 THEN list_append(path, 'new') WHEN 1 THEN path[1:1] ELSE path END AS q FROM items WHERE split = 'val'), k AS (SELECT p.*, '/' || array_to_string(q, '/') AS pred, EXISTS (SELECT 1 FROM d WHERE d.vault = p.vault AND d.path_key = '/' || array_to_string(q, '/')) AS known FROM p) SELECT count(*) AS n, round(avg(known::INT), 6) AS valid_rate, round(avg(CASE WHEN known THEN (pred = gold)::INT END), 6) AS exact_within_valid, count(*) FILTER (WHERE len(q) > lg) AS too_deep, count(*) FILTER (WHERE len(q) < lg) AS too_shallow FROM k", "items"),
    "h1_h2_predictions": with_views("SELECT count(pred) AS n_inner, count(*) AS n_left, count(*) FILTER (WHERE pred IS NULL) AS n_missing FROM soft WHERE arm = 'first'", "verdicts"),
    "h3_support": with_views("SELECT v.vault, v.id, coalesce(s.support, 0) AS support FROM items v LEFT JOIN support s USING (vault, path_key) WHERE v.split = 'val'", "support"),
    "h4_h5_seen": with_views("SELECT id, CASE WHEN EXISTS (SELECT 1 FROM support s WHERE s.vault = v.vault AND s.path_key = v.path_key) THEN 'seen' ELSE 'unseen' END AS part FROM items v WHERE split = 'val'", "support"),
    "h6_membership": with_views(f"WITH {_VR}, c AS (SELECT vault, id, doc_folder, row_number() OVER (PARTITION BY vault, id ORDER BY min(rk), doc_folder) AS pos FROM vr WHERE rk <= 24 GROUP BY vault, id, doc_folder) SELECT vault, id, EXISTS (SELECT 1 FROM c WHERE c.vault = v.vault AND c.id = v.id AND c.doc_folder = v.folder AND pos <= 3) AS found FROM vec_items v WHERE split = 'val'", "vec_items"),
    "h7_all_pairs": with_views(f"WITH {_VR} SELECT vault, count(*) AS pairs, round(max(score), 6) AS best, round(min(score), 6) AS worst FROM vs GROUP BY vault", "vec_items"),
    "h9_siblings": with_views("WITH d AS (SELECT DISTINCT path_key, path[1:len(path) - 1] AS up FROM notes) SELECT a.path_key AS a, b.path_key AS b FROM d a JOIN d b ON a.up = b.up AND a.path_key < b.path_key", "notes"),
    "h10_cross": "SELECT r_name, template, md5(r_name || '/' || template) AS key FROM region CROSS JOIN range(8) t(template)",
    "h11_paired": with_views(f"WITH {_PAIR} SELECT * FROM pa", "verdicts"),
    "h12_full_outer": "SELECT coalesce(a.v, b.v) AS v, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT quality AS v, count(*) AS na FROM labels GROUP BY 1) a FULL JOIN (SELECT toxic * 2 AS v, count(*) AS nb FROM labels GROUP BY 1) b ON a.v = b.v",
    "j2_running_total": with_views("SELECT vault, path_key, n, coalesce(sum(n) OVER (PARTITION BY vault ORDER BY path_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT vault, path_key, count(*) AS n FROM notes GROUP BY ALL)", "notes"),
    "j3_ordinal_rank": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS rank, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS overall FROM customer",
    "k1_sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "l1_set_ops": "WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier) SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'except_all', count(*) FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s)",
    "l2_ordered_dedup": "SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY ALL",
    "o1_ascii_tree": with_views("SELECT DISTINCT '/' || array_to_string(path[1:i], '/') || '/' AS sort_key, repeat('  ', (i - 1)::INT) || path[i] || '/' AS line FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM notes) UNION ALL SELECT path_key || '/' || chr(65535) || lpad(id::VARCHAR, 12, '0'), repeat('  ', len(path)::INT) || CASE WHEN id % 5 <> 0 THEN '- ' ELSE '× ' END || id FROM notes", "notes"),
    "o2_tree_groups": with_views("SELECT vault, path_key, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM notes GROUP BY ALL", "notes"),
    "o3_project_counts": "SELECT source AS vault, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, vault",
    "o5_fixed_width": with_views(f"SELECT rtrim(rpad(arm, 10, ' ') || ' ' || rpad(bucket, 6, ' ') || ' ' || rpad(n::VARCHAR, 6, ' ') || ' ' || rpad(coalesce(printf('%.4f', accuracy), '-'), 8, ' ')) AS line FROM ({_OCC.format('')})", "verdicts"),
    "o6_rescore": with_views(f"SELECT arm, relation, count(*) AS n, round(avg({_LCP}), 6) AS mean_lcp FROM {_GP} GROUP BY ALL", "verdicts"),
    "c19_sft_rows": with_views("WITH f AS (SELECT vault, string_agg(path_key, ',' ORDER BY path_key) AS folders FROM (SELECT DISTINCT vault, path_key FROM items) GROUP BY vault) SELECT i.vault, i.id, 3 AS n_messages, md5(text) AS note, folders, array_to_string(path, '/') AS path, 'File the note.' AS system FROM items i JOIN f ON f.vault = i.vault WHERE split = 'train'", "items"),
}
SQL["i5_conditional"] = f"SELECT count(*) AS n, round(avg(gold_in_shortlist::INT), 6) AS candidate_recall, round(avg((pred = gold)::INT), 6) AS exact, round(avg(CASE WHEN gold_in_shortlist THEN (pred = gold)::INT END), 6) AS exact_given_recall FROM ({RETRIEVAL_SQL['f8_cascade']})"
QUERIES = {k: f for k, f in globals().items() if k in SQL}

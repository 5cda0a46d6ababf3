"""Queries that retrieve notes and predict folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import path_key, path_text
from ..functions.vectors import cosine, norm, unit
from ..operators import placers, retrieval
from .views import held, items, notes, table, vec_items, vecs, with_views

KEYS = ["vault", "id"]


def e1_normalise(spark, sf):
    v = vecs(spark, sf)
    return v.select("id", F.round(norm(F.col("vector")), 6).alias("length"), F.round(F.element_at(unit(F.col("vector")), 1), 6).alias("first"), F.round(F.element_at(unit(F.col("vector"), 0.0, 1e-9), 64), 6).alias("last"), F.round(cosine(F.col("vector"), F.transform("vector", lambda x: x * 0)), 6).alias("with_zero"))


def _vec_scores(spark, sf, k=None, part=None):
    it = vec_items(spark, sf)
    train = it.filter("split = 'train'").select("id", "ord", "vault", "vector", "folder")
    if part is not None:
        train = train.withColumn("is_global", part)
    return retrieval.cosine_scores(train, it.filter("split = 'val'").select("id", "vault", "vector"), k=k, part=None if part is None else "doc_is_global")


def e2_flat(spark, sf):
    return retrieval.top_k(_vec_scores(spark, sf, 5), KEYS, 5).select("vault", "id", "doc", F.round("score", 6).alias("score"), "rk")


def e3_hier(spark, sf):
    """Folders of even number are global, the others belong to projects."""
    s = _vec_scores(spark, sf, 6, F.substring("folder", 3, 1).cast("int") % 2 == 0).withColumnRenamed("doc_is_global", "is_global")
    return retrieval.hierarchical_top_k(s, KEYS, 6, 2, "is_global").select("vault", "id", "doc", "is_global", F.round("score", 6).alias("score"), "rk")


def e4_subtree(spark, sf):
    """How many notes, and characters, are under each folder or prefix of one."""
    n = notes(spark, sf)
    active = n.select(F.explode(F.array(F.slice("path", 1, 1), F.slice("path", 1, 2))).alias("active")).distinct()
    return retrieval.in_subtree(n, active).groupBy(path_key(F.col("active")).alias("active")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _bm(it, k=None, part=None):
    train = it.filter("split = 'train'").select("vault", "id", "ord", "text", *([part.alias("is_global")] if part is not None else []))
    return retrieval.bm25_scores(train, it.filter("split = 'val'").select("vault", "id", "text"), k=k, part=None if part is None else "is_global")


def e5_bm25(spark, sf):
    return _bm(items(spark, sf)).select("vault", "id", "doc", F.round("score", 6).alias("score"))


def e6_bm25_topk(spark, sf):
    """With notes that share no term to fill up."""
    it = items(spark, sf)
    best = held(retrieval.top_k(_bm(it, 10), KEYS, 10))
    full = retrieval.fill_zeros(best, it.filter("split = 'train'"), it.filter("split = 'val'"), 10)
    return retrieval.top_k(full, KEYS, 10).select("vault", "id", "doc", F.round("score", 6).alias("score"), "rk")


def e7_bm25_hier(spark, sf):
    s = _bm(items(spark, sf), 6, F.col("id") % 3 == 0)
    return retrieval.hierarchical_top_k(s, KEYS, 6, 2, "is_global").select("vault", "id", "doc", "is_global", F.round("score", 6).alias("score"), "rk")


def e5b_benchmark_search(spark, sf):
    """Benchmark items as queries over all documents."""
    d = table(spark, sf, "documents").select(F.lit("all").alias("vault"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "text")
    q = table(spark, sf, "benchmark").select(F.lit("all").alias("vault"), F.col("item_id").alias("id"), "text")
    return retrieval.top_k(retrieval.bm25_scores(d, q, k=5), ["id"], 5).select("id", "doc", F.round("score", 6).alias("score"), "rk")


def e8_path_graph(spark, sf):
    return retrieval.path_graph(notes(spark, sf))


def e8b_degrees(spark, sf):
    """Neighbours of each note in the path graph, counted without its edges."""
    return retrieval.degrees(notes(spark, sf))


def e8c_expand(spark, sf):
    """The neighbours of a few seeds, the first note of each vault."""
    n = notes(spark, sf)
    seeds = n.groupBy("vault").agg(F.min("id").alias("id"))
    return retrieval.expand(n, seeds)


def _joined(spark, sf):
    """Vectors that are notes as well: text, path and vector."""
    n = notes(spark, sf).select("id", "ord", "vault", "text", "path", "path_key")
    return n.join(vecs(spark, sf).select("id", "vector"), "id")


def e9_hybrid(spark, sf):
    j = held(_joined(spark, sf))
    return retrieval.hybrid(j, j.select("id", "vault", "vector"), 5, 3).select("vault", "id", "doc", F.round("score", 6).alias("score"), "n_candidates", "rk")


def e10_scoped(spark, sf):
    """Candidates of each project: its own notes and the global ones (language en), which are counted once."""
    n = notes(spark, sf).select("id", F.when(F.col("lang") != "en", F.col("vault")).alias("p"))
    figures = (F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    both = n.groupBy("p").agg(*figures)
    common = both.filter("p IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gn"), F.min("first").alias("gf"), F.max("last").alias("gl"))
    own = both.filter("p IS NOT NULL").crossJoin(F.broadcast(common))  # one row
    return own.select("p", (F.col("n") + F.col("gn")).alias("n"), F.least("first", "gf").alias("first"), F.greatest("last", "gl").alias("last"))


def e11_rank_by_embed(spark, sf):
    """Notes without a vector take no part."""
    v = vecs(spark, sf)
    j = v.select("id", "ord", "vector").join(notes(spark, sf).select("id"), "id", "left_semi")
    return retrieval.top_k(retrieval.cosine_scores(j, v.select("id", "vector"), None, 3), ["id"], 3).select("id", "doc", F.round("score", 6).alias("score"), "rk")


def _note_ranks(spark, sf, k):
    return retrieval.top_k(_vec_scores(spark, sf, k), KEYS, k)


def _note_cands(spark, sf, n=3):
    return retrieval.folder_candidates(_note_ranks(spark, sf, 8 * n), KEYS, "doc_folder", n, 8)


def e12_note_cands(spark, sf):
    return _note_cands(spark, sf)


def _nearest_text(it, folders, k):
    """The k nearest of the folders (vault, id, ord, vector) to each item to place, by hashed texts."""
    q = it.filter("split = 'val'").select("id", "vault", retrieval.hash_vector(F.col("text")).alias("vector"))
    return retrieval.top_k(retrieval.cosine_scores(folders, q, k=k), KEYS, k).withColumnRenamed("doc", "doc_folder")


def _path_ranks(it, k):
    """Folders by the hashed text of their paths against hashed texts of notes."""
    dirs = it.select("vault", "path_key", "path").distinct()
    f = dirs.select("vault", F.col("path_key").alias("id"), F.col("path_key").alias("ord"), retrieval.hash_vector(path_text(F.col("path"))).alias("vector"))
    return _nearest_text(it, f, k)


def _path_cands(it):
    return retrieval.folder_candidates(_path_ranks(it, 6), KEYS, "doc_folder", 3, 2)


def e13_path_cands(spark, sf):
    return _path_cands(items(spark, sf))


def _bm_cands(it, n=3):
    return retrieval.folder_candidates(placers.ranked_train(it, 8 * n), KEYS, "doc_key", n, 8).withColumnRenamed("doc_key", "doc_folder")


def e14_union(spark, sf):
    it = items(spark, sf)
    return retrieval.union_candidates(_bm_cands(it), _path_cands(it), KEYS, "doc_folder", 4)


def e15_snippets(spark, sf):
    it = items(spark, sf)
    # only what a snippet shows of a text goes along
    r = held(placers.ranked_train(it, 24)).join(it.select("vault", F.col("id").alias("doc"), F.substring("text", 1, 30).alias("text")), ["vault", "doc"])
    short = retrieval.folder_candidates(r, KEYS, "doc_key", 3, 8)
    out = retrieval.snippets(r, short, KEYS, "doc_key", "text", 2, 30)
    return out.select("vault", "id", "doc_key", "pos", F.md5(F.concat_ws("|", "snippets").cast("binary")).alias("snippets"), F.size("snippets").alias("n_snippets"))


def e16_describe(spark, sf):
    """Folders with a description where there is one (here: of folders of level four and more)."""
    d = notes(spark, sf).select("path_key", "path").distinct()
    desc = d.filter(F.col("path_key").rlike("/L[4-9]")).select("path_key", F.concat(F.lit("about "), F.array_join("path", " ")).alias("description"))
    full = d.join(desc, "path_key", "left")
    return full.select("path_key", F.when(F.coalesce("description", F.lit("")) != "", F.concat("path_key", F.lit(" - "), "description")).otherwise(F.col("path_key")).alias("shown"), F.concat("path_key", F.lit(": "), F.coalesce(F.nullif("description", F.lit("")), F.col("path_key"))).alias("e17_text"))


def e18_excerpts(spark, sf):
    from pyspark.sql import Window

    t = items(spark, sf).filter("split = 'train'").withColumn("r", F.row_number().over(Window.partitionBy("vault", "path_key").orderBy("ord"))).filter("r <= 4")
    g = t.groupBy("vault", "path_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, 300).alias("x")))), lambda s: s["x"]), "\n---\n").alias("excerpt"))
    return g.select("vault", "path_key", F.md5(F.col("excerpt").cast("binary")).alias("excerpt"))


def f1_majority(spark, sf):
    return placers.majority(items(spark, sf).filter("split = 'train'"))


def f2_bm25_vote(spark, sf):
    return placers.bm25_vote(placers.ranked_train(items(spark, sf), 5)).select("vault", "id", "pred")


def f3_knn_grid(spark, sf):
    return placers.knn_vote(_note_ranks(spark, sf, max(placers.K_GRID)))


def f4_centroid(spark, sf):
    it = vec_items(spark, sf)
    return placers.nearest_folder(placers.centroids(it.filter("split = 'train'")), it.filter("split = 'val'")).select("vault", "id", "pred")


def f5_path_top1(spark, sf):
    return _path_ranks(items(spark, sf), 1).select("vault", "id", F.col("doc_folder").alias("pred"))


def f6_description_top1(spark, sf):
    it = items(spark, sf)
    f = e16_describe(spark, sf).join(it.select("vault", "path_key").distinct(), "path_key")
    f = f.select("vault", F.col("path_key").alias("id"), F.col("path_key").alias("ord"), retrieval.hash_vector(F.col("e17_text")).alias("vector"))
    return _nearest_text(it, f, 1).select("vault", "id", F.col("doc_folder").alias("pred"))


def f8_cascade(spark, sf):
    """Shortlist, then an offline picker: the candidate whose name shares most words with the note, the earlier of equals."""
    from ..functions.text import tokenize
    from ..operators.pickers import overlap_pick

    it = items(spark, sf)
    # of a text to place, each word once and as one string is what goes along
    words = F.array_join(F.array_distinct(tokenize(F.col("text"))), " ")
    short = _bm_cands(it).join(it.filter("split = 'val'").select("vault", "id", F.col("path_key").alias("gold"), words.alias("words")), KEYS)
    short = short.withColumn("words", F.filter(F.split("words", " "), lambda w: w != ""))
    return overlap_pick(short, KEYS, "doc_folder", "words", "gold")


def f9_project(spark, sf):
    """Predictions made up by dropping or adding a level, put on folders that exist."""
    it = items(spark, sf)
    off = F.when(F.col("id") % 3 == 0, F.concat("path_key", F.lit("/new"))).when(F.col("id") % 3 == 1, F.concat(F.lit("/"), F.get("path", F.lit(0)))).otherwise(F.col("path_key"))
    preds = it.filter("split = 'val'").select("vault", "id", off.alias("pred"))
    return placers.project_to_existing(preds, it.select("vault", "path_key").distinct()).select("vault", "id", "pred", "projected")


def f10_baselines(spark, sf):
    """A random folder by hash, the last root, and the gold folder itself."""
    from pyspark.sql import Window

    from ..functions.draws import number

    it = items(spark, sf)
    d = it.select("vault", "path_key").distinct()
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("vault").orderBy("path_key")) - 1)
    n = d.groupBy("vault").agg(F.count(F.lit(1)).alias("nd"))
    last = it.groupBy("vault").agg(F.concat(F.lit("/"), F.max("lang")).alias("dump_root"))
    v = it.filter("split = 'val'").select("vault", "id", F.col("path_key").alias("oracle")).join(n, "vault").join(last, "vault")
    v = v.withColumn("i", F.pmod(number(0, F.col("id")), F.col("nd")))
    return v.join(d.withColumnRenamed("path_key", "random_dir"), ["vault", "i"]).select("vault", "id", "random_dir", "dump_root", "oracle")


def f11_shortlist_rule(spark, sf):
    """The smallest of two sizes whose recall is 0.9 or more, else the larger."""
    from .q_eval import i6_recall_grid

    r = i6_recall_grid(spark, sf).filter("mode = 'note'")
    return r.agg(F.coalesce(F.min(F.when(F.col("recall") >= 0.9, F.col("n"))), F.lit(5)).alias("n"))


_VS = """vs AS (SELECT q.vault, q.id, d.id AS doc, d.ord AS doc_ord, d.folder AS doc_folder,
  list_inner_product(q.vector, d.vector) / (sqrt(list_inner_product(q.vector, q.vector)) * sqrt(list_inner_product(d.vector, d.vector))) AS score
  FROM vec_items q JOIN vec_items d ON q.vault = d.vault AND q.split = 'val' AND d.split = 'train')"""
_VR = _VS + ", vr AS (SELECT *, row_number() OVER (PARTITION BY vault, id ORDER BY round(score, 9) DESC, doc_ord) AS rk FROM vs)"


def _hier_sql(source: str, flag: str) -> str:
    return f"""h AS (SELECT *, row_number() OVER (PARTITION BY vault, id, is_global ORDER BY round(score, 9) DESC, doc_ord) AS r FROM (SELECT *, {flag} AS is_global FROM {source}))
SELECT vault, id, doc, is_global, round(score, 6) AS score, row_number() OVER (PARTITION BY vault, id ORDER BY round(score, 9) DESC, doc_ord) AS rk FROM h WHERE r <= CASE WHEN is_global THEN 2 ELSE 4 END"""


_PT = "'folder: ' || array_to_string(path, ' / ') || ' (topic: ' || translate(path[-1], '-_', '  ') || ')'"


def _hashed(name: str, text: str, source: str, cols: str) -> str:
    """A view of hashed texts: tokens are counted by cell."""
    return f"""{name}_t AS (SELECT {cols}, unnest(list_transform(regexp_extract_all({text}, '(?i)[a-z0-9_./+-]+'), lambda w: lower(w))) AS w FROM {source}),
{name}_c AS (SELECT * EXCLUDE (w), ('0x' || substr(md5('cell|' || w), 1, 15))::BIGINT % 16 AS c, sum(CASE WHEN ('0x' || substr(md5('sign|' || w), 1, 15))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_t GROUP BY ALL),
{name} AS (SELECT * EXCLUDE (c, x, l), c, x, l FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {cols})) AS l FROM {name}_c))"""


def _path_rank_sql(text: str = _PT, source: str = "(SELECT DISTINCT vault, path_key, path FROM items)") -> str:
    return f"""{_hashed("fv", text, source, "vault, path_key")}, {_hashed("qv", "text", "(SELECT * FROM items WHERE split = 'val')", "vault, id")},
dots AS (SELECT q.vault, q.id, f.path_key, sum(q.x * f.x / (q.l * f.l)) AS s FROM qv q JOIN fv f ON q.vault = f.vault AND q.c = f.c AND q.l > 0 AND f.l > 0 GROUP BY ALL),
pr AS (SELECT v.vault, v.id, d.path_key AS doc_folder, row_number() OVER (PARTITION BY v.vault, v.id ORDER BY round(coalesce(s, 0), 9) DESC, d.path_key) AS rk
  FROM (SELECT vault, id FROM items WHERE split = 'val') v JOIN (SELECT DISTINCT vault, path_key FROM items) d ON v.vault = d.vault LEFT JOIN dots x ON x.vault = v.vault AND x.id = v.id AND x.path_key = d.path_key)"""


_PC = _path_rank_sql() + ", pc AS (SELECT vault, id, doc_folder, rk AS pos FROM pr WHERE rk <= 3)"
_BC = "bc AS (SELECT * FROM (SELECT vault, id, doc_key AS doc_folder, row_number() OVER (PARTITION BY vault, id ORDER BY min(rk), doc_key) AS pos FROM bmtop WHERE rk <= 24 GROUP BY vault, id, doc_key) WHERE pos <= 3)"
_GRAPH = """g AS (SELECT DISTINCT vault, a, b FROM (
  SELECT x.vault, x.id AS a, y.id AS b FROM {0} x JOIN {0} y ON x.vault = y.vault AND x.path_key = y.path_key AND x.id <> y.id
  UNION ALL SELECT x.vault, x.id, y.id FROM {0} x JOIN {0} y ON x.vault = y.vault AND len(x.path) > 1 AND '/' || array_to_string(x.path[1:len(x.path) - 1], '/') = y.path_key
  UNION ALL SELECT x.vault, y.id, x.id FROM {0} x JOIN {0} y ON x.vault = y.vault AND len(x.path) > 1 AND '/' || array_to_string(x.path[1:len(x.path) - 1], '/') = y.path_key))"""
_DESC = "SELECT path_key, CASE WHEN regexp_matches(path_key, '/L[4-9]') THEN path_key || ' - about ' || array_to_string(path, ' ') ELSE path_key END AS shown, path_key || ': ' || CASE WHEN regexp_matches(path_key, '/L[4-9]') THEN 'about ' || array_to_string(path, ' ') ELSE path_key END AS e17_text FROM (SELECT DISTINCT path_key, path FROM notes)"
_UNION = "un AS (SELECT * FROM (SELECT vault, id, doc_folder, row_number() OVER (PARTITION BY vault, id ORDER BY min(t)) AS pos FROM (SELECT vault, id, doc_folder, 2 * pos - 1 AS t FROM bc UNION ALL SELECT vault, id, doc_folder, 2 * pos FROM pc) GROUP BY vault, id, doc_folder) WHERE pos <= 4)"

SQL = {
    "e1_normalise": with_views("SELECT id, round(l, 6) AS length, round(vector[1] / l, 6) AS first, round(vector[64] / (l + 1e-9), 6) AS last, 0.0::DOUBLE AS with_zero FROM (SELECT *, sqrt(list_inner_product(vector, vector)) AS l FROM vecs)", "vecs"),
    "e2_flat": with_views(f"WITH {_VR} SELECT vault, id, doc, round(score, 6) AS score, rk FROM vr WHERE rk <= 5", "vec_items"),
    "e3_hier": with_views(f"WITH {_VS}, {_hier_sql('vs', 'substr(doc_folder, 3, 1)::INT % 2 = 0')}", "vec_items"),
    "e4_subtree": with_views("WITH a AS (SELECT DISTINCT unnest([path[1:1], path[1:2]]) AS active FROM notes) SELECT '/' || array_to_string(active, '/') AS active, count(*) AS n, sum(length(text))::BIGINT AS chars FROM notes JOIN a ON path[1:len(active)] = active GROUP BY a.active", "notes"),
    "e5_bm25": with_views("SELECT vault, id, doc, round(score, 6) AS score FROM bm", "bm"),
    "e6_bm25_topk": with_views("WITH z AS (SELECT v.vault, v.id, d.id AS doc, d.ord AS doc_ord, coalesce(b.score, 0) AS score FROM items v JOIN items d ON v.vault = d.vault AND v.split = 'val' AND d.split = 'train' LEFT JOIN bm b ON b.vault = v.vault AND b.id = v.id AND b.doc = d.id) SELECT vault, id, doc, round(score, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY vault, id ORDER BY round(score, 9) DESC, doc_ord) AS rk FROM z) WHERE rk <= 10", "bm"),
    "e7_bm25_hier": with_views(f"WITH {_hier_sql('bm', 'doc % 3 = 0')}", "bm"),
    "e5b_benchmark_search": """WITH t AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?i)[a-z0-9_./+-]+'))) AS term FROM documents) GROUP BY ALL),
q AS (SELECT item_id AS id, term, count(*) AS qtf FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '(?i)[a-z0-9_./+-]+'))) AS term FROM benchmark) GROUP BY ALL),
l AS (SELECT doc, sum(tf) AS dl FROM t GROUP BY doc), n AS (SELECT count(*) AS n, (SELECT sum(tf) FROM t) / count(*) AS avgdl FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT id, t.doc, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN l ON l.doc = t.doc CROSS JOIN n GROUP BY id, t.doc)
SELECT id, doc, round(score, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, doc) AS rk FROM s) WHERE rk <= 5""",
    "e8_path_graph": with_views(f"WITH {_GRAPH.format('notes')} SELECT vault, a, b FROM g", "notes"),
    "e8b_degrees": with_views(f"WITH {_GRAPH.format('notes')} SELECT n.vault, n.id, count(g.b) AS degree FROM notes n LEFT JOIN g ON g.vault = n.vault AND g.a = n.id GROUP BY ALL", "notes"),
    "e8c_expand": with_views(f"WITH {_GRAPH.format('notes')} SELECT vault, a, b FROM g WHERE (vault, a) IN (SELECT (vault, min(id)) FROM notes GROUP BY vault)", "notes"),
    "e9_hybrid": with_views(f"""WITH j AS (SELECT n.id, n.ord, n.vault, n.path, n.path_key, v.vector FROM notes n JOIN vecs v ON n.id = v.id), {_GRAPH.format("j")},
s AS (SELECT q.vault, q.id, d.id AS doc, d.ord AS doc_ord, list_inner_product(q.vector, d.vector) / (sqrt(list_inner_product(q.vector, q.vector)) * sqrt(list_inner_product(d.vector, d.vector))) AS score FROM j q JOIN j d ON q.vault = d.vault AND q.id <> d.id),
seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vault, id ORDER BY round(score, 9) DESC, doc_ord) AS r FROM s) WHERE r <= 3),
c AS (SELECT vault, id, doc FROM seed UNION SELECT seed.vault, seed.id, g.b FROM seed JOIN g ON g.vault = seed.vault AND g.a = seed.doc)
SELECT vault, id, doc, round(score, 6) AS score, n_candidates, rk FROM (SELECT s.*, count(*) OVER (PARTITION BY s.vault, s.id) AS n_candidates, row_number() OVER (PARTITION BY s.vault, s.id ORDER BY round(score, 9) DESC, doc_ord) AS rk FROM s JOIN c ON c.vault = s.vault AND c.id = s.id AND c.doc = s.doc) WHERE rk <= 5""", "notes", "vecs"),
    "e10_scoped": with_views("WITH n AS (SELECT id, CASE WHEN lang <> 'en' THEN vault END AS project FROM notes), p AS (SELECT DISTINCT project AS p FROM n WHERE project IS NOT NULL) SELECT p, count(*) AS n, min(id) AS first, max(id) AS last FROM p JOIN n ON n.project IS NULL OR n.project = p.p GROUP BY p", "notes"),
    "e11_rank_by_embed": with_views("WITH s AS (SELECT q.id, d.id AS doc, list_inner_product(q.vector, d.vector) / (sqrt(list_inner_product(q.vector, q.vector)) * sqrt(list_inner_product(d.vector, d.vector))) AS score FROM vecs q, vecs d WHERE d.id IN (SELECT id FROM notes)) SELECT id, doc, round(score, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, doc) AS rk FROM s) WHERE rk <= 3", "vecs", "notes"),
    "e12_note_cands": with_views(f"WITH {_VR} SELECT * FROM (SELECT vault, id, doc_folder, row_number() OVER (PARTITION BY vault, id ORDER BY min(rk), doc_folder) AS pos FROM vr WHERE rk <= 24 GROUP BY vault, id, doc_folder) WHERE pos <= 3", "vec_items"),
    "e13_path_cands": with_views(f"WITH {_PC} SELECT vault, id, doc_folder, pos FROM pc", "items"),
    "e14_union": with_views(f"WITH {_PC}, {_BC}, {_UNION} SELECT vault, id, doc_folder, pos FROM un", "bmtop"),
    "e15_snippets": with_views(f"WITH {_BC}, m AS (SELECT b.*, i.text, row_number() OVER (PARTITION BY b.vault, b.id, doc_key ORDER BY rk) AS m FROM bmtop b JOIN items i ON i.vault = b.vault AND i.id = b.doc WHERE rk <= 24), s AS (SELECT vault, id, doc_key, string_agg(substr(text, 1, 30), '|' ORDER BY m) AS t, count(*) AS n FROM m WHERE m <= 2 GROUP BY ALL) SELECT bc.vault, bc.id, bc.doc_folder AS doc_key, bc.pos, md5(t) AS snippets, n::INT AS n_snippets FROM bc JOIN s ON s.vault = bc.vault AND s.id = bc.id AND s.doc_key = bc.doc_folder", "bmtop"),
    "e16_describe": with_views(_DESC, "notes"),
    "e18_excerpts": with_views("SELECT vault, path_key, md5(string_agg(substr(text, 1, 300), chr(10) || '---' || chr(10) ORDER BY ord)) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY vault, path_key ORDER BY ord) AS r FROM items WHERE split = 'train') WHERE r <= 4 GROUP BY vault, path_key", "items"),
    "f1_majority": with_views("SELECT vault, pred FROM major", "major"),
    "f2_bm25_vote": with_views("SELECT vault, id, pred FROM bmvote", "bmvote"),
    "f3_knn_grid": with_views(f"WITH {_VR}, t AS (SELECT vault, id, k, doc_folder, sum(score) AS s, min(rk) AS r FROM vr JOIN (VALUES (1), (3), (5), (8), (12)) g(k) ON rk <= k GROUP BY ALL) SELECT vault, id, k, arg_max(doc_folder, (round(s, 9), -r)) AS pred FROM t GROUP BY vault, id, k", "vec_items"),
    "f4_centroid": with_views("""WITH u AS (SELECT vault, folder, generate_subscripts(vector, 1) AS p, unnest(vector) / (sqrt(list_inner_product(vector, vector)) + 1e-9) AS x FROM vec_items WHERE split = 'train'), m AS (SELECT vault, folder, p, avg(x) AS x FROM u GROUP BY ALL),
c AS (SELECT vault, folder, list(x ORDER BY p) AS v FROM m GROUP BY ALL), s AS (SELECT q.vault, q.id, c.folder, round(list_inner_product(q.vector, c.v) / (sqrt(list_inner_product(q.vector, q.vector)) * sqrt(list_inner_product(c.v, c.v))), 8) AS s FROM vec_items q JOIN c ON q.vault = c.vault AND q.split = 'val')
SELECT vault, id, folder AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vault, id ORDER BY s DESC, folder) AS r FROM s) WHERE r = 1""", "vec_items"),
    "f5_path_top1": with_views(f"WITH {_path_rank_sql()} SELECT vault, id, doc_folder AS pred FROM pr WHERE rk = 1", "items"),
    "f6_description_top1": with_views(f"WITH ds AS ({_DESC}), {_path_rank_sql('e17_text', '(SELECT DISTINCT vault, path_key, e17_text FROM items JOIN ds USING (path_key))')} SELECT vault, id, doc_folder AS pred FROM pr WHERE rk = 1", "items"),
    "f8_cascade": with_views(f"""WITH {_BC}, o AS (SELECT bc.*, i.path_key AS gold, len(list_intersect(list_distinct(list_transform(regexp_extract_all(i.text, '(?i)[a-z0-9_./+-]+'), lambda w: lower(w))), list_distinct(list_transform(string_split(substr(doc_folder, 2), '/'), lambda w: lower(w))))) AS hits FROM bc JOIN items i ON i.vault = bc.vault AND i.id = bc.id)
SELECT vault, id, arg_max(doc_folder, (hits, -pos)) AS pred, bool_or(doc_folder = gold) AS gold_in_shortlist, count(*) AS n_candidates, any_value(gold) AS gold FROM o GROUP BY vault, id""", "bmtop"),
    "f9_project": with_views("""WITH d AS (SELECT DISTINCT vault, path_key, path FROM items), p AS (SELECT vault, id, CASE id % 3 WHEN 0 THEN list_append(path, 'new') WHEN 1 THEN path[1:1] ELSE path END AS p FROM items WHERE split = 'val'),
x AS (SELECT p.vault, p.id, p.p, d.path_key, d.path, len(list_filter(range(1, least(len(p.p), len(d.path)) + 1), lambda i: p.p[1:i] = d.path[1:i])) AS l FROM p JOIN d ON p.vault = d.vault)
SELECT vault, id, '/' || array_to_string(p, '/') AS pred, path_key AS projected FROM (SELECT *, row_number() OVER (PARTITION BY vault, id ORDER BY (p = path) DESC, l DESC, abs(len(p) - len(path)), len(path), path_key) AS r FROM x) WHERE r = 1""", "items"),
    "f10_baselines": with_views("""WITH d AS (SELECT vault, path_key, row_number() OVER (PARTITION BY vault ORDER BY path_key) - 1 AS i, count(*) OVER (PARTITION BY vault) AS nd FROM (SELECT DISTINCT vault, path_key FROM items)), r AS (SELECT vault, '/' || max(lang) AS dump_root FROM items GROUP BY vault)
SELECT v.vault, v.id, d.path_key AS random_dir, dump_root, v.path_key AS oracle FROM items v JOIN r ON r.vault = v.vault JOIN d ON d.vault = v.vault AND d.i = ('0x' || substr(md5('0|' || v.id), 1, 15))::BIGINT % d.nd WHERE v.split = 'val'""", "items"),
    "f11_shortlist_rule": with_views(f"WITH {_VR}, c AS (SELECT vault, id, doc_folder, min(rk) AS rk, row_number() OVER (PARTITION BY vault, id ORDER BY min(rk), doc_folder) AS pos FROM vr WHERE rk <= 40 GROUP BY vault, id, doc_folder), g AS (SELECT n, avg((EXISTS (SELECT 1 FROM c WHERE c.vault = v.vault AND c.id = v.id AND c.doc_folder = v.folder AND c.pos <= n AND c.rk <= 8 * n))::INT) AS recall FROM vec_items v CROSS JOIN (VALUES (1), (3), (5)) t(n) WHERE split = 'val' GROUP BY n) SELECT coalesce(min(CASE WHEN round(recall, 6) >= 0.9 THEN n END), 5) AS n FROM g", "vec_items"),
}
QUERIES = {k: f for k, f in globals().items() if k in SQL}

"""Queries that prepare a corpus: copies, splits, selection, samples, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import order_key
from ..functions.paths import path_key
from ..operators import corpus
from ..operators.placers import with_soft
from ..sources.files import ingest
from .q_scalars import _FILES, _IS_CODE, _IS_MANIFEST, _files
from .views import arms, held, items, notes, table, trees, with_views


def b6_ingest(spark, sf):
    """Documents as files of a root, some damaged."""
    d = table(spark, sf, "documents")
    content = F.when(F.col("doc_id") % 11 == 0, F.unhex(F.lit("fffe41"))).when(F.col("doc_id") % 13 == 0, F.lit("  \n ").cast("binary")).when(F.col("doc_id") % 17 == 0, F.lit(None).cast("binary")).otherwise(F.col("text").cast("binary"))
    files = d.select(F.col("source").alias("root"), F.col("lang").alias("source"), F.concat(F.lit("notes/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), content.alias("content"))
    out = ingest(files)
    return out.select("root", "path", "ok", "reason", "id", F.length("body").alias("body_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), path_key(F.col("folder")).alias("folder"))


def b7_reject_reasons(spark, sf):
    return b6_ingest(spark, sf).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def d1_drop_dup_text(spark, sf):
    return corpus.drop_copies(notes(spark, sf), "text").select("id", "vault", "path_key")


def d2_depth_filter(spark, sf):
    """Why notes are dropped: copies first, then folders deeper than two."""
    n = notes(spark, sf)
    once = corpus.drop_copies(n, "text").select("id", F.lit(True).alias("once"))
    why = F.when(F.col("once").isNull(), F.lit("duplicate")).when(F.size("path") > 2, F.lit("too_deep")).otherwise(F.lit("kept"))
    return n.join(once, "id", "left").groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def d3_item_split(spark, sf):
    return items(spark, sf).select("vault", "id", "path_key", "split")


def d3b_root_split(spark, sf):
    n = notes(spark, sf).withColumn("root", F.get("path", F.lit(0)))
    return corpus.item_split(n, ["root"], "id", 0.2, 7).select("id", "root", "split")


def d4_folder_split(spark, sf):
    return corpus.folder_split(corpus.drop_copies(notes(spark, sf), "text"), "vault", "path_key", 0.4, 7).select("vault", "id", "path_key", "split")


def d5_split_meta(spark, sf):
    m = corpus.split_metadata(items(spark, sf))
    return m.withColumn("majority_share", F.round("majority_share", 6))


def d6_tree_holdout(spark, sf):
    """The last five vaults by name."""
    from pyspark.sql import Window

    v = notes(spark, sf).groupBy("vault").agg(F.count(F.lit(1)).alias("n"))
    return v.withColumn("holdout", F.row_number().over(Window.orderBy(F.col("vault").desc())) <= 5)


def d7_text_leak(spark, sf):
    split = corpus.item_split(notes(spark, sf), ["vault", "path_key"], "id", 0.4, 7)
    return corpus.text_leaks(split.filter("split = 'train'"), split.filter("split = 'val'"), "text")


def d8_cross_vault(spark, sf):
    """Texts that more than one vault has."""
    g = notes(spark, sf).groupBy("text").agg(F.countDistinct("vault").alias("vaults"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return g.filter("vaults > 1").select("first_id", "vaults", "n")


def d8b_cross_vault_near(spark, sf):
    """Vectors of different vaults with a cosine of 0.45 or more."""
    from ..operators.retrieval import near_pairs
    from .views import vecs

    return near_pairs(vecs(spark, sf).select("id", "vault", "vector"), 0.45, "vault")


def d9_classify(spark, sf):
    return corpus.classify_repositories(_files(spark, sf)).withColumn("manifests", F.array_join("manifests", ","))


def _probes(spark, sf):
    """Hosts of pages as repositories that were probed."""
    t = trees(spark, sf).groupBy("host").agg(F.count(F.lit(1)).alias("n_notes"), F.max("id").alias("m"))
    return t.select(F.when(F.col("m") % 5 == 0, F.concat("host", F.lit("-template"))).otherwise(F.col("host")).alias("name"), "n_notes", (F.col("m") % 3 == 0).alias("software"), (F.col("m") % 4 != 0).alias("marker"))


def _selected(spark, sf):
    return _probes(spark, sf).withColumn("reason", corpus.reject_reason(F.col("software"), F.col("name"), F.col("n_notes"), F.col("marker"), 2))


def d10_select(spark, sf):
    return corpus.spread_sample(_selected(spark, sf).filter("reason IS NULL"), "n_notes", "name", 7).select("name", "n_notes")


def d11_funnel(spark, sf):
    return _selected(spark, sf).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_notes").alias("notes"))


def _wrong(spark, sf):
    """Items to place with the number of arms that were wrong."""
    v = with_soft(arms(spark, sf))
    return v.groupBy("vault", "id", "bucket").agg(F.count_if(~F.coalesce("exact", F.lit(False))).alias("n_wrong"))


PLAN = (("1-2", 18), ("3-9", 25), ("10+", 22), ("0", 35))


def d12_stratified_sample(spark, sf):
    return corpus.capped_sample(_wrong(spark, sf).select("vault", "id", "bucket"), PLAN, "bucket", "vault", "id", 6, 7)


def d12b_pinned_sample(spark, sf):
    w = held(_wrong(spark, sf).select("vault", "id"))
    return corpus.pinned_sample(w, w.filter(F.col("id") < 60), "id", 30, 7)


def d13_class_sample(spark, sf):
    return corpus.class_sample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 20, 7)


def d14_wrong_pool(spark, sf):
    """Items that some arm got wrong, with one of the wrong folders, chosen by hash."""
    v = with_soft(arms(spark, sf)).filter(~F.coalesce("exact", F.lit(False)))
    return v.groupBy("vault", "id").agg(F.count(F.lit(1)).alias("n_wrong"), F.min_by(F.coalesce("pred", F.lit("none")), order_key(7, F.col("id"), F.col("arm"))).alias("shown"))


def d15_annotator_order(spark, sf):
    from pyspark.sql import Window

    a = table(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.lit("ann"), F.lit("bob"))).alias("annotator"))
    w = Window.partitionBy("annotator").orderBy(F.md5(F.concat_ws("/", F.lit("7"), "annotator", F.lit("gold"), F.col("item_id").cast("string")).cast("binary")))
    return a.withColumn("place", F.row_number().over(w))


def d16_synthetic(spark, sf):
    """Tasks of synthetic trees: layouts (nations) by templates."""
    layouts = table(spark, sf, "nation").select(F.lower("n_name").alias("tree"), "n_regionkey")
    templates = spark.range(12).select(F.col("id").alias("t"), F.element_at(F.array(*map(F.lit, ["budget", "results", "meeting", "ideas"])), (F.col("id") % 4 + 1).cast("int")).alias("topic"))
    both = layouts.crossJoin(F.broadcast(templates))
    folder = F.concat(F.lit("/work/"), F.regexp_replace("tree", " ", "-"), F.lit("/"), F.col("topic"))
    return both.select(F.concat_ws("_", F.lit("task"), F.substring(F.sha1(F.concat_ws("/", "tree", F.col("t").cast("string")).cast("binary")), 1, 10)).alias("id"), folder.alias("gold"), F.concat(F.lit("Note "), F.col("t").cast("string"), F.lit(" on "), "topic", F.lit(" of "), "tree").alias("text"), (F.col("t") >= 8).alias("twin"))


def d17_collisions(spark, sf):
    """The same claim in many projects: per project one query whose answer is its own note and whose distractors are the others'."""
    p = table(spark, sf, "region").select(F.lower("r_name").alias("project"), F.col("r_regionkey").alias("k"))
    facts = p.crossJoin(F.broadcast(spark.range(6).withColumnRenamed("id", "t"))).select("project", "t", F.concat_ws(":", "project", F.col("t").cast("string")).alias("fact"))
    q = facts.alias("q").join(facts.alias("o"), "t")
    return q.groupBy(F.col("q.project").alias("project"), "t").agg(F.max(F.when(F.col("q.project") == F.col("o.project"), F.col("o.fact"))).alias("gold"), F.count_if(F.col("q.project") != F.col("o.project")).alias("n_distractors"))


def d16b_trees(spark, sf):
    """Whole synthetic trees, one for each supplier: folders, notes, tasks and queries."""
    return corpus.synthetic_trees(table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("tree")), "tree")


def d17b_confusable(spark, sf):
    """Corpora of confusable projects, one for each supplier, with gold and misleading notes of each query."""
    return corpus.confusable_corpora(table(spark, sf, "supplier"), "s_suppkey")


_INGEST = """f AS (SELECT source AS root, lang AS source, 'notes/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path, text, doc_id,
  CASE WHEN doc_id % 11 = 0 THEN 'not_utf8' WHEN doc_id % 13 = 0 THEN 'empty' WHEN doc_id % 17 = 0 THEN 'unreadable' WHEN strlen(text) > 80000 THEN 'too_large' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty' END AS r FROM documents),
g AS (SELECT *, coalesce(sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
h AS (SELECT root, path, source, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, CASE WHEN before >= 80 THEN 'cap' ELSE r END AS reason FROM g),
ing AS (SELECT root, path, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN root || '_' || substr(sha1(source || '/' || path), 1, 10) END AS id,
  CASE WHEN reason IS NULL THEN least(length(body), 2001)::INT END AS body_chars, CASE WHEN reason IS NULL THEN md5(substr(body, 1, 500)) END AS text_md5, CASE WHEN reason IS NULL THEN '/' || root || '/' || source || '/notes' END AS folder FROM h)"""
_PROBES = """pb AS (SELECT CASE WHEN m % 5 = 0 THEN host || '-template' ELSE host END AS name, n_notes, m % 3 = 0 AS software, m % 4 <> 0 AS marker FROM (SELECT host, count(*) AS n_notes, max(id) AS m FROM trees GROUP BY host)),
sel AS (SELECT *, CASE WHEN software THEN 'software' WHEN regexp_matches(name, '-template$') OR regexp_matches(name, 'template-|srd|dnd5e|pathfinder|ttrpg|starter-kit|_template|awesome-') THEN 'denylist' WHEN n_notes < 2 THEN 'too_few_notes' WHEN NOT marker THEN 'no_marker' END AS reason FROM pb)"""
_WRONG = "wr AS (SELECT vault, id, bucket, count(*) FILTER (WHERE NOT coalesce(exact, false)) AS n_wrong FROM soft GROUP BY ALL)"


def _sample_sql() -> str:
    parts, prev = [], []
    for i, (name, quota) in enumerate(PLAN):
        used = " UNION ALL ".join(f"SELECT vault FROM s{j}" for j in range(i)) or "SELECT NULL AS vault WHERE false"
        parts.append(f"""s{i} AS (SELECT vault, id, bucket FROM (SELECT w.*, md5('7|{name}|' || id) AS h, row_number() OVER (PARTITION BY w.vault ORDER BY md5('7|{name}|' || id), id) AS r,
  (SELECT count(*) FROM ({used}) u WHERE u.vault = w.vault) AS used FROM wr w WHERE bucket = '{name}') WHERE r <= 6 - used ORDER BY h, id LIMIT {quota})""")
        prev.append(f"SELECT * FROM s{i}")
    return f"WITH {_WRONG}, " + ", ".join(parts) + " " + " UNION ALL ".join(prev)


SQL = {
    "b6_ingest": f"WITH {_INGEST} SELECT * FROM ing",
    "b7_reject_reasons": f"WITH {_INGEST} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM ing GROUP BY 1",
    "d1_drop_dup_text": with_views("SELECT id, vault, path_key FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM notes) WHERE c = 1", "notes"),
    "d2_depth_filter": with_views("SELECT CASE WHEN c > 1 THEN 'duplicate' WHEN len(path) > 2 THEN 'too_deep' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM notes) GROUP BY 1", "notes"),
    "d3_item_split": with_views("SELECT vault, id, path_key, split FROM items", "items"),
    "d3b_root_split": with_views("SELECT id, lang AS root, CASE WHEN n >= 3 AND rn <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || id), id) AS rn FROM notes)", "notes"),
    "d4_folder_split": with_views("""WITH u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM notes) WHERE c = 1), fs AS (SELECT vault, path_key, count(*) AS n FROM u GROUP BY ALL),
fp AS (SELECT *, CASE WHEN coalesce(sum(n) OVER (PARTITION BY vault ORDER BY md5('7|' || vault || '|' || path_key), path_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(n) OVER (PARTITION BY vault) * 0.4::DOUBLE THEN 'val' ELSE 'train' END AS split FROM fs)
SELECT vault, id, path_key, split FROM u JOIN fp USING (vault, path_key)""", "notes"),
    "d5_split_meta": with_views("""WITH s AS (SELECT vault, path_key, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'val') AS va FROM items GROUP BY ALL)
SELECT vault, count(*) AS n_dirs, count(*) FILTER (WHERE n = 1) AS singleton_dirs, round(max(n) / sum(n), 6) AS majority_share, sum(tr)::BIGINT AS n_train, sum(va)::BIGINT AS n_val, sum(CASE WHEN tr > 0 THEN va ELSE 0 END)::BIGINT AS val_in_seen_folder FROM s GROUP BY vault""", "items"),
    "d6_tree_holdout": "SELECT source AS vault, count(*) AS n, row_number() OVER (ORDER BY source DESC) <= 5 AS holdout FROM documents GROUP BY source",
    "d7_text_leak": with_views("""WITH s AS (SELECT *, CASE WHEN n >= 3 AND rn <= greatest(1, round_even(n * 0.4, 0)) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY vault, path_key) AS n, row_number() OVER (PARTITION BY vault, path_key ORDER BY md5('7|' || id), id) AS rn FROM notes))
SELECT count(*) AS n_leaked FROM (SELECT text FROM s WHERE split = 'train' INTERSECT SELECT text FROM s WHERE split = 'val')""", "notes"),
    "d8_cross_vault": "SELECT min(doc_id) AS first_id, count(DISTINCT source) AS vaults, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1",
    "d8b_cross_vault_near": with_views("WITH u AS (SELECT id, vault, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS l FROM vecs) SELECT x.id AS a, y.id AS b, round(list_inner_product(x.vector, y.vector) / (x.l * y.l), 6) AS cos FROM u x JOIN u y ON x.id < y.id AND x.vault <> y.vault WHERE round(list_inner_product(x.vector, y.vector) / (x.l * y.l), 6) >= 0.45", "vecs"),
    "d9_classify": f"WITH {_FILES} SELECT repo, n_files, n_code, manifests, md_in_docs_frac, manifests <> '' OR n_code > 30 AS is_software FROM (SELECT repo, count(*) AS n_files, count(*) FILTER (WHERE {_IS_CODE}) AS n_code, coalesce(array_to_string(list_sort(list_distinct(list(lower(string_split(path, '/')[-1])) FILTER (WHERE {_IS_MANIFEST}))), ','), '') AS manifests, round_even(count(*) FILTER (WHERE path = 'docs/guide.md') / greatest(count(*) FILTER (WHERE path LIKE '%.md'), 1), 3) AS md_in_docs_frac FROM files GROUP BY repo)",
    "d10_select": with_views(f"WITH {_PROBES}, k AS (SELECT name, n_notes, row_number() OVER (ORDER BY n_notes, name) - 1 AS i, count(*) OVER () AS n FROM sel WHERE reason IS NULL) SELECT name, n_notes FROM k WHERE i IN (SELECT (j * (SELECT count(*) FROM sel WHERE reason IS NULL)) // 7 FROM range(7) t(j))", "trees"),
    "d11_funnel": with_views(f"WITH {_PROBES} SELECT coalesce(reason, 'usable') AS reason, count(*) AS n, sum(n_notes)::BIGINT AS notes FROM sel GROUP BY 1", "trees"),
    "d12_stratified_sample": with_views(_sample_sql(), "verdicts"),
    "d12b_pinned_sample": with_views(f"WITH {_WRONG}, k AS (SELECT vault, id, id < 60 AS p, row_number() OVER (ORDER BY id < 60 DESC, md5('7|' || id), id) AS r FROM wr) SELECT vault, id FROM k WHERE r <= 30 OR p", "verdicts"),
    "d13_class_sample": "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('7|' || doc_id), doc_id) AS r FROM labels) WHERE r <= 20",
    "d14_wrong_pool": with_views("SELECT vault, id, count(*) AS n_wrong, arg_min(coalesce(pred, 'none'), md5('7|' || id || '|' || arm)) AS shown FROM soft WHERE NOT coalesce(exact, false) GROUP BY vault, id", "verdicts"),
    "d15_annotator_order": "SELECT item_id, annotator, row_number() OVER (PARTITION BY annotator ORDER BY md5('7/' || annotator || '/gold/' || item_id)) AS place FROM benchmark CROSS JOIN (VALUES ('ann'), ('bob')) a(annotator)",
    "d16_synthetic": "SELECT 'task_' || substr(sha1(lower(n_name) || '/' || t), 1, 10) AS id, '/work/' || replace(lower(n_name), ' ', '-') || '/' || topic AS gold, 'Note ' || t || ' on ' || topic || ' of ' || lower(n_name) AS text, t >= 8 AS twin FROM nation CROSS JOIN (SELECT t, ['budget', 'results', 'meeting', 'ideas'][t % 4 + 1] AS topic FROM range(12) r(t))",
    "d16b_trees": """WITH tr AS (SELECT DISTINCT 's' || s_suppkey AS tree FROM supplier), tp AS (SELECT ['budget', 'results', 'meeting', 'ideas', 'plans'] AS tp),
f AS (SELECT *, t - CASE WHEN t < 3 THEN 0 WHEN t < 18 THEN 3 WHEN t < 30 THEN 18 ELSE 30 END AS i FROM tr, tp, range(34) r(t)),
facts AS (SELECT tree, 'fact' AS kind, tree || ':' || t AS id, t, CASE WHEN t = 0 THEN '/personal/health' WHEN t = 1 THEN '/personal/family' WHEN t = 2 THEN '/inbox' WHEN t < 30 THEN '/work/' || tree || '/' || tp[i % 5 + 1] ELSE '/work/' || tree || '/' || tp[(i + 1) % 5 + 1] END AS path_key,
  CASE WHEN t = 0 THEN 'My health' WHEN t = 1 THEN 'My family' WHEN t = 2 THEN 'Unsorted of ' || tree WHEN t < 18 THEN 'Only here: ' || i || ' of ' || tree ELSE 'Point ' || i || ' on ' || tp[i % 5 + 1] || ' of ' || tree END AS text, CASE WHEN t >= 18 THEN 'twin' || i END AS twin_key FROM f),
d AS (SELECT tree, CASE WHEN t < 5 THEN ['/personal', '/personal/health', '/personal/family', '/inbox', '/work'][t + 1] WHEN t = 5 THEN '/work/' || tree ELSE '/work/' || tree || '/' || tp[t - 5] END AS p FROM tr, tp, range(11) r(t)),
q AS (SELECT *, t % 12 AS i FROM tr, tp, range(16) r(t))
SELECT tree, kind, id, path_key, text, twin_key, NULL AS gold, NULL::BIGINT AS n_distractors FROM facts
UNION ALL SELECT tree, 'task', 'task_' || substr(sha1(id), 1, 10), path_key, text, twin_key, path_key, NULL FROM facts WHERE t < 30
UNION ALL SELECT tree, 'dir', tree || p, p, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT tree, 'query', tree || '?' || t, NULL, 'What of ' || lower('Point ' || i || ' on ' || tp[i % 5 + 1] || ' of ' || tree) || '?', 'twin' || i, tree || ':' || (i + 18) || CASE WHEN i < 4 THEN ',' || tree || ':' || (i + 30) ELSE '' END, CASE WHEN t < 12 THEN (SELECT count(*) FROM tr) - 1 ELSE 0 END FROM q""",
    "d17b_confusable": """WITH co AS (SELECT DISTINCT s_suppkey::VARCHAR AS c FROM supplier),
f AS (SELECT c, t, (t - 8) // 12 AS p, (t - 8) % 12 AS k FROM co, range(104) r(t)),
q AS (SELECT c, t, CASE WHEN t < 64 THEN 'project' WHEN t < 69 THEN 'global' WHEN t < 75 THEN 'mixed' WHEN t < 78 THEN 'adversarial' ELSE 'identity' END AS kind, t - CASE WHEN t < 64 THEN 0 WHEN t < 69 THEN 64 WHEN t < 75 THEN 69 WHEN t < 78 THEN 75 ELSE 78 END AS i FROM co, range(79) r(t)),
w AS (SELECT *, CASE kind WHEN 'project' THEN i // 8 WHEN 'mixed' THEN i WHEN 'adversarial' THEN i WHEN 'identity' THEN 0 END AS p, CASE kind WHEN 'project' THEN i % 8 WHEN 'mixed' THEN 8 WHEN 'adversarial' THEN 9 WHEN 'identity' THEN 11 ELSE i END AS k FROM q),
x AS (SELECT w.c, w.t, string_agg(w.c || ':' || o.o || ':' || k, ',' ORDER BY o.o) AS distractors FROM w, range(8) o(o) WHERE CASE kind WHEN 'global' THEN true WHEN 'adversarial' THEN o.o > p AND o.o <= p + 2 WHEN 'identity' THEN o.o = 1 ELSE o.o <> p END GROUP BY ALL)
SELECT c AS corpus, 'fact' AS kind, CASE WHEN t < 8 THEN c || ':g:' || t ELSE c || ':' || p || ':' || k END AS id, CASE WHEN t >= 8 THEN 'p' || p END AS project, CASE WHEN t < 8 THEN 'Rule ' || t ELSE 'Setting ' || k || ' is ' || CASE WHEN k = 11 THEN 0 ELSE (p * 13 + k * 7) % 10 END END AS text, NULL AS gold, NULL AS distractors FROM f
UNION ALL SELECT c, kind, c || '?' || t, 'p' || p, CASE WHEN kind = 'global' THEN 'Which is rule ' || i || '?' WHEN kind = 'adversarial' THEN 'It is not so elsewhere: what is setting ' || k || '?' ELSE 'What is setting ' || k || '?' END,
  CASE kind WHEN 'global' THEN c || ':g:' || i WHEN 'mixed' THEN c || ':' || p || ':' || k || ',' || c || ':g:' || i ELSE c || ':' || p || ':' || k END, distractors FROM w JOIN x USING (c, t)""",
    "d17_collisions": "SELECT lower(r_name) AS project, t, lower(r_name) || ':' || t AS gold, (SELECT count(*) FROM region) - 1 AS n_distractors FROM region CROSS JOIN range(6) r(t)",
}
QUERIES = {k: f for k, f in globals().items() if k in SQL}

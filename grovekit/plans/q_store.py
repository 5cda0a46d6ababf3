"""Queries of the note store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import DEFAULT_ROOTS, path_key, path_prefixes
from ..operators import policies, store
from ..sources.scratch import Scratch
from .views import held, notes, table, trees, vecs, with_views


def ops(spark, sf):
    """Events as operations on the note of their user."""
    e = table(spark, sf, "events")
    name = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "ADD"), ("click", "UPDATE"), ("view", "NOOP"), ("error", "DELETE"), ("purchase", "MOVE")) for x in p]), F.col("event_type"))
    root = F.element_at(F.array(*map(F.lit, DEFAULT_ROOTS)), (F.col("event_id") % 5 + 1).cast("int"))
    path = F.when(F.col("event_type").isin("signup", "purchase"), F.array(root, F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string"))))
    text = F.when(F.col("event_type").isin("signup", "click"), F.concat(F.lit("note "), F.col("event_id").cast("string")))
    return e.select(F.col("event_id").alias("seq"), name.alias("op"), F.col("user_id").cast("string").alias("fact_id"), text.alias("text"), path.alias("path"), F.lit(None).cast("string").alias("project"), (F.col("event_id") % 3 == 0).alias("hard"))


def a6_mkdir(spark, sf):
    """Folders of all pages that are not there yet; those of the first level are."""
    made = trees(spark, sf).select(F.explode(path_prefixes(F.col("path"))).alias("p")).select(path_key(F.col("p")).alias("path_key"), F.size("p").alias("depth")).dropDuplicates(["path_key"])
    return made.join(made.filter("depth = 1").select("path_key"), "path_key", "left_anti")


def a13_fold_state(spark, sf):
    s = store.state(store.log(ops(spark, sf)))
    return s.select("id", "text", path_key(F.col("path")).alias("path_key"), "project", "valid", "revision")


def a14_ops_log(spark, sf):
    return store.log(ops(spark, sf)).select("seq", "op", "fact_id", "error")


def a15_snapshot(spark, sf):
    s = store.state(store.log(ops(spark, sf)))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid_count"), F.sum("revision").alias("revisions"), F.countDistinct("path").alias("dirs"))


def a7_add_times(spark, sf):
    """When notes were said, made and last changed: a note without a time of its own gets that of its operation."""
    o = ops(spark, sf).withColumn("ts", F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("seq")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("t", F.when(F.col("seq") % 4 == 0, F.lit("")).when(F.col("seq") % 4 == 1, F.lit("2001-02-03T04:05:06Z")))
    return store.state(store.log(o)).select("id", "t", "created_at", "updated_at", "revision")


def _ran(spark, sf):
    """The operations that can run, in two batches by time."""
    o = store.with_fields(ops(spark, sf)).select(*store.OPS.names)
    done = held(store.log(o).filter("error IS NULL").select(*store.OPS.names))
    last = done.agg(F.max("seq")).first()[0] or 0
    return [done.filter((F.col("seq") > last / 2) == late) for late in (False, True)]


def _applied(spark, sf):
    """A store after two batches, opened again for each; a snapshot is taken on the way."""
    root = Scratch(spark).root
    for batch in _ran(spark, sf):
        store.Store(spark, root=root, snapshot_after=2, clock=lambda: "2024-01-01T00:00:00Z").apply_ops(batch, manager="m")
    return store.Store(spark, root=root)


def a12_apply_ops(spark, sf):
    """Notes of the store: a snapshot and the log after it."""
    return _applied(spark, sf).facts.select("id", "text", path_key(F.col("path")).alias("path_key"), "project", "valid", "revision")


def a14b_store_log(spark, sf):
    """What the store's log says, with the texts before and after each operation."""
    o = _applied(spark, sf).ops_log()
    return o.select((F.col("seq") % (1 << 32)).alias("seq"), "op", "fact_id", F.array_join("target_ids", ",").alias("targets"), "before_text", "after_text", "project", "manager", "ts")


def a16_meta(spark, sf):
    """Folders below roots of one's own, the segments of the customers, and the store's policy."""
    c = table(spark, sf, "customer")
    path = F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    s = store.Store(spark, roots=sorted(r[0] for r in c.select(F.lower("c_mktsegment")).distinct().collect()), root=Scratch(spark).root)
    s.apply_ops(c.select(F.col("c_custkey").cast("long").alias("seq"), F.lit("ADD").alias("op"), F.col("c_custkey").cast("string").alias("fact_id"), F.col("c_name").alias("text"), path.alias("path")))
    s.set_meta("SOURCE", "customer")
    again = store.Store(spark, root=s.root)
    notes_in = again.facts.groupBy(path_key(F.col("path")).alias("path_key")).agg(F.count(F.lit(1)).alias("n"))
    roots = F.array(*map(F.lit, again.roots))
    return again.dirs.join(notes_in, "path_key", "left").select("path_key", (F.size("path") == 1).alias("is_root"), F.array_contains(roots, F.get("path", F.lit(0))).alias("known"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(again.conflict_policy()).alias("policy"), F.lit(again.get_meta("SOURCE")).alias("source"))


def a17_latest_vector(spark, sf):
    """Vectors written again and again under one id: the last one stays, and is void if the note's text changed, or if the note was
    deleted for good. Half of the updates say the text that was there already."""
    v = vecs(spark, sf).select((F.col("id") % 300).cast("string").alias("id"), F.col("id").alias("at"), F.round(F.element_at("vector", 1), 6).alias("x"))
    return store.keep_latest(v, ["id"], "at").join(store.changed_texts(store.log(ops(spark, sf).withColumn("text", F.when(F.col("text").isNotNull(), F.concat(F.lit("note "), (F.col("seq") % 2).cast("string")))))), "id", "left_anti")


def b4_reads(spark, sf):
    """Valid notes by project, the ones without a project as global."""
    s = store.state(store.log(ops(spark, sf))).filter("valid")
    return s.groupBy(F.coalesce("project", F.lit("(global)")).alias("project")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def g1_always_add(spark, sf):
    return policies.always_add(notes(spark, sf)).select("id", F.array_join("ops", ",").alias("ops"))


_OPS = """ops AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'click' THEN 'UPDATE' WHEN 'view' THEN 'NOOP' WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'MOVE' END AS op, user_id::VARCHAR AS fact_id,
  CASE WHEN event_type IN ('signup', 'click') THEN 'note ' || event_id END AS text, CASE WHEN event_type IN ('signup', 'purchase') THEN '/' || ['work', 'personal', 'inbox', 'project', 'global'][event_id % 5 + 1] || '/p' || (event_id % 7) END AS path_key,
  ['work', 'personal', 'inbox', 'project', 'global'][event_id % 5 + 1] AS root, 'p' || (event_id % 7) AS leaf, event_id % 3 = 0 AS hard FROM events),
ex AS (SELECT *, coalesce(last_value(CASE WHEN op = 'ADD' THEN true WHEN op = 'DELETE' AND hard THEN false END IGNORE NULLS) OVER (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ex FROM ops),
va AS (SELECT *, coalesce(last_value(CASE WHEN op = 'ADD' AND NOT ex THEN true WHEN op = 'DELETE' AND ex THEN false END IGNORE NULLS) OVER (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS va,
  sum(CASE WHEN op = 'ADD' AND NOT ex THEN 1 ELSE 0 END) OVER (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gen FROM ex),
lg AS (SELECT *, CASE WHEN op = 'ADD' AND ex THEN 'duplicate fact id' WHEN op IN ('UPDATE', 'MOVE', 'DELETE') AND NOT ex THEN 'fact not found' WHEN op = 'MOVE' AND NOT va THEN 'cannot move a deleted fact' END AS error FROM va),
st AS (SELECT fact_id, gen, arg_max(text, seq) FILTER (WHERE text IS NOT NULL) AS text, arg_max(path_key, seq) FILTER (WHERE path_key IS NOT NULL) AS path_key,
  arg_max(leaf, seq) FILTER (WHERE op = 'MOVE' AND root <> 'global') AS project, bool_or(op = 'DELETE' AND hard) AS gone, NOT bool_or(op = 'DELETE') AS valid, 1 + count(*) FILTER (WHERE op IN ('UPDATE', 'MOVE')) AS revision
  FROM lg WHERE error IS NULL AND op <> 'NOOP' GROUP BY ALL),
fs AS (SELECT fact_id AS id, text, path_key, project, valid, revision FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY gen DESC) AS r FROM st) WHERE r = 1 AND NOT gone)"""

_TEXTS = """tx AS (SELECT *, last_value(CASE WHEN error IS NULL AND op IN ('ADD', 'UPDATE') AND text IS NOT NULL THEN text END IGNORE NULLS) OVER (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bt FROM lg)"""
_T = "strftime(to_timestamp(1700000000 + {0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"

SQL = {
    "a6_mkdir": with_views("SELECT DISTINCT '/' || array_to_string(path[1:i], '/') AS path_key, i::INT AS depth FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM trees) WHERE i > 1", "trees"),
    "a13_fold_state": f"WITH {_OPS} SELECT * FROM fs",
    "a14_ops_log": f"WITH {_OPS} SELECT seq, op, fact_id, error FROM lg",
    "a15_snapshot": f"WITH {_OPS} SELECT count(*) AS n, count(*) FILTER (WHERE valid) AS valid_count, sum(revision)::BIGINT AS revisions, count(DISTINCT path_key) AS dirs FROM fs",
    "a7_add_times": f"""WITH {_OPS}, tt AS (SELECT fact_id, gen, min(seq) FILTER (WHERE op = 'ADD') AS a, max(seq) AS u FROM lg WHERE error IS NULL AND op <> 'NOOP' GROUP BY ALL),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY gen DESC) AS r FROM tt) WHERE r = 1)
SELECT id, CASE WHEN a % 4 = 1 THEN '2001-02-03T04:05:06Z' ELSE {_T.format('a')} END AS t, {_T.format('a')} AS created_at, {_T.format('u')} AS updated_at, revision FROM fs JOIN lt ON fact_id = id""",
    "a12_apply_ops": f"WITH {_OPS} SELECT * FROM fs",
    "a14b_store_log": f"""WITH {_OPS}, {_TEXTS} SELECT seq, op, fact_id, CASE WHEN op = 'NOOP' THEN '' ELSE fact_id END AS targets, CASE WHEN op IN ('UPDATE', 'MOVE', 'DELETE') THEN bt END AS before_text, CASE WHEN op IN ('ADD', 'UPDATE') THEN text WHEN op = 'MOVE' THEN bt END AS after_text,
 CASE WHEN op <> 'NOOP' THEN max(pj) OVER (PARTITION BY fact_id, gen, g2) END AS project, 'm' AS manager, '2024-01-01T00:00:00Z' AS ts
 FROM (SELECT *, CASE WHEN op = 'MOVE' AND root <> 'global' THEN leaf END AS pj, sum(CASE WHEN op = 'ADD' OR (op = 'MOVE' AND root <> 'global') THEN 1 ELSE 0 END) OVER (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g2 FROM tx WHERE error IS NULL)""",
    "a16_meta": """WITH p AS (SELECT '/' || lower(c_mktsegment) || '/n' || c_nationkey AS path_key, false AS is_root, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT DISTINCT '/' || lower(c_mktsegment), true, 0 FROM customer)
SELECT path_key, is_root, true AS known, n, 'append_only' AS policy, 'customer' AS source FROM p""",
    "a17_latest_vector": with_views(f"""WITH {_OPS.replace("'note ' || event_id", "'note ' || (event_id % 2)")}, {_TEXTS}
SELECT (id % 300)::VARCHAR AS id, max(id) AS at, arg_max(round(vector[1], 6), id) AS x FROM vecs WHERE (id % 300)::VARCHAR NOT IN (SELECT fact_id FROM tx WHERE error IS NULL AND (op = 'UPDATE' AND text IS DISTINCT FROM bt OR op = 'DELETE' AND hard)) GROUP BY 1""", "vecs"),
    "b4_reads": f"WITH {_OPS} SELECT coalesce(project, '(global)') AS project, count(*) AS n, min(id) AS first_id FROM fs WHERE valid GROUP BY 1",
    "g1_always_add": "SELECT doc_id AS id, 'ADD' AS ops FROM documents",
}
QUERIES = {k: f for k, f in globals().items() if k in SQL}

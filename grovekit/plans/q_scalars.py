"""Queries over paths and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .views import notes, table, trees, with_views


def _raw(spark, sf):
    """Paths with stray white space and slashes, to be put right."""
    return trees(spark, sf).select("id", F.transform("path", lambda s: F.concat(F.lit(" /"), s, F.lit("/ "))).alias("raw_path"))


def a1_normalize_path(spark, sf):
    p = P.normalize_path(F.col("raw_path"))
    return _raw(spark, sf).select("id", P.path_key(p).alias("path_key"), P.path_is_valid(p).alias("ok"))


def a2_path_key(spark, sf):
    return trees(spark, sf).select("id", P.path_key(F.col("path")).alias("path_key"))


def a3_path_prefixes(spark, sf):
    return trees(spark, sf).select("id", F.explode(P.path_prefixes(F.col("path"))).alias("p")).select("id", P.path_key(F.col("p")).alias("prefix_key"), F.size("p").alias("depth"))


def a4_validate_path(spark, sf):
    return trees(spark, sf).select("id", P.path_error(F.col("path"), ("en", "de"), 2).alias("error"))


def a5_normalize_op(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "no_operation").when(F.col("event_type") == "click", "update").otherwise(F.col("event_type")).alias("op"))
    return e.select("event_id", P.normalize_op(F.col("op")).alias("op"))


def c1_tokenize(spark, sf):
    return notes(spark, sf).select(F.explode(X.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def c2_norm_text(spark, sf):
    return notes(spark, sf).select("id", F.md5(X.norm_text(F.col("text")).cast("binary")).alias("digest"))


def c3_negation(spark, sf):
    d = table(spark, sf, "benchmark").select("item_id", F.concat(F.when(F.col("item_id") % 3 == 0, F.lit("It is not so: ")).when(F.col("item_id") % 3 == 1, F.lit("Moved from here. ")).otherwise(F.lit("")), F.col("text")).alias("text"))
    return d.select("item_id", X.has_negation(F.col("text")).alias("negated"))


def c4_slug(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.slug(F.col("text")).alias("slug"), X.id_slug(F.col("text")).alias("id_slug"))


def c5_path_for_file(spark, sf):
    t = trees(spark, sf)
    return t.select("id", P.path_key(P.path_for_file(F.lit("Web Pages"), F.col("host"), F.slice(F.col("path"), F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), 3)).alias("folder"))


def c6_natural_depth(spark, sf):
    """Folders of a file before any cap; null where the file is under no source."""
    return trees(spark, sf).select("id", F.when(F.col("host").startswith("blog."), F.greatest(F.size("path") - 1, F.lit(0))).alias("depth"))


def c7_parse_key(spark, sf):
    return trees(spark, sf).select("id", F.size(P.parse_key(F.concat(F.lit("//"), F.col("raw")))).alias("n"), F.array_join(P.parse_key(F.col("raw")), ">").alias("joined"))


def c8_path_text(spark, sf):
    return notes(spark, sf).select(P.path_text(F.col("path")).alias("path_text")).distinct()


def _pairs(spark, sf):
    """Folders of a vault against one another."""
    d = notes(spark, sf).select("vault", "path_key", "path").distinct()
    return d.select("vault", F.col("path_key").alias("a_key"), F.col("path").alias("a")).join(d.select("vault", F.col("path_key").alias("b_key"), F.col("path").alias("b")), "vault")


def c9_lcp(spark, sf):
    lcp = P.lcp_len(F.col("a"), F.col("b"))
    return _pairs(spark, sf).select("vault", "a_key", "b_key", lcp.alias("lcp"), (lcp / F.greatest(F.size("a"), F.size("b"), F.lit(1))).alias("lcp_ratio"))


def c10_soft_score(spark, sf):
    pred = F.when(F.col("b_key").contains("L0"), F.slice("b", 1, 1)).otherwise(F.col("b"))
    rel = P.soft_relation(F.col("a"), pred, "strict")
    return _pairs(spark, sf).select("vault", "a_key", "b_key", rel.alias("relation"), P.soft_hit(rel).alias("soft_hit"), P.branch_ok(F.col("a"), pred).alias("branch_ok"))


def c10b_empty_prediction(spark, sf):
    """The two ways to score a prediction of no folder."""
    none = F.array().cast("array<string>")
    a, b = (P.soft_relation(F.col("path"), none, p) for p in ("knn", "strict"))
    return notes(spark, sf).select("path_key", a.alias("knn"), P.soft_hit(a).alias("knn_hit"), b.alias("strict"), P.soft_hit(b).alias("strict_hit")).distinct()


def c11_gold_class(spark, sf):
    p = F.when(F.col("id") % 5 == 0, F.array("lang")).when(F.col("id") % 5 == 1, F.concat("path", F.array(F.lit("results")))).otherwise(F.col("path"))
    return notes(spark, sf).select(P.gold_class(p).alias("gold_class")).groupBy("gold_class").agg(F.count(F.lit(1)).alias("n"))


def c12_bucket(spark, sf):
    n = notes(spark, sf).groupBy("vault", "path_key").agg(F.count(F.lit(1)).alias("n"))
    return n.select("vault", "path_key", P.bucket(F.col("n") - 1).alias("bucket"), P.annotation_bucket(F.col("n") - 1).alias("annotation_bucket"))


def c13_parse_path(spark, sf):
    """Replies of a model, some fenced, some without a path."""
    body = F.to_json(F.struct(F.col("path").alias("path")))
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("id") % 4 == 1, F.concat(F.lit("Sure: "), body)).when(F.col("id") % 4 == 2, body).otherwise(F.lit('{"path": "no list"}'))
    return notes(spark, sf).select("id", F.array_join(X.parse_path_json(raw), "/").alias("parsed"))


def c15_prompt_hash(spark, sf):
    return notes(spark, sf).select("id", X.prompt_hash(F.col("text")).alias("prompt_sha"), X.short_sha1(F.col("path_key")).alias("path_sha"))


def c16_permalink(spark, sf):
    return trees(spark, sf).select("id", X.quote_path(F.concat(F.lit("notes of the day/"), F.array_join("path", "/"), F.lit("/a+b c.md"))).alias("link"))


def c17_denylist(spark, sf):
    d = table(spark, sf, "pages").select("page_id", F.concat(F.col("url"), F.when(F.col("page_id") % 7 == 0, F.lit("-template")).when(F.col("page_id") % 7 == 1, F.lit("/Awesome-list")).otherwise(F.lit(""))).alias("name"))
    return d.select("page_id", X.denied(F.col("name")).alias("pattern"))


def _files(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ["README.md", "main.py", "src/app.TS", "docs/guide.md", "package.json", "a/b/pom.xml", "notes/day.md", "x/Cargo.toml"])), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("repo"), "doc_id", names.alias("path"))


def c18_file_tests(spark, sf):
    p = F.col("path")
    return _files(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_or(X.is_code(p)).alias("code"), F.bool_or(X.is_manifest(p)).alias("manifest"), F.max(X.suffix(p)).alias("suffix"))


def c20_name_filters(spark, sf):
    n = notes(spark, sf).groupBy("vault").agg(F.count(F.lit(1)).alias("n"))
    has = F.lit(False)
    for o in ("src1", "SRC3"):
        has = has | F.col("vault").contains(o)
    return n.filter(~has & ~F.lower("vault").isin("src4", "src5"))


def c21_math(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("o_custkey", F.round(F.log(1 + F.col("n")), 6).alias("ln"), F.round(F.sqrt("n"), 6).alias("root"), F.bround(F.col("n") * 0.5).alias("half_even"), F.floor(F.col("n") / 3).alias("thirds"), F.abs(F.col("n") - 10).alias("dist"))


def c22_iso_time(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


def b13_legal_id(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "pages").select("page_id", "url")
    copies = F.count(F.lit(1)).over(Window.partitionBy(X.id_slug(F.col("url"))))
    return n.withColumn("copies", copies).select("page_id", X.legal_id(F.col("url"), F.col("copies"), 20).alias("legal"))


def b14_token_cost(spark, sf):
    """Tokens and cost of training on each vault; an unknown model has no price."""
    n = notes(spark, sf).groupBy("vault").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"))
    price = F.when(F.col("vault") != "src0", F.lit(0.5))
    return n.select("vault", "tokens", F.round(F.col("tokens") * 3 * price / 1e6, 9).alias("cost"))


_PAIRS = "d AS (SELECT DISTINCT vault, path_key, path FROM notes), pr AS (SELECT x.vault, x.path_key AS a_key, x.path AS a, y.path_key AS b_key, y.path AS b FROM d x JOIN d y ON x.vault = y.vault)"
_SLUG = "CASE WHEN {0} = '' THEN 'x' ELSE {0} END"
_S = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
_SLUGGED = _SLUG.format(_S)
_DENY = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{p}'" for p in X.DENYLIST) + " END"
_FILES = "files AS (SELECT source || '/' || lang AS repo, doc_id, ['README.md', 'main.py', 'src/app.TS', 'docs/guide.md', 'package.json', 'a/b/pom.xml', 'notes/day.md', 'x/Cargo.toml'][doc_id % 8 + 1] AS path FROM documents)"
_IS_CODE = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN (" + ", ".join(f"'{s}'" for s in X.CODE_SUFFIXES) + ")"
_IS_MANIFEST = "(lower(string_split(path, '/')[-1]) IN (" + ", ".join(f"'{s}'" for s in X.MANIFESTS) + ") AND length(path) - length(replace(path, '/', '')) <= 1)"
_RELATION = """CASE WHEN pred = a THEN 'exact' WHEN len(a) <= len(pred) AND pred[1:len(a)] = a THEN 'gold_prefix' WHEN len(pred) <= len(a) AND a[1:len(pred)] = pred THEN 'pred_prefix'
   WHEN a[1] = pred[1] THEN 'same_root' ELSE 'diff_root' END"""

SQL = {
    "a1_normalize_path": with_views("SELECT id, '/' || array_to_string(path, '/') AS path_key, NOT list_bool_or(list_concat([false], list_transform(path, lambda s: s IN ('', '.', '..')))) AS ok FROM trees", "trees"),
    "a2_path_key": with_views("SELECT id, '/' || array_to_string(path, '/') AS path_key FROM trees", "trees"),
    "a3_path_prefixes": with_views("SELECT id, '/' || array_to_string(path[1:i], '/') AS prefix_key, i::INT AS depth FROM (SELECT id, path, unnest(range(1, len(path) + 1)) AS i FROM trees)", "trees"),
    "a4_validate_path": with_views("SELECT id, CASE WHEN len(path) = 0 THEN 'empty path not allowed' WHEN len(path) > 2 THEN 'path depth ' || len(path) || ' exceeds max_depth=2' WHEN path[1] NOT IN ('en', 'de') THEN 'path root ' || path[1] || ' not in fixed roots' END AS error FROM trees", "trees"),
    "a5_normalize_op": "SELECT event_id, CASE event_type WHEN 'view' THEN 'NOOP' WHEN 'click' THEN 'UPDATE' END AS op FROM events",
    "c1_tokenize": "SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '(?i)[a-z0-9_./+-]+'))) AS term FROM documents) GROUP BY term",
    "c2_norm_text": r"SELECT doc_id AS id, md5(trim(regexp_replace(regexp_replace(trim(lower(text)), '[^a-z0-9.\s=+-]+', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents",
    "c3_negation": r"SELECT item_id, regexp_matches(t, '(?i)\b(not|never|no longer|doesn''t|does not|isn''t|is not|wasn''t|was not|moved (away )?from|left|quit|stopped|false|incorrect)\b') AS negated FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'It is not so: ' WHEN 1 THEN 'Moved from here. ' ELSE '' END || text AS t FROM benchmark)",
    "c4_slug": f"SELECT item_id, {_SLUGGED.format('text')} AS slug, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id_slug FROM benchmark",
    "c5_path_for_file": with_views(f"SELECT id, '/' || array_to_string(CASE WHEN len(p) <= 3 THEN p ELSE list_concat(p[1:1], p[-2:]) END, '/') AS folder FROM (SELECT id, list_concat(['web-pages', {_SLUGGED.format('host')}], list_transform(path[1:greatest(len(path) - 1, 0)], lambda s: {_SLUGGED.format('s')})) AS p FROM trees)", "trees"),
    "c6_natural_depth": with_views("SELECT id, CASE WHEN starts_with(host, 'blog.') THEN greatest(len(path) - 1, 0)::INT END AS depth FROM trees", "trees"),
    "c7_parse_key": with_views("SELECT id, len(path)::INT AS n, array_to_string(path, '>') AS joined FROM trees", "trees"),
    "c8_path_text": with_views("SELECT DISTINCT 'folder: ' || array_to_string(path, ' / ') || ' (topic: ' || translate(path[-1], '-_', '  ') || ')' AS path_text FROM notes", "notes"),
    "c9_lcp": with_views(f"WITH {_PAIRS} SELECT vault, a_key, b_key, l::INT AS lcp, l / greatest(len(a), len(b), 1) AS lcp_ratio FROM (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS l FROM pr)", "notes"),
    "c10_soft_score": with_views(f"WITH {_PAIRS} SELECT vault, a_key, b_key, {_RELATION} AS relation, ({_RELATION}) IN ('exact', 'gold_prefix', 'pred_prefix') AS soft_hit, a[1] = pred[1] AS branch_ok FROM (SELECT *, CASE WHEN contains(b_key, 'L0') THEN b[1:1] ELSE b END AS pred FROM pr)", "notes"),
    "c10b_empty_prediction": with_views("SELECT DISTINCT path_key, 'pred_prefix' AS knn, true AS knn_hit, 'empty' AS strict, false AS strict_hit FROM notes", "notes"),
    "c11_gold_class": "SELECT CASE doc_id % 5 WHEN 0 THEN 'depth1' WHEN 1 THEN 'ends_results' ELSE 'other' END AS gold_class, count(*) AS n FROM documents GROUP BY 1",
    "c12_bucket": with_views("SELECT vault, path_key, CASE WHEN count(*) <= 1 THEN '0' WHEN count(*) <= 3 THEN '1-2' WHEN count(*) <= 10 THEN '3-9' ELSE '10+' END AS bucket, CASE WHEN count(*) <= 3 THEN '1-2' WHEN count(*) <= 10 THEN '3-9' ELSE '10+' END AS annotation_bucket FROM notes GROUP BY vault, path_key", "notes"),
    "c13_parse_path": with_views("SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE array_to_string(path, '/') END AS parsed FROM notes", "notes"),
    "c15_prompt_hash": with_views("SELECT id, substr(sha256(text), 1, 16) AS prompt_sha, substr(sha1(path_key), 1, 10) AS path_sha FROM notes", "notes"),
    "c16_permalink": with_views("SELECT id, 'notes%20of%20the%20day/' || array_to_string(list_transform(path, lambda s: url_encode(s)), '/') || '/a%2Bb%20c.md' AS link FROM trees", "trees"),
    "c17_denylist": f"SELECT page_id, {_DENY} AS pattern FROM (SELECT page_id, url || CASE page_id % 7 WHEN 0 THEN '-template' WHEN 1 THEN '/Awesome-list' ELSE '' END AS name FROM pages)",
    "c18_file_tests": f"WITH {_FILES} SELECT path, count(*) AS n, bool_or({_IS_CODE}) AS code, bool_or({_IS_MANIFEST}) AS manifest, max(lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))) AS suffix FROM files GROUP BY path",
    "c20_name_filters": "SELECT source AS vault, count(*) AS n FROM documents WHERE NOT contains(source, 'src1') AND NOT contains(source, 'SRC3') AND lower(source) NOT IN ('src4', 'src5') GROUP BY source",
    "c21_math": "SELECT o_custkey, round(ln(1 + n), 6) AS ln, round(sqrt(n), 6) AS root, round_even(n * 0.5::DOUBLE, 0) AS half_even, n // 3 AS thirds, abs(n - 10) AS dist FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)",
    "c22_iso_time": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "b13_legal_id": "SELECT page_id, CASE WHEN length(b) > 43 OR c > 1 THEN substr(b, 1, 36) || '-' || substr(sha1(url), 1, 6) ELSE b END AS legal FROM (SELECT *, count(*) OVER (PARTITION BY b) AS c FROM (SELECT page_id, url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM pages))",
    "b14_token_cost": "SELECT source AS vault, sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4) * 3 * CASE WHEN source <> 'src0' THEN 0.5::DOUBLE END / 1e6, 9) AS cost FROM documents GROUP BY source",
}
QUERIES = {k: f for k, f in globals().items() if k in SQL}

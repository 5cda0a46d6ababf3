"""Views of the driver's tables as notes, folders, operations and votes; each as a DataFrame and as SQL.

``SQL`` has the same views as common table expressions for DuckDB; ``with_views`` puts those needed before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_key
from ..operators import corpus, placers
from ..sources.scratch import Scratch

VAL_FRACTION, SEED = 0.4, 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes of a vault (source) in nested folders of very different sizes."""
    d = table(spark, sf, "documents")
    lf = (F.length(F.bin(1 + F.col("doc_id") % 512)) - 1).cast("int")
    level = F.when(lf % 2 == 0, F.array("lang", F.concat(F.lit("L"), lf.cast("string")))).otherwise(F.array(F.col("lang"), F.concat(F.lit("L"), (lf - 1).cast("string")), F.concat(F.lit("S"), lf.cast("string"))))
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("vault"), "text", "lang", level.alias("path")).withColumn("path_key", path_key(F.col("path")))


def held(df: DataFrame) -> DataFrame:
    """A table that a query goes back to more than once, written once."""
    return Scratch(df.sparkSession).save(df)


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Notes without copied texts, split item by item within each folder; a written table."""
    return held(corpus.item_split(corpus.drop_copies(notes(spark, sf), "text"), ["vault", "path_key"], "id", VAL_FRACTION, SEED))


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.concat(F.lit("v"), (F.col("vec_id") % 8).cast("string")).alias("vault"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("/f"), F.col("label").cast("string")).alias("folder"))


def vec_items(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, split within each folder; a written table."""
    return held(corpus.item_split(vecs(spark, sf), ["vault", "folder"], "id", VAL_FRACTION, SEED))


def trees(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the path of their address."""
    p = table(spark, sf, "pages")
    raw = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)([^?#]*)", 2)
    return p.select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)([^?#]*)", 1).alias("host"), raw.alias("raw"), F.filter(F.split(raw, "/"), lambda s: s != "").alias("path"))


def arms(spark: SparkSession, sf: str, it: DataFrame | None = None) -> DataFrame:
    """Verdicts of three predictors for the items to place: vault, id, arm, gold, pred, support of the gold folder."""
    return placers.verdicts(it if it is not None else items(spark, sf))


SQL = {
    "notes": """notes AS (SELECT *, '/' || array_to_string(path, '/') AS path_key FROM (
  SELECT doc_id AS id, doc_id AS ord, source AS vault, text, lang,
    CASE WHEN lf % 2 = 0 THEN [lang, 'L' || lf] ELSE [lang, 'L' || (lf - 1), 'S' || lf] END AS path
  FROM (SELECT *, length(bin(1 + doc_id % 512)) - 1 AS lf FROM documents)))""",
    "items": """items AS (SELECT * EXCLUDE (n, copies, rn), CASE WHEN n >= 3 AND rn <= greatest(1, round_even(n * 0.4, 0)) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, count(*) OVER (PARTITION BY vault, path_key) AS n, row_number() OVER (PARTITION BY vault, path_key ORDER BY md5('7|' || id), id) AS rn
  FROM (SELECT *, count(*) OVER (PARTITION BY text) AS copies FROM notes) WHERE copies = 1))""",
    "vecs": """vecs AS (SELECT vec_id AS id, vec_id AS ord, 'v' || (vec_id % 8) AS vault, embedding::DOUBLE[] AS vector, '/f' || label AS folder FROM embeddings)""",
    "vec_items": """vec_items AS (SELECT * EXCLUDE (n, rn), CASE WHEN n >= 3 AND rn <= greatest(1, round_even(n * 0.4, 0)) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, count(*) OVER (PARTITION BY vault, folder) AS n, row_number() OVER (PARTITION BY vault, folder ORDER BY md5('7|' || id), id) AS rn FROM vecs))""",
    "trees": r"""trees AS (SELECT *, list_filter(string_split(raw, '/'), lambda s: s <> '') AS path FROM (
  SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/?#]+)([^?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)([^?#]*)', 2) AS raw FROM pages))""",
    "support": """support AS (SELECT vault, path_key, count(*) AS support, min(ord) AS first_ord FROM items WHERE split = 'train' GROUP BY ALL)""",
    "major": """major AS (SELECT vault, arg_max(path_key, (support, -first_ord)) AS pred FROM support GROUP BY vault)""",
    "tok": """tok AS (SELECT vault, id, ord, split, path_key, lower(unnest(regexp_extract_all(text, '(?i)[a-z0-9_./+-]+'))) AS term FROM items)""",
    "bm": """tf AS (SELECT vault, id, any_value(ord) AS ord, any_value(split) AS split, any_value(path_key) AS path_key, term, count(*) AS tf FROM tok GROUP BY vault, id, term),
dl AS (SELECT i.vault, i.id, coalesce(sum(tf), 0) AS dl FROM items i LEFT JOIN tf USING (vault, id) WHERE i.split = 'train' GROUP BY i.vault, i.id),
ix AS (SELECT vault, count(*) AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM dl GROUP BY vault),
df AS (SELECT vault, term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY vault, term),
bm AS (SELECT q.vault, q.id, d.id AS doc, d.ord AS doc_ord, d.path_key AS doc_key,
   sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM tf q JOIN tf d ON q.vault = d.vault AND q.term = d.term AND q.split = 'val' AND d.split = 'train'
 JOIN df ON df.vault = d.vault AND df.term = d.term JOIN ix ON ix.vault = d.vault JOIN dl ON dl.vault = d.vault AND dl.id = d.id
 GROUP BY ALL)""",
    "bmtop": """bmtop AS (SELECT *, row_number() OVER (PARTITION BY vault, id ORDER BY round(score, 9) DESC, doc_ord) AS rk FROM bm)""",
    "bmvote": """bmvote AS (SELECT vault, id, doc_key AS pred FROM (SELECT vault, id, doc_key, row_number() OVER (PARTITION BY vault, id ORDER BY round(sum(score), 9) DESC, min(rk)) AS r
  FROM bmtop WHERE rk <= 5 AND score > 0 GROUP BY vault, id, doc_key) WHERE r = 1)""",
    "first1": """first1 AS (SELECT vault, id, doc_key AS pred FROM bmtop WHERE rk = 1)""",
    "verdicts": """verdicts AS (SELECT v.vault, v.id, v.path_key AS gold, coalesce(s.support, 0) AS support, a.arm,
   CASE a.arm WHEN 'majority' THEN coalesce(m.pred, '/') WHEN 'bm25' THEN coalesce(b.pred, '/') ELSE f.pred END AS pred
  FROM items v CROSS JOIN (VALUES ('majority'), ('bm25'), ('first')) a(arm) LEFT JOIN support s USING (vault, path_key) LEFT JOIN major m ON m.vault = v.vault
  LEFT JOIN bmvote b ON b.vault = v.vault AND b.id = v.id LEFT JOIN first1 f ON f.vault = v.vault AND f.id = v.id WHERE v.split = 'val'),
soft AS (SELECT *, pred = gold AS exact, CASE WHEN support <= 0 THEN '0' WHEN support <= 2 THEN '1-2' WHEN support <= 9 THEN '3-9' ELSE '10+' END AS bucket,
   CASE WHEN pred IS NULL THEN 'none' WHEN pred = gold THEN 'exact' WHEN starts_with(pred || '/', gold || '/') THEN 'gold_prefix'
     WHEN pred = '/' OR starts_with(gold || '/', pred || '/') THEN 'pred_prefix' WHEN split_part(pred, '/', 2) = split_part(gold, '/', 2) THEN 'same_root' ELSE 'diff_root' END AS relation FROM verdicts)""",
}
#: The views that a view is made of.
NEEDS = {"items": ["notes"], "vec_items": ["vecs"], "support": ["items"], "major": ["support"], "tok": ["items"], "bm": ["tok"], "bmtop": ["bm"], "bmvote": ["bmtop"], "first1": ["bmtop"], "verdicts": ["major", "bmvote", "first1"]}


def with_views(query: str, *names: str) -> str:
    """A query after the views it names, and those that they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    query = query.strip()
    head = ",\n".join(SQL[n] for n in done)
    if query.upper().startswith("WITH "):
        return f"WITH {head},\n{query[5:]}"
    return f"WITH {head}\n{query}"

"""The queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_turns, read_back, with_probe
from .exact_dedup import exact_groups
from .html_text import extract
from .lm_scoring import score
from .merkle import document_leaf, fold, manifest, proof_digest
from .ngram_join import near_duplicates
from .packing import pack
from .periodic import periodic_runs, run_digests, with_echoes
from .pieces import encode
from .quality import quality_report
from .sharding import place
from .suffix_dedup import repeat_report
from .url_filter import filter_urls, fit, labelled_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_table(spark, sf_dir, "documents").select("doc_id"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(_table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and the probe -7."""
    probe = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    return read_back(format_turns(with_probe(_table(spark, sf_dir, "conversations"), -7, probe)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences, with the ids of their documents."""
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("doc_ids", F.col("pieces.doc.doc_id"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the manifest. Where 2 divides the CRC-32 of the id, line feeds are taken out of the text: its proof must fail."""
    docs = _table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(hit & F.contains("text", F.lit("\n")), document_leaf(docs, F.replace("text", F.lit("\n"), F.lit(""))))
    rows = manifest(docs, document_leaf(docs), carry={"tampered": changed})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the contract, then the model of the labelled table."""
    weights = fit(labelled_urls(spark))
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, a tenth of which are made periodic before."""
    return run_digests(periodic_runs(with_echoes(_table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lag(word) OVER o AS before, count(*) OVER (PARTITION BY doc_id) AS n,
      string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, word = before AS stutter, i <= n - 7 AND count(*) OVER (PARTITION BY doc_id, win, i <= n - 7) > 1 AS twice FROM g),
r AS (SELECT doc_id, stutter, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM c),
s AS (SELECT doc_id, sum(covered) AS n_repeat_words, sum(coalesce(stutter, false)::INT) AS n_stutter FROM r GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits, coalesce(n_lines, 0) AS n_lines,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stutter, 0) AS n_stutter
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
       OR 100 * n_stutter > 25 * n_words OR 2 * n_digits > word_chars) AS kept
FROM b
"""

OP4_SQL = r"""
WITH RECURSIVE s AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range(32) r(i)),
h AS (SELECT i, ('0x' || substr(md5('offset|' || shard), 1, 15))::BIGINT % 4099 AS o, ('0x' || substr(md5('skip|' || shard), 1, 15))::BIGINT % 4098 + 1 AS k FROM s),
a AS (SELECT list(o ORDER BY i) AS os, list(k ORDER BY i) AS ks FROM h),
f AS (SELECT 0 AS turn, list_resize([]::BOOLEAN[], 4099, false) AS taken, list_resize([]::BIGINT[], 32, 0::BIGINT) AS tried, NULL::BIGINT AS slot FROM a
  UNION ALL
  SELECT turn + 1, list_concat(taken[1:slot], [true], taken[slot + 2:]), list_concat(tried[1:turn % 32], [j + 1], tried[turn % 32 + 2:]), slot
  FROM (SELECT turn, taken, tried, j, (os[turn % 32 + 1] + j * ks[turn % 32 + 1]) % 4099 AS slot
        FROM (SELECT turn, taken, tried, os, ks, list_first(list_filter(range(tried[turn % 32 + 1], 4099), lambda j: NOT taken[(os[turn % 32 + 1] + j * ks[turn % 32 + 1]) % 4099 + 1])) AS j
              FROM f, a WHERE turn < 4099)))
SELECT doc_id, f.slot::INT AS slot, shard FROM documents d JOIN f ON f.slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 4099 JOIN s ON s.i = (f.turn - 1) % 32
"""

OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '<turn ') THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '<turn ', '<\turn ') ELSE text END AS body,
  replace(replace(replace(replace(role, '\', '\\'), ' ', '\s'), '>', '\g'), chr(10), '\n') AS name FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(name) + length(body) + 18)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, k FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op4_sharding": OP4_SQL, "op8_chat_formatting": OP8_SQL, "op9_exact_dedup": OP9_SQL}

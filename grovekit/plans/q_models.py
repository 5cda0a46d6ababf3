"""Queries of what goes beside the tables: models behind a picker, files, caches, streams.

The models here are functions of the prompt, so that SQL can tell what they answer.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.paths import path_key
from ..operators import placers, policies, report, store
from ..sources import artifacts, files, tables
from ..sources.scratch import Scratch
from ..sources.vector_store import VectorStore
from .q_store import _OPS, ops
from .views import held, items, notes, table, trees, vecs, with_views

#: Where the rule of the query updates and does nothing: the cosines of the table's vectors are far below the defaults.
UPDATE_AT, NOOP_AT = 0.35, 0.45


def _bank_and_claims(spark, sf):
    """Notes that are vectors as well: those of even id are in the store, the others are claims, some of which deny."""
    n = notes(spark, sf).select("id", "ord", "text", F.when(F.col("lang") != "en", F.col("vault")).alias("project"))
    j = held(n.join(vecs(spark, sf).select("id", "vector"), "id"))
    claims = j.filter("id % 2 = 1").withColumn("text", F.when(F.col("id") % 4 == 1, F.concat(F.lit("It is not "), F.col("text"))).otherwise(F.col("text")))
    return j.filter("id % 2 = 0"), claims


def _decided(spark, sf):
    bank, claims = _bank_and_claims(spark, sf)
    return bank, policies.rule_v0(policies.retrieve(claims.drop("ord"), bank), UPDATE_AT, NOOP_AT)


def g2_rule_v0(spark, sf):
    """The rule on the five nearest notes of each claim's scope."""
    _, d = _decided(spark, sf)
    return d.select("id", F.array_join("ops", ",").alias("ops"), F.array_join("reasons", ",").alias("reasons"), F.array_join("retrieve_ids", ",").alias("retrieve_ids"))


def g4_apply(spark, sf):
    """The rule's operations with their reasons and what was retrieved, run against the store."""
    bank, d = _decided(spark, sf)
    facts = bank.select(F.col("id").cast("string").alias("id"), "text", policies.default_path(F.col("project"), F.lit(None).cast("array<string>")).alias("path"), "project", F.lit(True).alias("valid"), F.lit(1).cast("long").alias("revision"))
    done = store.log(policies.to_ops(d), facts).filter("NOT before")
    return done.select("seq", "op", "fact_id", path_key(F.col("path")).alias("path_key"), "project", "reason", F.array_join("retrieve_ids", ",").alias("retrieve_ids"), "error")


def _manager_model(prompts):
    """Replies by the claim's number; some only at the second attempt, some never."""
    out = []
    for p in prompts:
        body, _, attempt = p.rpartition("\nattempt ")
        x = json.loads(body)
        k, best = x["claim"] % 10 // 2, x["related"][0]["id"] if x["related"] else None
        if k == 0 and attempt == "0":
            out.append("I am not sure.")
        elif k == 1:
            out.append('[{"event": "DELETE", "id": "no such note"}]')
        elif k == 2 and best:
            out.append('```json\n[{"op": "UPDATE", "id": "%s", "text": "short"}]\n```' % best)
        elif k == 3:
            out.append('{"ops": [{"event": "NO_OPERATION"}]}')
        else:
            out.append('[{"operation": "add", "memory": "new"}]')
    return out


def _by_model(spark, sf):
    bank, claims = _bank_and_claims(spark, sf)
    return policies.decide_by_model(policies.retrieve(claims.drop("ord"), bank, policies.MODEL_TOP), _manager_model)


def g3_model_manager(spark, sf):
    """A model as manager: asked again once, at last the claim is added."""
    d = _by_model(spark, sf)
    first = F.get("given", F.lit(0))
    return d.select("id", F.array_join("ops", ",").alias("ops"), first["id"].alias("target"), F.length(first["text"]).alias("chars"), F.array_join("reasons", ",").alias("reasons"), "n_asked", "invalid", F.size("retrieve_ids").alias("n_shown"))


def g3b_model_stats(spark, sf):
    return policies.model_stats(_by_model(spark, sf))


def _placer_model(prompts):
    """The first folder by name, fenced; a folder below it; no path; no JSON."""
    out = []
    for p in prompts:
        x = json.loads(p)
        path = x["existing_dirs"][0].strip("/").split("/")
        out.append(["```json\n%s\n```" % json.dumps({"path": path}), "Sure: " + json.dumps({"path": [*path, "new"]}), '{"path": "none"}', "I cannot say."][x["task"] % 4])
    return out


def f7_flat_placer(spark, sf):
    it = items(spark, sf)
    f = placers.flat_placer(it.filter("split = 'val'"), it.select("vault", "path_key").distinct(), _placer_model)
    return f.select("vault", "id", "gold", "pred", "parsed", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).alias("exact"))


def c14_parse_ops(spark, sf):
    """Replies of every kind, by the number of the item; s1 is the note that they may name."""
    replies = ['[{"event":"UPDATE","id":"s1","text":"two dogs"}]', '```json\n[{"op":"update","old_memory":"Andrew  adopted BUDDY.","new_memory":"x"}]\n```', '[{"event":"NO_OPERATION"}]', "not json", '[{"event":"DELETE","id":"zz"}]', '{"ops":[{"operation":"add","memory":"m"}]}', '[{"text":"x"}]', '[{"event":"hop"}]', '[{"event":"ADD"}]']
    d = table(spark, sf, "benchmark").select("item_id", F.element_at(F.array(*map(F.lit, replies)), (F.col("item_id") % 9 + 1).cast("int")).alias("raw"))
    related = F.array(F.struct(F.lit("s1").alias("id"), F.lit("Andrew adopted Buddy.").alias("text")))
    d = d.withColumn("o", F.explode_outer(policies.parse_reply(F.col("raw"), related)))
    return d.select("item_id", "o.op", "o.id", "o.text", "o.error")


def a8b_update(spark, sf):
    """Fields of notes set by their customers' numbers, also to nothing; deleted and missing notes are refused."""
    s = store.state(store.log(ops(spark, sf)))
    k = F.col("c_custkey") % 4
    fields = F.when(k == 0, F.array(F.lit("text"))).when(k == 1, F.array(F.lit("path"), F.lit("project"))).when(k == 2, F.array(F.lit("kind"), F.lit("t"))).otherwise(F.array(F.lit("parent_id"), F.lit("confidence")))
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), fields.alias("fields"), F.col("c_name").alias("text"), F.array(F.lit("work"), F.lower("c_mktsegment")).alias("path"), F.lit(None).cast("string").alias("project"), F.lit("idea").alias("kind"),
        F.lit("2024-02-01T00:00:00Z").alias("t"), F.lit("p0").alias("parent_id"), F.lit(None).cast("string").alias("episode_id"), F.lit(0.5).alias("confidence"),
    )
    return store.update_fields(s, c).select("id", "text", path_key(F.col("path")).alias("path_key"), "project", "kind", "t", "parent_id", "confidence", "valid", "revision", "error")


def _vectors(spark, sf):
    """Two models' vectors of notes, with gaps."""
    v = vecs(spark, sf).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, F.lit("m2")).otherwise(F.lit("m1")).alias("model"), "vector")
    gone = vecs(spark, sf).filter("id % 5 = 0").select(F.col("id").cast("string").alias("id"))
    return store.delete_vectors(v, gone, "m1")


def a17b_aligned(spark, sf):
    """Notes with their vector of a model, or none, after some were deleted."""
    facts = notes(spark, sf).select(F.col("id").cast("string").alias("id"))
    return store.aligned_vectors(facts, _vectors(spark, sf), "m1").select("id", F.round(F.element_at("vector", 1), 6).alias("x"))


def a18_migrate(spark, sf):
    """Notes of an older layout: revision 1, and no parent, episode or confidence."""
    old = notes(spark, sf).select(F.col("id").cast("string").alias("id"), "text", "path", F.col("vault").alias("project"), F.lit(True).alias("valid"), F.lit("claim").alias("kind"))
    return store.with_fields(old, store.FACTS).select("id", path_key(F.col("path")).alias("path_key"), "project", "valid", "revision", "kind", "t", "parent_id", "confidence")


def o4_place_gold(spark, sf):
    """Pages as tasks, each put where it belongs."""
    t = trees(spark, sf).select(F.col("id").alias("ord"), "id", F.col("raw").alias("text"), F.concat(F.array(F.lit("inbox")), F.slice("path", 1, 2)).alias("gold_path"))
    done = store.log(report.place_gold(t))
    return store.state(done).select("id", path_key(F.col("path")).alias("path_key"), F.md5(F.col("text").cast("binary")).alias("text"), "valid")


def o7_pooled_sft(spark, sf):
    """Dialogues of all vaults, both splits; the texts of JSON differ between engines, what they parse to does not."""
    it = items(spark, sf)
    rows = report.pooled_sft(it.withColumn("kind", F.lit("place")), it.select("vault", "path"), "Roots {roots}, depth {max_depth}.")
    m = F.col("messages")
    user = F.from_json(F.substring_index(m[1]["content"], "\n\nChoose", 1), "task string, fact_text string, existing_dirs array<string>")
    answer = F.from_json(m[2]["content"], "path array<string>, confidence double")
    return rows.select("vault", "id", "split", m[0]["content"].alias("system"), F.md5(user["fact_text"].cast("binary")).alias("note"), F.size(user["existing_dirs"]).alias("n_folders"), F.array_join(answer["path"], "/").alias("path"), answer["confidence"].alias("confidence"), "meta.root")


def b1_json_lines(spark, sf):
    """Written as JSON lines and read by a fixed schema."""
    path = f"{Scratch(spark).root}/lines"
    tables.write_json_lines(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.array(F.lit("work"), F.concat(F.lit("p"), F.col("item_id") % 3)).alias("gold_path")), path)
    return tables.read_json_lines(spark, path).select("id", F.md5(F.col("text").cast("binary")).alias("text"), path_key(F.col("gold_path")).alias("path_key"), "kind")


def b5_directory_walk(spark, sf):
    """Files in folders, one of which is to be skipped: their number and size by folder."""
    path = f"{Scratch(spark).root}/walk"
    table(spark, sf, "benchmark").select(F.translate("text", "\n", " ").alias("value"), F.concat(F.lit("d"), F.col("item_id") % 5).alias("dir")).write.partitionBy("dir").text(path)
    found = files.scan_files(spark, path, (".txt",), ("dir=d4",))
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def b8_sheet(spark, sf):
    """A sheet with quotes and line breaks, read again; blank verdicts are skipped."""
    path = f"{Scratch(spark).root}/sheet"
    verdict = F.when(F.col("quality") == 1, F.lit("ok")).when(F.col("toxic") == 1, F.lit("bad")).otherwise(F.lit(""))
    tables.write_sheet(table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("item"), F.concat(F.lit('say "'), F.col("doc_id"), F.lit('",\nthen stop')).alias("comment"), verdict.alias("verdict")), path)
    return tables.check_values(tables.read_sheet(spark, path), "verdict", ["ok", "bad"])


def _embed(texts):
    return [[float(len(t)), 3.0, 4.0] for t in texts]


def _seeded(spark, sf):
    """A store that has the texts of benchmark items of even number."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    s = VectorStore(spark, Scratch(spark).root, _embed)
    s.put(b.filter("item_id % 2 = 0").groupBy("text").agg(F.array(F.min("item_id").cast("double"), F.lit(1.0), F.lit(0.0)).alias("vector")))
    return b, s


def b10_vector_cache(spark, sf):
    """Texts of even number are in the store, the others are embedded."""
    b, s = _seeded(spark, sf)
    return s.lookup(b).select("item_id", F.round(F.element_at("vector", 1), 6).alias("x"), F.round(F.element_at("vector", 2), 6).alias("y"))


def b10b_kept_vectors(spark, sf):
    """What was embedded is there for a store that cannot embed; texts set anew have their new vector."""
    b, s = _seeded(spark, sf)
    s.lookup(b)
    s.put(b.filter("item_id % 10 = 3").groupBy("text").agg(F.array(F.lit(0.0), F.lit(2.0), F.lit(0.0)).alias("vector")))
    again = VectorStore(spark, s.root)
    held_texts = again.entries().select("text").distinct().count()
    return again.lookup(b).select("item_id", F.round(F.element_at("vector", 1), 6).alias("x"), F.round(F.element_at("vector", 2), 6).alias("y"), F.lit(held_texts).alias("n_texts"), F.lit(len(again.versions())).alias("n_versions"))


def b15_artifacts(spark, sf):
    """A run's summary is made once; a later run reads it, whatever it would make itself."""
    root, e = Scratch(spark).root, table(spark, sf, "events")
    for rows in (e, e.filter("event_id % 2 = 0")):
        out = artifacts.kept(spark, root, "summary", lambda rows=rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")))
    return out


def g5_registry(spark, sf):
    """What the policies decide that go by these names."""
    bank, claims = _bank_and_claims(spark, sf)
    near = held(policies.retrieve(claims.drop("ord"), bank))
    out = None
    for name, more in (("AlwaysADD", ()), ("append_only", ()), ("Rule_V0", (UPDATE_AT, NOOP_AT)), ("rule", (0.99, 0.999))):
        d = policies.policy(name)(near, *more).select(F.explode("ops").alias("op")).groupBy(F.lit(name).alias("name"), "op").agg(F.count(F.lit(1)).alias("n"))
        out = d if out is None else out.unionByName(d)
    return out


def s1_stream_fold(spark, sf):
    """The notes after the log has come as a stream, in three parts by time, each to a new process."""
    from ..streaming.fold import StreamFold

    root = Scratch(spark).root
    o = store.with_fields(ops(spark, sf)).select(*store.OPS.names)
    last = o.agg(F.max("seq")).first()[0] or 0
    for i in range(3):
        o.filter(F.least(F.lit(2), F.floor(3 * F.col("seq") / (last + 1))) == i).write.mode("append").parquet(f"{root}/in")
        StreamFold(spark, f"{root}/state").run(spark.readStream.schema(store.OPS).parquet(f"{root}/in"))
    return StreamFold(spark, f"{root}/state").facts().select("id", "text", path_key(F.col("path")).alias("path_key"), "project", "valid", "revision")


_NEG = r"regexp_matches({0}, '(?i)\b(not|never|no longer|doesn''t|does not|isn''t|is not|wasn''t|was not|moved (away )?from|left|quit|stopped|false|incorrect)\b')"
_NORM = r"trim(regexp_replace(regexp_replace(trim(lower({0})), '[^a-z0-9.\s=+-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_DEC = f"""j AS (SELECT n.id, n.ord, n.text, CASE WHEN lang <> 'en' THEN n.vault END AS project, v.vector FROM notes n JOIN vecs v ON n.id = v.id),
cl AS (SELECT id, CASE WHEN id % 4 = 1 THEN 'It is not ' || text ELSE text END AS text, project, vector FROM j WHERE id % 2 = 1),
nr AS (SELECT c.id, b.id AS doc, b.text AS dtext, list_inner_product(c.vector, b.vector) / (sqrt(list_inner_product(c.vector, c.vector)) * sqrt(list_inner_product(b.vector, b.vector))) AS sim, b.project IS NULL AS g, b.ord
  FROM cl c JOIN j b ON b.id % 2 = 0 AND (b.project IS NULL OR b.project = c.project)),
rr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, g, ord) AS rk FROM nr),
bs AS (SELECT c.id, c.text, c.project, b.doc AS best_id, b.dtext AS best, b.sim, coalesce(l.ids, '') AS retrieve_ids FROM cl c LEFT JOIN (SELECT * FROM rr WHERE rk = 1) b USING (id) LEFT JOIN (SELECT id, string_agg(doc::VARCHAR, ',' ORDER BY rk) AS ids FROM rr WHERE rk <= 5 GROUP BY id) l USING (id)),
cu AS (SELECT *, {_NEG.format('text')} OR {_NEG.format('best')} AS cue, {_NORM.format('text')} = {_NORM.format('best')} AS same, printf('%.3f', sim) AS s FROM bs),
dc AS (SELECT *, CASE WHEN best_id IS NULL THEN 'none' WHEN same OR (sim >= {NOOP_AT}::DOUBLE AND NOT cue) THEN 'noop' WHEN cue AND sim >= {UPDATE_AT}::DOUBLE - 0.08::DOUBLE THEN 'supersede' WHEN sim >= {UPDATE_AT}::DOUBLE THEN 'update' ELSE 'add' END AS how FROM cu)"""
_OF_HOW = "CASE how WHEN 'none' THEN 'ADD' WHEN 'noop' THEN 'NOOP' WHEN 'supersede' THEN 'DELETE,ADD' WHEN 'update' THEN 'UPDATE' ELSE 'ADD' END"
_WHY = "CASE how WHEN 'none' THEN 'rule_v0_empty_bank' WHEN 'noop' THEN 'near_dupe_sim=' || s WHEN 'supersede' THEN 'sim=' || s || '_supersede,sim=' || s || '_supersede_add' WHEN 'update' THEN 'sim=' || s ELSE 'sim=' || s || '_below_update' END"
_MODEL = f"""{_DEC}, mk AS (SELECT id, text, best_id, id % 10 // 2 AS k, (SELECT count(*) FROM rr WHERE rr.id = bs.id AND rk <= 8) AS n FROM bs),
mm AS (SELECT *, CASE WHEN k = 1 THEN 'bad' WHEN k = 2 AND best_id IS NOT NULL THEN 'up' WHEN k = 3 THEN 'noop' ELSE 'add' END AS how FROM mk)"""

SQL = {
    "g2_rule_v0": with_views(f"WITH {_DEC} SELECT id, {_OF_HOW} AS ops, {_WHY} AS reasons, retrieve_ids FROM dc", "notes", "vecs"),
    "g4_apply": with_views(f"""WITH {_DEC}, oo AS (SELECT *, unnest(string_split({_OF_HOW}, ',')) AS op, unnest(string_split({_WHY}, ',')) AS reason, unnest(range(len(string_split({_OF_HOW}, ',')))) AS place FROM dc),
fo AS (SELECT id * 1048576 + place AS seq, op, CASE WHEN op = 'ADD' THEN 'c' || id ELSE best_id::VARCHAR END AS fact_id, CASE WHEN op IN ('ADD', 'UPDATE') THEN CASE WHEN project IS NULL THEN '/global' ELSE '/project/' || project END END AS path_key, CASE WHEN op IN ('ADD', 'UPDATE') THEN project END AS project, reason, retrieve_ids FROM oo)
SELECT *, NULL::VARCHAR AS error FROM fo""", "notes", "vecs"),
    "g3_model_manager": with_views(f"""WITH {_MODEL} SELECT id, CASE how WHEN 'up' THEN 'UPDATE' WHEN 'noop' THEN 'NOOP' ELSE 'ADD' END AS ops, CASE WHEN how = 'up' THEN best_id::VARCHAR END AS target,
 CASE how WHEN 'bad' THEN length(text) WHEN 'up' THEN 5 WHEN 'add' THEN 3 END::INT AS chars, CASE how WHEN 'bad' THEN 'llm_invalid_fallback_add:delete_bad_id' ELSE 'llmv0' END AS reasons, CASE WHEN k IN (0, 1) THEN 2 ELSE 1 END AS n_asked, how = 'bad' AS invalid, n::INT AS n_shown FROM mm""", "notes", "vecs"),
    "g3b_model_stats": with_views(f"WITH {_MODEL} SELECT count(*) AS n_decisions, sum(CASE WHEN k IN (0, 1) THEN 2 ELSE 1 END)::BIGINT AS n_asked, count(*) FILTER (WHERE k IN (0, 1)) AS n_retries, count(*) FILTER (WHERE how = 'bad') AS n_invalid, round(count(*) FILTER (WHERE how = 'bad') / count(*), 4) AS invalid_rate FROM mm", "notes", "vecs"),
    "f7_flat_placer": with_views("WITH f AS (SELECT vault, min(path_key) AS f FROM items GROUP BY vault), p AS (SELECT vault, id, path_key AS gold, CASE id % 4 WHEN 0 THEN f WHEN 1 THEN f || '/new' END AS pred FROM items JOIN f USING (vault) WHERE split = 'val') SELECT *, pred IS NOT NULL AS parsed, coalesce(pred = gold, false) AS exact FROM p", "items"),
    "c14_parse_ops": "SELECT item_id, ['UPDATE', 'UPDATE', 'NOOP', NULL, 'DELETE', 'ADD', NULL, 'HOP', 'ADD'][item_id % 9 + 1] AS op, CASE WHEN item_id % 9 < 2 THEN 's1' END AS id, ['two dogs', 'x', NULL, NULL, NULL, 'm', 'x', NULL, NULL][item_id % 9 + 1] AS text, [NULL, NULL, NULL, NULL, 'delete_bad_id', NULL, 'missing_event', 'bad_event', 'add_missing_text'][item_id % 9 + 1] AS error FROM benchmark",
    "a8b_update": f"""WITH {_OPS}, b AS (SELECT f.*, c_custkey, c_name, c_mktsegment, c_custkey % 4 AS k, coalesce(f.id, c_custkey::VARCHAR) AS i, CASE WHEN c_custkey IS NULL THEN NULL WHEN f.id IS NULL THEN 'fact not found' WHEN NOT valid THEN 'cannot update a deleted fact' END AS error FROM fs f FULL JOIN customer c ON f.id = c_custkey::VARCHAR), m AS (SELECT *, c_custkey IS NOT NULL AND error IS NULL AS made FROM b)
SELECT i AS id, CASE WHEN made AND k = 0 THEN c_name ELSE text END AS text, CASE WHEN made AND k = 1 THEN '/work/' || lower(c_mktsegment) ELSE path_key END AS path_key, CASE WHEN made AND k = 1 THEN NULL ELSE project END AS project, CASE WHEN made AND k = 2 THEN 'idea' WHEN id IS NOT NULL THEN 'claim' END AS kind,
 CASE WHEN made AND k = 2 THEN '2024-02-01T00:00:00Z' END AS t, CASE WHEN made AND k = 3 THEN 'p0' END AS parent_id, CASE WHEN made AND k = 3 THEN 0.5::DOUBLE END AS confidence, valid, revision + made::INT AS revision, error FROM m""",
    "a17b_aligned": with_views("SELECT n.id::VARCHAR AS id, round(v.vector[1], 6) AS x FROM notes n LEFT JOIN vecs v ON v.id = n.id AND v.id % 3 <> 0 AND v.id % 5 <> 0", "notes", "vecs"),
    "a18_migrate": with_views("SELECT id::VARCHAR AS id, path_key, vault AS project, true AS valid, 1::BIGINT AS revision, 'claim' AS kind, NULL::VARCHAR AS t, NULL::VARCHAR AS parent_id, NULL::DOUBLE AS confidence FROM notes", "notes"),
    "o4_place_gold": with_views("SELECT 'f_' || id AS id, '/inbox' || CASE WHEN len(path) > 0 THEN '/' || array_to_string(path[1:2], '/') ELSE '' END AS path_key, md5(raw) AS text, true AS valid FROM trees WHERE raw <> ''", "trees"),
    "o7_pooled_sft": with_views("""WITH v AS (SELECT vault, count(DISTINCT path_key) AS n, max(len(path)) AS d, '["' || string_agg(DISTINCT path[1], '","' ORDER BY path[1]) || '"]' AS r FROM items GROUP BY vault)
SELECT vault, id, split, 'Roots ' || r || ', depth ' || d || '.' AS system, md5(text) AS note, n::INT AS n_folders, array_to_string(path, '/') AS path, 0.9::DOUBLE AS confidence, path[1] AS root FROM items JOIN v USING (vault)""", "items"),
    "b1_json_lines": "SELECT item_id::VARCHAR AS id, md5(text) AS text, '/work/p' || (item_id % 3) AS path_key, NULL::VARCHAR AS kind FROM benchmark",
    "b5_directory_walk": "SELECT 'dir=d' || (item_id % 5) AS folder, 1::BIGINT AS n, sum(strlen(text) + 1)::BIGINT AS bytes FROM benchmark WHERE item_id % 5 <> 4 GROUP BY 1",
    "b8_sheet": "SELECT doc_id::VARCHAR AS item, 'say \"' || doc_id || '\",' || chr(10) || 'then stop' AS comment, CASE WHEN quality = 1 THEN 'ok' ELSE 'bad' END AS verdict FROM labels WHERE quality = 1 OR toxic = 1",
    "b10_vector_cache": "WITH c AS (SELECT text, min(item_id)::DOUBLE AS x FROM benchmark WHERE item_id % 2 = 0 GROUP BY text) SELECT item_id, round(CASE WHEN c.x IS NOT NULL THEN c.x / (sqrt(c.x * c.x + 1) + 1e-9) ELSE length(b.text) / (sqrt(length(b.text) * length(b.text) + 25) + 1e-9) END, 6) AS x, round(CASE WHEN c.x IS NOT NULL THEN 1 / (sqrt(c.x * c.x + 1) + 1e-9) ELSE 3 / (sqrt(length(b.text) * length(b.text) + 25) + 1e-9) END, 6) AS y FROM benchmark b LEFT JOIN c USING (text)",
    "b10b_kept_vectors": "WITH c AS (SELECT text, min(item_id) FILTER (WHERE item_id % 2 = 0)::DOUBLE AS x, bool_or(item_id % 10 = 3) AS anew FROM benchmark GROUP BY text) SELECT item_id, round(CASE WHEN anew THEN 0 WHEN c.x IS NOT NULL THEN c.x / (sqrt(c.x * c.x + 1) + 1e-9) ELSE length(b.text) / (sqrt(length(b.text) * length(b.text) + 25) + 1e-9) END, 6) AS x, round(CASE WHEN anew THEN 2 / (2 + 1e-9) WHEN c.x IS NOT NULL THEN 1 / (sqrt(c.x * c.x + 1) + 1e-9) ELSE 3 / (sqrt(length(b.text) * length(b.text) + 25) + 1e-9) END, 6) AS y, (SELECT count(*) FROM c) AS n_texts, 3 AS n_versions FROM benchmark b JOIN c USING (text)",
    "b15_artifacts": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type",
    "g5_registry": with_views(f"""WITH {_DEC}, ru AS (SELECT unnest(string_split({_OF_HOW}, ',')) AS op FROM dc), dd AS (SELECT *, CASE WHEN best_id IS NULL THEN 'none' WHEN same OR (sim >= 0.999::DOUBLE AND NOT cue) THEN 'noop' WHEN cue AND sim >= 0.99::DOUBLE - 0.08::DOUBLE THEN 'supersede' WHEN sim >= 0.99::DOUBLE THEN 'update' ELSE 'add' END AS how2 FROM cu),
 r2 AS (SELECT unnest(string_split({_OF_HOW.replace('CASE how', 'CASE how2')}, ',')) AS op FROM dd), every AS (SELECT 'AlwaysADD' AS name, 'ADD' AS op FROM cl UNION ALL SELECT 'append_only', 'ADD' FROM cl UNION ALL SELECT 'Rule_V0', op FROM ru UNION ALL SELECT 'rule', op FROM r2)
SELECT name, op, count(*) AS n FROM every GROUP BY ALL""", "notes", "vecs"),
    "s1_stream_fold": f"WITH {_OPS} SELECT * FROM fs",
}
QUERIES = {k: f for k, f in globals().items() if k in SQL}

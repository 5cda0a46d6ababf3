"""Write policies: what to do with a claim, given the notes that it resembles.

Claims (id, text, project, vector) are first given the notes near them (``retrieve``), then a policy decides on ``ops``, and
``to_ops`` makes operations of the store of its decisions. Decisions are made against the store as it was before the batch:
claims of one batch do not see one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_negation, norm_text, strip_fence
from ..sources.scratch import Scratch
from .retrieval import cosine_scores, top_k

UPDATE_AT, NOOP_AT, SUPERSEDE_SLACK = 0.88, 0.97, 0.08
#: Notes that a rule, and a model, is shown.
RULE_TOP, MODEL_TOP = 5, 8


def retrieve(claims: DataFrame, bank: DataFrame, top: int = RULE_TOP) -> DataFrame:
    """Claims with related: the ``top`` nearest notes of their scope, nearest first, as structs of id, text and sim; and
    retrieve_ids, best_id, best_text, sim of the first (null without any).

    claims: id, project, vector, ...; bank: id, ord, text, project, vector. The scope of a claim is its project and the
    notes without one; of a claim without a project the latter alone. Of equals, notes of the project come first, then
    the earlier ones.
    """
    own, common = bank.filter("project IS NOT NULL"), bank.filter("project IS NULL").drop("project")
    q = claims.select(F.col("id"), "project", "vector")
    near = cosine_scores(own.select("project", "id", "ord", "vector"), q.filter("project IS NOT NULL"), "project", top).select("id", "doc", F.struct(F.lit(0).alias("g"), F.col("doc_ord").alias("o")).alias("doc_ord"), "score")
    far = cosine_scores(common.select("id", "ord", "vector"), q.select("id", "vector"), None, top).select("id", "doc", F.struct(F.lit(1).alias("g"), F.col("doc_ord").alias("o")).alias("doc_ord"), "score")
    best = top_k(near.unionByName(far), ["id"], top).join(bank.select(F.col("id").alias("doc"), "text"), "doc")
    listed = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", F.col("doc").alias("id"), "text", F.col("score").alias("sim")))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["sim"].alias("sim"))).alias("related"))
    out = claims.join(listed, "id", "left")
    first = F.get("related", F.lit(0))
    ids = F.coalesce(F.transform("related", lambda x: x["id"].cast("string")), F.array().cast("array<string>"))
    return out.withColumns({"retrieve_ids": ids, "best_id": first["id"], "best_text": first["text"], "sim": first["sim"]})


def always_add(claims: DataFrame) -> DataFrame:
    return claims.withColumn("ops", F.array(F.lit("ADD"))).withColumn("reasons", F.array(F.lit("always_add")))


def rule_v0(best: DataFrame, update_at: float = UPDATE_AT, noop_at: float = NOOP_AT) -> DataFrame:
    """Adds ops, and a reason for each, to claims with their best note (text, best_id, best_text, sim; best_id null if none)."""
    cue = has_negation(F.col("text")) | has_negation(F.col("best_text"))
    same = norm_text(F.col("text")) == norm_text(F.col("best_text"))
    one = lambda x: F.array(F.lit(x))
    s = F.format_string("%.3f", F.col("sim"))
    supersede = cue & (F.col("sim") >= update_at - SUPERSEDE_SLACK)
    noop = same | ((F.col("sim") >= noop_at) & ~cue)
    case = lambda none, a, b, c, d: F.when(F.col("best_id").isNull(), none).when(noop, a).when(supersede, b).when(F.col("sim") >= update_at, c).otherwise(d)
    return best.withColumns({
        "ops": case(one("ADD"), one("NOOP"), F.array(F.lit("DELETE"), F.lit("ADD")), one("UPDATE"), one("ADD")),
        "reasons": case(
            one("rule_v0_empty_bank"), F.array(F.concat(F.lit("near_dupe_sim="), s)), F.array(F.concat(F.lit("sim="), s, F.lit("_supersede")), F.concat(F.lit("sim="), s, F.lit("_supersede_add"))),
            F.array(F.concat(F.lit("sim="), s)), F.array(F.concat(F.lit("sim="), s, F.lit("_below_update"))),
        ),
    })


def default_path(project: Column, path: Column) -> Column:
    return F.coalesce(path, F.when(project.isNull(), F.array(F.lit("global"))).otherwise(F.array(F.lit("project"), project)))


def to_ops(decided: DataFrame) -> DataFrame:
    """Operations of the store, in the order of claims and of each one's ops: seq (claim, place), op, fact_id, text, path,
    project, reason, retrieve_ids.

    decided: id (a number), text, project, path, ops, reasons, retrieve_ids, best_id; or with a column ``given`` of
    (op, id, text) where a policy names notes and texts itself. A new note has the claim's id.
    """
    has = set(decided.columns)
    given = F.col("given") if "given" in has else F.transform("ops", lambda o: F.struct(o.alias("op"), F.when(o != "ADD", F.col("best_id").cast("string")).alias("id"), F.when(o.isin("ADD", "UPDATE"), F.col("text")).alias("text")))
    each = decided.withColumn("_o", given).select("*", F.posexplode("_o").alias("place", "o"))
    op = F.col("o.op")
    path = default_path(F.col("project"), F.col("path") if "path" in has else F.lit(None).cast("array<string>"))
    writes = op.isin("ADD", "UPDATE")
    return each.select(
        (F.col("id") * (1 << 20) + F.col("place")).alias("seq"), op.alias("op"), F.when(op == "ADD", F.concat(F.lit("c"), F.col("id").cast("string"))).otherwise(F.col("o.id")).alias("fact_id"),
        F.when(writes, F.col("o.text")).alias("text"), F.when(writes, path).alias("path"), F.when(writes, F.col("project")).alias("project"), F.lit(False).alias("hard"),
        F.get("reasons", F.col("place")).alias("reason"), "retrieve_ids",
    )


_ITEM = "struct<event:string,op:string,operation:string,id:string,fact_id:string,text:string,memory:string,new_memory:string,old_memory:string,old_text:string>"


def parse_reply(raw: Column, related: Column) -> Column:
    """The operations in a model's reply, as array<struct<op, id, text, error>>; related: array<struct<id, text>>.

    An empty array stands for a reply that cannot be read or has no list. Aliases of the fields are taken; a note to
    update may be named by its old text.
    """
    text = strip_fence(raw)
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    items = F.coalesce(
        F.from_json(F.when(body != "", body), f"array<{_ITEM}>"),
        F.from_json(F.get_json_object(text, "$.ops"), f"array<{_ITEM}>"), F.from_json(F.get_json_object(text, "$.operations"), f"array<{_ITEM}>"),
        F.array().cast(f"array<{_ITEM}>"),
    )
    ids = F.transform(related, lambda r: r["id"])

    def one(x: Column) -> Column:
        named = F.upper(F.coalesce(x["event"], x["op"], x["operation"]))
        op = F.when(named.isin("NO_OPERATION", "NO-OPERATION"), F.lit("NOOP")).otherwise(named)
        given = F.coalesce(x["id"], x["fact_id"])
        given = F.when(~given.isin("null", "None", ""), given)
        old = F.coalesce(x["old_memory"], x["old_text"])
        by_text = F.get(F.transform(F.filter(related, lambda r: norm_text(r["text"]) == norm_text(old)), lambda r: r["id"]), F.lit(0))
        known = F.array_contains(ids, given)
        ident = F.when(F.coalesce(known, F.lit(False)), given).when(op == "UPDATE", by_text)
        content = F.coalesce(x["text"], F.when(op.isin("ADD", "UPDATE"), F.coalesce(x["memory"], x["new_memory"])))
        empty = F.coalesce(content, F.lit("")) == ""
        error = (
            F.when(op.isNull(), F.lit("missing_event")).when(~op.isin("ADD", "UPDATE", "DELETE", "NOOP"), F.lit("bad_event")).when((op == "ADD") & empty, F.lit("add_missing_text"))
            .when((op == "UPDATE") & ident.isNull(), F.lit("update_bad_id")).when((op == "UPDATE") & empty, F.lit("update_missing_text")).when((op == "DELETE") & ident.isNull(), F.lit("delete_bad_id"))
        )
        return F.struct(op.alias("op"), ident.alias("id"), content.alias("text"), error.alias("error"))

    return F.transform(items, one)


def model_prompt(claims: DataFrame) -> Column:
    """What a model is asked: the claim, its scope and the notes it resembles, as JSON."""
    has_path = "path" in claims.columns
    path = default_path(F.col("project"), F.col("path") if has_path else F.lit(None).cast("array<string>"))
    return F.to_json(F.struct(F.col("id").alias("claim"), F.col("text").alias("fact"), F.col("project").alias("incoming_project"), path.alias("incoming_path"), F.coalesce("related", F.array().cast("array<struct<id:string,text:string,sim:double>>")).alias("related")))


def decide_by_model(claims: DataFrame, ask: Callable[[list[str]], list[str]], retries: int = 1) -> DataFrame:
    """Adds given (op, id, text), ops, reasons, n_asked, invalid and parse_error to claims with related notes.

    A model is asked for a list of operations; a reply that cannot be read, or with a wrong operation in it, is asked for
    again up to ``retries`` times, and at last the claim is added. Only claims without a valid reply are asked for again.
    """
    from .pickers import few_prompts, with_picker

    scratch = Scratch(claims.sparkSession)
    related = F.transform(F.coalesce("related", F.array().cast("array<struct<id:string,text:string,sim:double>>")), lambda x: F.struct(x["id"].cast("string").alias("id"), x["text"].alias("text")))
    left, done = claims.withColumn("prompt", model_prompt(claims)), None
    for attempt in range(1 + max(0, retries)):
        asked = with_picker(left.withColumn("prompt", F.concat("prompt", F.lit(f"\nattempt {attempt}"))), ask).withColumn("given", parse_reply(F.col("raw"), related))
        wrong = F.get(F.filter("given", lambda x: x["error"].isNotNull()), F.lit(0))["error"]
        error = F.when(F.col("raw").isNull(), F.lit("no_reply")).when(F.size("given") == 0, F.lit("parse_fail")).otherwise(wrong)
        asked = asked.withColumns({"parse_error": error, "n_asked": F.lit(attempt + 1)})
        with few_prompts(claims.sparkSession):
            asked = scratch.save(asked.withColumn("prompt", F.regexp_replace("prompt", r"\nattempt \d+$", "")))
        good = asked.filter("parse_error IS NULL")
        done = good if done is None else done.unionByName(good)
        left = asked.filter("parse_error IS NOT NULL").select(*left.columns)
    last = asked.filter("parse_error IS NOT NULL")
    add = F.array(F.struct(F.lit("ADD").alias("op"), F.lit(None).cast("string").alias("id"), F.col("text").alias("text")))
    plain = F.transform("given", lambda x: F.struct(x["op"].alias("op"), x["id"].alias("id"), x["text"].alias("text")))
    done = done.withColumns({"invalid": F.lit(False), "given": plain, "reason": F.lit("llmv0")})
    last = last.withColumns({"invalid": F.lit(True), "given": add, "reason": F.concat(F.lit("llm_invalid_fallback_add:"), "parse_error")})
    out = done.unionByName(last)
    return out.withColumns({"ops": F.transform("given", lambda x: x["op"]), "reasons": F.transform("given", lambda x: F.col("reason"))}).drop("prompt", "raw", "reason", "picker_error")


def model_stats(decided: DataFrame) -> DataFrame:
    """n_decisions, n_asked, n_retries, n_invalid and invalid_rate."""
    n = decided.agg(F.count(F.lit(1)).alias("n_decisions"), F.coalesce(F.sum("n_asked"), F.lit(0)).alias("n_asked"), F.coalesce(F.sum(F.col("n_asked") - 1), F.lit(0)).alias("n_retries"), F.count_if("invalid").alias("n_invalid"))
    return n.withColumn("invalid_rate", F.round(F.coalesce(F.try_divide("n_invalid", "n_decisions"), F.lit(0.0)), 4))


#: The names that a policy goes by.
POLICIES = {"alwaysadd": always_add, "always_add": always_add, "append_only": always_add, "rulev0": rule_v0, "rule_v0": rule_v0, "rule": rule_v0, "llmv0": decide_by_model, "llm_v0": decide_by_model, "llm": decide_by_model}


def policy(name: str) -> Callable[..., DataFrame]:
    """The policy of that name."""
    found = POLICIES.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown policy: {name}")
    return found

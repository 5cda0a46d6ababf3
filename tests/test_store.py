"""The store: batches, errors, folders, versions, and the log as a stream."""

import pytest
from pyspark.sql import functions as F

from grovekit.operators import policies, report
from grovekit.operators.store import FACTS, OPS, Store, aligned_vectors, changed_texts, delete_vectors, log, state, with_fields

ROOTS = ("attic", "cellar", "inbox")


def op(name, fact_id=None, text=None, path=None, project=None, hard=None, **more):
    return {"op": name, "fact_id": fact_id, "text": text, "path": path, "project": project, "hard": hard, **more}


def facts(store):
    return {r["id"]: r for r in store.facts.collect()}


def dirs(store):
    return {r["path_key"] for r in store.dirs.collect()}


def test_new_notes_get_a_place_and_a_kind(spark):
    s = Store(spark)
    s.apply_ops([op("ADD", "k1", "the kettle is blue"), op("ADD", "k2", "the lamp hums", project="house", kind="idea", t="2024-05-01T00:00:00Z", parent_id="k1", confidence=0.25)])
    f = facts(s)
    assert f["k1"]["path"] == ["global"] and f["k2"]["path"] == ["project", "house"] and f["k1"]["revision"] == 1 and f["k1"]["kind"] == "claim"
    assert (f["k2"]["kind"], f["k2"]["t"], f["k2"]["parent_id"], f["k2"]["confidence"]) == ("idea", "2024-05-01T00:00:00Z", "k1", 0.25)
    assert s.read_by_project(None).count() == 1 and s.read_by_project("house").count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        s.apply_ops([op("ADD", "k1", "the kettle is red")])
    s.apply_ops([op("ADD", None, "a note without a name")])
    assert len([i for i in facts(s) if i.startswith("f_")]) == 1


def test_a_batch_of_all_kinds(spark):
    s = Store(spark)
    done = s.apply_ops([op("ADD", "x", "rain", project="garden"), op("ADD", "y", "sun", project="garden"), op("update", "x", "rain and wind", confidence=0.5), op("NO_OPERATION", "y"), op("DELETE", "y")])
    assert [d["op"] for d in done] == ["ADD", "ADD", "UPDATE", "NOOP", "DELETE"]
    f = facts(s)
    assert f["x"]["text"] == "rain and wind" and f["x"]["revision"] == 2 and f["x"]["confidence"] == 0.5 and not f["y"]["valid"] and f["y"]["revision"] == 1
    assert s.read_all().count() == 1 and s.read_all(False).count() == 2
    with pytest.raises(ValueError, match="deleted"):
        s.apply_ops([op("MOVE", "y", path=["inbox"])])
    s.apply_ops([op("UPDATE", "y", "sun after all")])
    assert facts(s)["y"]["text"] == "sun after all" and not facts(s)["y"]["valid"]


def test_fields_are_set_by_name(spark):
    """Also to nothing; and not on a deleted note, unlike the operation."""
    s = Store(spark, ROOTS)
    s.apply_ops([op("ADD", "x", "rain", ["attic"], project="p", kind="idea"), op("ADD", "y", "sun", ["attic"]), op("DELETE", "y")])
    s.update("x", text="hail", project=None, parent_id="y", t=None)
    x = facts(s)["x"]
    assert (x["text"], x["project"], x["parent_id"], x["kind"], x["revision"], x["path"]) == ("hail", None, "y", "idea", 2, ["attic"])
    s.update("x", path=["cellar", "wine"])
    assert facts(s)["x"]["path"] == ["cellar", "wine"] and {"/cellar", "/cellar/wine"} <= dirs(s)
    for wrong, error in ((lambda: s.update("y", text="z"), ValueError), (lambda: s.update("none", text="z"), KeyError), (lambda: s.update("x", path=["roof"]), ValueError), (lambda: s.update("x", colour="red"), ValueError)):
        with pytest.raises(error):
            wrong()
    assert facts(s)["y"]["text"] == "sun" and facts(s)["x"]["revision"] == 3


def test_nothing_of_a_wrong_batch_stays(spark):
    s = Store(spark)
    s.apply_ops([op("ADD", "x", "rain", project="garden")])
    version = s.version
    with pytest.raises(KeyError):
        s.apply_ops([op("UPDATE", "x", "snow"), op("UPDATE", "nobody", "snow")])
    assert facts(s)["x"]["text"] == "rain" and s.version == version


def test_opened_again(spark, tmp_path):
    """Notes, folders, roots and the greatest depth are those of the store, whatever is asked for."""
    root = str(tmp_path / "store")
    s = Store(spark, ROOTS, max_depth=2, root=root)
    s.apply_ops([op("ADD", "x", "rain", ["attic", "box"])])
    s.set_meta("OWNER", "ann")
    t = Store(spark, max_depth=9, root=root)
    assert facts(t).keys() == {"x"} and t.roots == ROOTS and t.max_depth == 2 and t.get_meta("OWNER") == "ann" and t.conflict_policy() == "append_only"
    with pytest.raises(ValueError, match="path depth"):
        t.apply_ops([op("MKDIR", path=["attic", "b", "c"])])
    t.set_roots(["roof"])
    assert Store(spark, root=root).roots == ("roof",) and "/roof" in dirs(t) and "/attic/box" in dirs(t)
    with pytest.raises(ValueError):
        t.set_roots([])


def test_log_and_snapshots(spark, tmp_path):
    """The log is there after the store is opened again; notes and folders come from a snapshot and the log after it; a batch
    that was not completed does not count."""
    root, times = str(tmp_path / "store"), iter(f"2024-01-01T00:00:{i:02d}Z" for i in range(60))
    open_ = lambda: Store(spark, ROOTS if not (tmp_path / "store").exists() else None, root=root, snapshot_after=3, clock=lambda: next(times))
    s = open_()
    s.apply_ops([op("ADD", "x", "rain", ["attic"]), op("MKDIR", path=["cellar", "wine"]), op("ADD", "y", "sun", ["inbox"], t="early")], manager="m1")
    for i in range(5):
        s = open_()
        s.apply_ops([op("UPDATE", "x", f"rain {i}", reason=f"r{i}", retrieve_ids=["y"])])
    s.update("y", text="moon", kind=None)
    s.apply_ops([op("MOVE", "y", path=["cellar", "wine"]), op("DELETE", "x"), op("NOOP")])
    assert s.snapshot_at > 0 and s.version - s.snapshot_at < 3
    spark.createDataFrame([("zz",)], "fact_id string").write.parquet(f"{root}/log/{s.version + 1}")
    (tmp_path / "store" / "log" / str(s.version + 1) / "_SUCCESS").unlink()
    s = open_()
    f = facts(s)
    assert (f["x"]["text"], f["x"]["revision"], f["x"]["valid"]) == ("rain 4", 6, False) and (f["y"]["text"], f["y"]["kind"], f["y"]["revision"]) == ("moon", None, 3)
    assert f["y"]["t"] == "early" and f["x"]["t"] == f["x"]["created_at"] == "2024-01-01T00:00:00Z" and f["x"]["updated_at"] == "2024-01-01T00:00:07Z" and f["y"]["created_at"] < f["y"]["updated_at"]
    assert {"/attic", "/cellar", "/inbox", "/cellar/wine"} <= dirs(s)
    rows = s.ops_log().collect()
    assert [r["op"] for r in rows] == ["ADD", "MKDIR", "ADD", *["UPDATE"] * 5, "MOVE", "DELETE", "NOOP"] and len({r["op_id"] for r in rows}) == 11
    assert [(r["before_text"], r["after_text"]) for r in rows] == [(None, "rain"), (None, "/cellar/wine"), (None, "sun"), ("rain", "rain 0"), *[(f"rain {i}", f"rain {i + 1}") for i in range(4)], ("moon", "moon"), ("rain 4", None), (None, None)]
    assert rows[0]["manager"] == "m1" and rows[4]["reason"] == "r1" and rows[4]["retrieve_ids"] == ["y"] and rows[4]["target_ids"] == ["x"] and rows[9]["path"] == ["attic"] and rows[8]["project"] is None
    assert s.ops_log(2).count() == 2


def test_a_batch_as_a_table(spark):
    """More notes than are looked up by value; the rows of the log come back as a table."""
    s = Store(spark, ROOTS)
    rows = spark.range(1200).selectExpr("id AS seq", "'ADD' AS op", "concat('n', id) AS fact_id", "concat('text ', id) AS text", "array('attic', concat('b', id % 7)) AS path")
    assert s.apply_ops(rows).count() == 1200 and s.facts.count() == 1200 and len(dirs(s)) == 3 + 7
    up = spark.range(1000).selectExpr("id AS seq", "if(id % 2 = 0, 'UPDATE', 'DELETE') AS op", "concat('n', id) AS fact_id", "if(id % 2 = 0, 'new', null) AS text", "id % 4 = 1 AS hard")
    done = s.apply_ops(up, manager="m")
    assert done.filter("before_text = concat('text ', substring(fact_id, 2))").count() == 1000
    f = facts(s)
    assert len(f) == 1200 - 250 and f["n0"]["text"] == "new" and "n1" not in f and not f["n3"]["valid"] and f["n1100"]["revision"] == 1
    with pytest.raises(KeyError):
        s.apply_ops(spark.range(3).selectExpr("id AS seq", "'DELETE' AS op", "concat('n', id) AS fact_id"))
    assert len(facts(s)) == 950


def test_changed_texts_void_vectors(spark):
    rows = [(0, "ADD", "x", "rain", None, None, None), (1, "ADD", "y", "rain", None, None, None), (2, "UPDATE", "x", "hail", None, None, None), (3, "MOVE", "y", None, ["inbox"], None, None), (4, "ADD", "z", "fog", None, None, None), (5, "UPDATE", "z", "fog", None, None, None), (6, "UPDATE", "y", None, ["inbox"], None, None), (7, "ADD", "w", "ice", None, None, None), (8, "DELETE", "w", None, None, None, True), (9, "UPDATE", "none", "x", None, None, None)]
    df = spark.createDataFrame(rows, "seq long, op string, fact_id string, text string, path array<string>, project string, hard boolean")
    assert sorted(r[0] for r in changed_texts(log(df)).collect()) == ["w", "x"]  # z said the same again
    v = spark.createDataFrame([("x", "m", [1.0]), ("x", "n", [2.0]), ("y", "m", [3.0])], "id string, model string, vector array<double>")
    ids = spark.createDataFrame([("x",)], "id string")
    assert delete_vectors(v, ids).count() == 1 and delete_vectors(v, ids, "m").count() == 2
    got = {r["id"]: r["vector"] for r in aligned_vectors(spark.createDataFrame([("x",), ("y",), ("z",)], "id string"), v, "n").collect()}
    assert got == {"x": [2.0], "y": None, "z": None}


CASES = [
    ("made, put, moved", False, [op("MKDIR", path=["attic", "toys"]), op("ADD", "bear", "t", ["attic", "toys"]), op("MKDIR", path=["cellar", "wine"]), op("MOVE", "bear", path=["cellar", "wine"])], {"bear": ("/cellar/wine", True)}, {"/attic", "/attic/toys", "/cellar", "/cellar/wine", "/inbox"}),
    ("from the inbox", False, [op("ADD", "key", "t", ["inbox"]), op("MOVE", "key", path=["attic", "hooks"])], {"key": ("/attic/hooks", True)}, {"/inbox", "/attic/hooks"}),
    ("one of two is deleted", False, [op("ADD", "hat", "t", ["attic", "a"]), op("ADD", "coat", "t", ["attic", "a"]), op("DELETE", "coat")], {"hat": ("/attic/a", True), "coat": ("/attic/a", False)}, set()),
    ("deleted for good, and new", False, [op("ADD", "cup", "t", ["attic", "x"]), op("DELETE", "cup", hard=True), op("ADD", "cup", "u", ["cellar"])], {"cup": ("/cellar", True)}, {"/attic/x"}),
    ("folders first", True, [op("MKDIR", path=["attic", "z"]), op("NOOP"), op("ADD", "jar", "t", ["attic", "z"])], {"jar": ("/attic/z", True)}, set()),
]


@pytest.mark.parametrize("name,strict,ops,want,folders", CASES, ids=[c[0] for c in CASES])
def test_replayed(spark, name, strict, ops, want, folders):
    s = Store(spark, ROOTS, strict=strict)
    s.apply_ops(ops)
    assert {k: ("/" + "/".join(r["path"]), r["valid"]) for k, r in facts(s).items()} == want
    assert folders <= dirs(s)


WRONG = [(True, [op("MKDIR", path=["attic", *"abcde"])], "path depth"), (True, [op("MKDIR", path=["roof", "x"])], "not in fixed roots"), (True, [op("ADD", "f", "o", ["attic", "nope"])], "does not exist"), (True, [op("ADD", "f", "o", ["attic", "late"]), op("MKDIR", path=["attic", "late"])], "does not exist"), (False, [op("ADD", "f", "")], "text is needed"), (False, [op("HOP", "f")], "unknown op"), (False, [op("MOVE", "f")], "path is needed"), (False, [op("MKDIR", path=["attic", ".."])], "invalid path segment"), (False, [op("DELETE")], "fact_id is needed")]


@pytest.mark.parametrize("strict", [False, True])
def test_errors(spark, strict):
    s = Store(spark, ROOTS, strict=strict)
    for _, ops, error in (w for w in WRONG if w[0] == strict):
        with pytest.raises(ValueError, match=error):
            s.apply_ops(ops)


def test_subtree_and_project_of_moved(spark):
    s = Store(spark, (*ROOTS, "work"))
    s.apply_ops([op("ADD", "a", "t", ["work", "mill", "plans"]), op("ADD", "b", "t", ["work", "mill"]), op("ADD", "c", "t", ["work", "barn"]), op("ADD", "d", "t", ["inbox"]), op("MOVE", "d", path=["work", "yard"])])
    assert {r["id"] for r in s.read_subtree(["work", "mill"]).collect()} == {"a", "b"}
    assert facts(s)["d"]["project"] == "yard"


def test_rule_v0(spark):
    rows = [("The oven is  HOT!", "s", "the oven is hot.", 0.1), ("same", "s", "like", 0.98), ("It no longer rains.", "s", "It rains.", 0.81), ("and a bench", "s", "a table", 0.9), ("far", "s", "off", 0.5), ("first", None, None, None), ("equal!", "s", "EQUAL", 0.2)]
    out = policies.rule_v0(spark.createDataFrame(rows, "text string, best_id string, best_text string, sim double")).collect()
    assert [r["ops"] for r in out] == [["ADD"], ["NOOP"], ["DELETE", "ADD"], ["UPDATE"], ["ADD"], ["ADD"], ["NOOP"]]  # "hot!" and "hot." differ by the point
    assert out[2]["reasons"] == ["sim=0.810_supersede", "sim=0.810_supersede_add"] and all(len(r["ops"]) == len(r["reasons"]) for r in out)


def test_retrieval_of_a_claim(spark):
    """A project's own notes and those of no project; a claim without a project sees the latter alone."""
    bank = spark.createDataFrame([(1, 1, "a", "p", [1.0, 0.0]), (2, 2, "b", None, [1.0, 0.0]), (3, 3, "c", "q", [1.0, 0.0]), (4, 4, "d", None, [0.0, 1.0])], "id long, ord long, text string, project string, vector array<double>")
    claims = spark.createDataFrame([(11, "x", "p", [1.0, 0.1]), (12, "y", None, [1.0, 0.1]), (13, "z", "new", [0.1, 1.0])], "id long, text string, project string, vector array<double>")
    got = {r["id"]: r for r in policies.retrieve(claims, bank, 2).collect()}
    assert got[11]["retrieve_ids"] == ["1", "2"] and got[12]["retrieve_ids"] == ["2", "4"] and got[13]["retrieve_ids"] == ["4", "2"] and got[13]["best_text"] == "d"
    none = policies.rule_v0(policies.retrieve(claims, bank.filter("false")))
    assert all(r["ops"] == ["ADD"] and r["retrieve_ids"] == [] for r in none.collect())


def test_a_model_that_fails(spark):
    """No reply at all: asked again, then added; the figures say so."""
    claims = spark.createDataFrame([(1, "x", None)], "id long, text string, project string").withColumn("related", F.lit(None).cast("array<struct<id:string,text:string,sim:double>>"))

    def broken(prompts):
        raise RuntimeError("no such model")

    out = policies.decide_by_model(claims, broken)
    r = out.first()
    assert r["ops"] == ["ADD"] and r["invalid"] and r["n_asked"] == 2 and r["reasons"] == ["llm_invalid_fallback_add:no_reply"]
    assert policies.model_stats(out).first()["invalid_rate"] == 1.0
    assert policies.policy("Rule_V0") is policies.rule_v0 and policies.policy("append_only") is policies.always_add
    with pytest.raises(ValueError):
        policies.policy("none")


def test_parse_reply(spark):
    rel = F.array(F.struct(F.lit("n7").alias("id"), F.lit("The mill stands still.").alias("text")))
    raws = ['[{"event":"UPDATE","id":"n7","text":"it turns"}]', '```json\n[{"op":"update","old_memory":"the MILL stands still.","new_memory":"y"}]\n```', '[{"event":"NO_OPERATION"}]', "hm", '[{"event":"DELETE","id":"q"}]', '{"ops":[{"operation":"add","memory":"m"}]}', '[{"text":"y"}]', '[{"event":"jump"}]', '[{"event":"ADD"}]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("o", policies.parse_reply(F.col("raw"), rel)).orderBy("i")
    got = [[(x["op"], x["id"], x["error"]) for x in r["o"]] for r in df.collect()]
    assert got == [[("UPDATE", "n7", None)], [("UPDATE", "n7", None)], [("NOOP", None, None)], [], [("DELETE", None, "delete_bad_id")], [("ADD", None, None)], [(None, None, "missing_event")], [("JUMP", None, "bad_event")], [("ADD", None, "add_missing_text")]]


def test_gold_of_tasks(spark):
    t = spark.createDataFrame([(0, "t1", "a", ["attic", "x"], None), (1, "t2", "b", ["cellar"], "own")], "ord long, id string, text string, gold_path array<string>, fact_id string")
    got = {r["id"]: r["path"] for r in state(log(report.place_gold(t), roots=ROOTS)).collect()}
    assert got == {"f_t1": ["attic", "x"], "own": ["cellar"]}


def test_stream_equals_batch(spark, tmp_path):
    """All at once, and in three parts, each taken by a new process on the same folder; nothing new changes nothing."""
    from grovekit.plans.q_store import ops
    from grovekit.streaming.fold import StreamFold

    all_ops = with_fields(ops(spark, "/root/testdata/sf0.001")).select(*OPS.names)
    all_ops = all_ops.withColumns({"kind": F.when(F.col("seq") % 7 == 0, F.lit("idea")), "parent_id": F.when(F.col("seq") % 5 == 0, F.lit("p")), "ts": F.concat(F.lit("t"), F.col("seq")), "project": F.when(F.col("seq") % 3 == 0, F.lit("q"))})
    loose = spark.createDataFrame([(-3, "MKDIR", None, None, ["work", "z"]), (-2, "DELETE", None, None, None), (-1, "ADD", None, "no id", ["inbox"]), (-4, "hop", "1", None, None)], "seq long, op string, fact_id string, text string, path array<string>")
    all_ops = all_ops.unionByName(with_fields(loose, OPS).select(*OPS.names))
    key = lambda df: sorted(map(repr, df.select(*FACTS.names).collect()))
    want = log(all_ops)
    stream = lambda d: spark.readStream.schema(OPS).parquet(str(tmp_path / d))
    all_ops.write.parquet(str(tmp_path / "whole"))
    one = StreamFold(spark, str(tmp_path / "one"))
    assert one.facts().count() == 0
    assert key(one.run(stream("whole"))) == key(state(want))
    log_key = lambda df: sorted(map(repr, df.select("seq", "fact_id", "error").collect()))
    assert log_key(one.done()) == log_key(want)
    for i in range(3):
        all_ops.filter((F.col("seq") >= i * 334) & (F.col("seq") < (i + 1) * 334) | (F.col("seq") < 0) & F.lit(i == 0)).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(1 + (i == 1)):
            StreamFold(spark, str(tmp_path / "parts")).run(stream("in"))
    assert key(StreamFold(spark, str(tmp_path / "parts")).facts()) == key(state(want))
    assert log_key(StreamFold(spark, str(tmp_path / "parts")).done()) == log_key(want)

"""The note store as a fold over an operation log.

Operations come in the order of ``seq``. Whether one may run depends on what came before it for the same note (does it
exist, is it valid) and, where folders must exist, on folders made before it; both are read off with windows over the
log, not by running operations one by one. The state after the log is an aggregation over the operations that ran.

ops columns: seq, op, fact_id, text, path (array), project, hard (boolean) and, where there are such, kind, t, parent_id,
episode_id, confidence and ts (when the operation was made; also the default of a new note's ``t``). facts columns: id, text,
path, project, valid, revision, the five after hard, created_at and updated_at. dirs columns: path_key, path.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import DEFAULT_ROOTS, MAX_DEPTH, normalize_op, normalize_path, path_error, path_key, path_prefixes
from ..sources.folder import Folder
from ..sources.scratch import Scratch

PATH = T.ArrayType(T.StringType())
#: What an operation may say of a note beside its text and place.
MORE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("t", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("episode_id", T.StringType()), T.StructField("confidence", T.DoubleType())])
#: The kind of a note that has none given, and entries of a new store's metadata.
KIND = "claim"
META = {"CONFLICT_POLICY": "append_only", "ARCHITECTURE": "family_A_hard_tree"}
OPS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("fact_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("path", PATH), T.StructField("project", T.StringType()), T.StructField("hard", T.BooleanType()), *MORE.fields, T.StructField("ts", T.StringType())])
FACTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("path", PATH), T.StructField("project", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("revision", T.LongType()), *MORE.fields, T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType())])
#: What a note was before the log at hand: rows with these are notes as they are, not operations.
WAS = T.StructType([T.StructField("before", T.BooleanType()), T.StructField("was_valid", T.BooleanType()), T.StructField("was_revision", T.LongType()), T.StructField("was_created", T.StringType()), T.StructField("was_updated", T.StringType())])
#: What an operation log says beside the operations, for its readers.
SAID = T.StructType([T.StructField("target_ids", PATH), T.StructField("manager", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("retrieve_ids", PATH)])
DIRS = T.StructType([T.StructField("path_key", T.StringType()), T.StructField("path", PATH)])
#: Roots whose second segment names the project of a note moved there.
PROJECT_ROOTS = ("project", "work", "personal", "inbox")


def with_fields(rows: DataFrame, schema: T.StructType = OPS) -> DataFrame:
    """Rows of an older or shorter layout with the columns of ``schema`` that they lack, as null (``revision``: 1)."""
    have = set(rows.columns)
    return rows.withColumns({f.name: F.lit(1 if f.name == "revision" else None).cast(f.dataType) for f in schema.fields if f.name not in have})


def prepare(ops: DataFrame) -> DataFrame:
    """Operations with their names and paths put right, and default paths and ids for notes to add."""
    ops = with_fields(ops)
    made = F.concat(F.lit("f_"), F.substring(F.sha1(F.concat_ws("|", F.col("seq").cast("string"), "text").cast("binary")), 1, 12))
    ops = ops.withColumn("fact_id", F.when((normalize_op(F.col("op")) == "ADD") & F.col("fact_id").isNull(), made).otherwise(F.col("fact_id")))
    path = F.when(F.col("path").isNotNull(), normalize_path(F.col("path")))
    name = normalize_op(F.col("op"))
    default = F.when(F.col("project").isNull(), F.array(F.lit("global"))).otherwise(F.array(F.lit("project"), F.col("project")))
    ops = ops.withColumn("t", F.when(name == "ADD", F.coalesce(F.nullif("t", F.lit("")), "ts")).otherwise(F.col("t")))
    return ops.withColumn("raw_op", F.col("op")).withColumn("op", name).withColumn("path", F.when((name == "ADD") & (path.isNull() | (F.size(path) == 0)), default).otherwise(path)).withColumn("hard", F.coalesce("hard", F.lit(False)))


def _static_error(roots: Sequence[str], max_depth: int):
    """What is wrong with an operation by itself."""
    need_path = F.col("op").isin("ADD", "MKDIR", "MOVE") | ((F.col("op") == "UPDATE") & F.col("path").isNotNull())
    return (
        F.when(F.col("op").isNull(), F.concat(F.lit("unknown op "), F.coalesce("raw_op", F.lit("null"))))
        .when(F.col("op").isin("MKDIR", "MOVE") & (F.coalesce(F.size("path"), F.lit(0)) <= 0), F.lit("path is needed"))
        .when(F.col("op").isin("MOVE", "UPDATE", "DELETE") & F.col("fact_id").isNull(), F.lit("fact_id is needed"))
        .when((F.col("op") == "ADD") & (F.coalesce("text", F.lit("")) == ""), F.lit("text is needed"))
        .when(need_path, path_error(F.col("path"), tuple(roots), max_depth))
    )


def checked_ops(ops: DataFrame, roots: Sequence[str] = DEFAULT_ROOTS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Operations put right, with ``static``: what is wrong with each by itself."""
    return prepare(ops).withColumn("static", _static_error(roots, max_depth))


def made_dirs(ops: DataFrame, strict: bool) -> DataFrame:
    """path_key, path, made: folders that operations make, with the first ``seq``; MKDIR always, others unless strict."""
    any_path = F.col("path").isNotNull() & F.col("op").isin("MKDIR", "ADD", "MOVE", "UPDATE")
    makes = ops.filter(F.col("before") & any_path | (F.col("op") == "MKDIR") if strict else any_path)
    return makes.select("seq", F.explode(path_prefixes(F.col("path"))).alias("path")).groupBy(path_key(F.col("path")).alias("path_key"), "path").agg(F.min("seq").alias("made"))


def log(ops: DataFrame, facts: DataFrame | None = None, dirs: DataFrame | None = None, roots: Sequence[str] = DEFAULT_ROOTS, max_depth: int = MAX_DEPTH, strict: bool = False, checked: bool = False) -> DataFrame:
    """The operations with ``error`` (null if it ran), ``kind_of_error`` (Key, Value), and ``gen``, the life of the note.

    Wrong operations are passed over. The notes of ``facts`` count as added before; a row that is marked ``before`` puts a
    note in its place as it is. ``checked``: the operations have been found right by themselves, under the rules of their time.
    """
    more = [f.name for f in MORE.fields]
    p = with_fields(prepare(ops), WAS).withColumn("before", F.coalesce("before", F.lit(False)))
    p = p.withColumn("static", F.lit(None).cast("string") if checked else F.when(~F.col("before"), _static_error(roots, max_depth)))
    if facts is not None:
        was = {"was_valid": "valid", "was_revision": "revision", "was_created": "created_at", "was_updated": "updated_at"}
        p = p.unionByName(with_fields(facts, FACTS).select(F.lit(-1).cast("long").alias("seq"), F.lit("ADD").alias("op"), F.col("id").alias("fact_id"), "text", "path", "project", F.lit(False).alias("hard"), F.lit("ADD").alias("raw_op"), F.lit(None).cast("string").alias("static"), F.lit(True).alias("before"), *[F.col(v).alias(k) for k, v in was.items()], *more), allowMissingColumns=True)
    if strict:
        known = made_dirs(p.filter("NOT before AND static IS NULL"), True).select("path_key", "made")
        if dirs is not None:
            known = known.unionByName(dirs.select("path_key", F.lit(-1).cast("long").alias("made")))
        known = known.unionByName(ops.sparkSession.createDataFrame([(f"/{r}", -1) for r in roots], "path_key string, made long")).groupBy("path_key").agg(F.min("made").alias("made"))
        p = p.withColumn("_k", path_key(F.col("path"))).join(known.withColumnRenamed("path_key", "_k"), "_k", "left")
        lost = F.col("op").isin("ADD", "MOVE", "UPDATE") & F.col("path").isNotNull() & ~F.col("before") & (F.col("made").isNull() | (F.col("made") > F.col("seq")))
        p = p.withColumn("static", F.coalesce("static", F.when(lost, F.concat(F.col("_k"), F.lit(" does not exist"))))).drop("_k", "made")
    # operations on no note (a third of a log may be such) need no look back, and no task of their own
    loose = p.filter("fact_id IS NULL").withColumns({"exists": F.lit(False), "valid_before": F.lit(False), "gen": F.lit(0).cast("long")})
    p = p.filter("fact_id IS NOT NULL")
    # a note exists if the last ADD or hard DELETE before was an ADD, whether that ran or found the note there already
    w = Window.partitionBy("fact_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("static").isNull()
    toggle = F.when(ok & (F.col("op") == "ADD"), F.lit(True)).when(ok & (F.col("op") == "DELETE") & F.col("hard"), F.lit(False))
    p = p.withColumn("exists", F.coalesce(F.last(toggle, True).over(w), F.lit(False)))
    added = ok & (F.col("op") == "ADD") & (F.col("before") | ~F.col("exists"))
    alive = F.when(added, F.coalesce("was_valid", F.lit(True))).when(ok & (F.col("op") == "DELETE") & F.col("exists"), F.lit(False))
    p = p.withColumn("valid_before", F.coalesce(F.last(alive, True).over(w), F.lit(False)))
    p = p.withColumn("gen", F.sum(added.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.unionByName(loose)
    keyed = F.col("fact_id").isNotNull()
    dynamic = (
        F.when(keyed & (F.col("op") == "ADD") & F.col("exists") & ~F.col("before"), F.lit("duplicate fact id"))
        .when(F.col("op").isin("UPDATE", "MOVE", "DELETE") & ~F.col("exists"), F.lit("fact not found"))
        .when((F.col("op") == "MOVE") & ~F.col("valid_before"), F.lit("cannot move a deleted fact"))
    )
    return p.withColumn("error", F.coalesce("static", dynamic)).withColumn("kind_of_error", F.when(F.col("error").isNotNull(), F.when(F.col("error") == "fact not found", F.lit("Key")).otherwise(F.lit("Value"))))


def _writes() -> tuple[Column, Column, Column, Column]:
    """Whether an operation that ran writes the text, the path, the project of its note; and the project that it writes."""
    is_add, is_up, is_mv = (F.col("op") == x for x in ("ADD", "UPDATE", "MOVE"))
    to_project = is_mv & F.get("path", F.lit(0)).isin(*PROJECT_ROOTS) & (F.size("path") > 1)
    project = is_add | (is_up & (F.col("project").isNotNull() | (F.col("path") == F.array(F.lit("global"))))) | to_project
    return (is_add | is_up) & F.col("text").isNotNull(), (is_add | is_up | is_mv) & F.col("path").isNotNull(), project, F.when(to_project, F.get("path", F.lit(1))).otherwise(F.col("project"))


def state(logged: DataFrame) -> DataFrame:
    """Notes after the log, with the columns of FACTS. Notes deleted for good are not there."""
    ran = logged.filter("error IS NULL AND op <> 'NOOP' AND op <> 'MKDIR'")
    when = lambda c: F.when(c, F.col("seq"))
    is_add, is_up, is_mv = (F.col("op") == x for x in ("ADD", "UPDATE", "MOVE"))
    text, path, project, value = _writes()
    own = [F.max_by(F.coalesce("kind", F.when(F.col("before"), F.lit(None)).otherwise(F.lit(KIND))), when(is_add)).alias("kind"), F.max_by("t", when(is_add)).alias("t")]
    own += [F.max_by(c, when(is_add | is_up & F.col(c).isNotNull())).alias(c) for c in ("parent_id", "episode_id", "confidence")]
    own += [F.max_by(F.when(F.col("before"), F.col("was_created")).otherwise(F.col("ts")), when(is_add)).alias("created_at"), F.max_by(F.when(F.col("before"), F.col("was_updated")).otherwise(F.col("ts")), "seq").alias("updated_at")]
    last = ran.groupBy("fact_id", "gen").agg(
        F.max_by("text", when(text)).alias("text"), F.max_by("path", when(path)).alias("path"), F.max_by(value, when(project)).alias("project"), *own,
        F.max(when((F.col("op") == "DELETE") & F.col("hard"))).alias("gone"), F.max(when(F.col("op") == "DELETE")).alias("deleted"),
        (F.coalesce(F.max("was_revision"), F.lit(1)) + F.count_if(is_up | is_mv)).alias("revision"), F.bool_and(F.coalesce("was_valid", F.lit(True))).alias("was_valid"),
    )
    now = last.groupBy("fact_id").agg(F.max_by(F.struct(*[c for c in last.columns if c != "fact_id"]), "gen").alias("s")).filter("s.gone IS NULL")
    rest = [f"s.{f.name}" for f in FACTS.fields[6:]]
    return now.select(F.col("fact_id").alias("id"), "s.text", "s.path", "s.project", (F.col("s.deleted").isNull() & F.col("s.was_valid")).alias("valid"), F.col("s.revision").cast("long").alias("revision"), *rest)


def with_texts(logged: DataFrame) -> DataFrame:
    """The log with before_text and after_text of the notes (of MKDIR: the folder), and path_after and project_after."""
    w = Window.partitionBy("fact_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    now = w.rowsBetween(Window.unboundedPreceding, 0)
    ran, (text, path, project, value) = F.col("error").isNull(), _writes()
    loose = logged.filter("fact_id IS NULL")  # of no note: no look back
    none = F.lit(None).cast("string")
    loose = loose.withColumns({"before_text": none, "after_text": F.when(ran & (F.col("op") == "MKDIR"), path_key(F.col("path"))), "path_after": F.col("path"), "project_after": F.col("project")})
    keyed = logged.filter("fact_id IS NOT NULL").withColumn("_text", F.last(F.when(ran & text, F.col("text")), True).over(w))
    old = F.when(ran & F.col("op").isin("UPDATE", "MOVE", "DELETE"), F.col("_text"))
    keyed = keyed.withColumns({
        "before_text": old,
        "after_text": F.when(ran, F.when(F.col("op") == "ADD", F.col("text")).when(F.col("op") == "UPDATE", F.coalesce("text", "_text")).when(F.col("op") == "MOVE", F.col("_text")).when(F.col("op") == "MKDIR", path_key(F.col("path")))),
        "path_after": F.coalesce(F.when(F.col("op").isin("NOOP", "MKDIR"), F.col("path")), F.last(F.when(ran & path, F.col("path")), True).over(now)),
        "project_after": F.when(F.col("op").isin("NOOP", "MKDIR"), F.col("project")).otherwise(F.last(F.when(ran & project, F.struct(value.alias("v"))), True).over(now)["v"]),
    })
    return keyed.drop("_text").unionByName(loose)


#: The fields of a note that ``update_fields`` may set.
SETTABLE = ("text", "path", "project", "kind", "t", "parent_id", "episode_id", "confidence")


def update_fields(facts: DataFrame, changes: DataFrame, roots: Sequence[str] = DEFAULT_ROOTS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All notes (with the columns of FACTS), each with ``error`` of its change (null if it was made, or if there is none), and, with their error, the
    changes of notes that are not there.

    changes: id, fields (names of SETTABLE that are given; a field that is given may be null), and those columns. Unlike the
    operation of that name a change is refused where the note is deleted. It counts as one revision.
    """
    facts = with_fields(facts, FACTS)
    given = lambda f: F.array_contains("c.fields", f)
    path = normalize_path(F.col("c.path"))
    error = (
        F.when(F.col("c.id").isNull(), F.lit(None))
        .when(F.col("f.id").isNull(), F.lit("fact not found"))
        .when(~F.col("f.valid"), F.lit("cannot update a deleted fact"))
        .when(given("path"), path_error(path, tuple(roots), max_depth))
    )
    both = facts.alias("f").join(changes.alias("c"), F.col("f.id") == F.col("c.id"), "full_outer").withColumn("error", error)
    made = F.col("c.id").isNotNull() & F.col("error").isNull()
    new = lambda n: F.when(made & given(n), path if n == "path" else F.col(f"c.{n}")).otherwise(F.col(f"f.{n}")).alias(n)
    at = F.when(made, F.col("c.ts")).otherwise(F.col("f.updated_at")) if "ts" in changes.columns else F.col("f.updated_at")
    return both.select(F.coalesce("f.id", "c.id").alias("id"), *[new(n) for n in SETTABLE], "f.valid", (F.col("f.revision") + made.cast("int")).alias("revision"), "f.created_at", at.alias("updated_at"), "error", (made & given("text") & ~F.col("c.text").eqNullSafe(F.col("f.text"))).alias("text_changed"))


def changed_texts(logged: DataFrame) -> DataFrame:
    """Notes whose text an update changed, or that were deleted for good: their vectors are void. An update that says the same
    text again voids nothing."""
    logged = logged if "before_text" in logged.columns else with_texts(logged)
    changed = (F.col("op") == "UPDATE") & F.col("text").isNotNull() & ~F.col("text").eqNullSafe(F.col("before_text"))
    return logged.filter(F.col("error").isNull() & (changed | (F.col("op") == "DELETE") & F.col("hard"))).select(F.col("fact_id").alias("id")).distinct()


def keep_latest(vectors: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the last: an upsert."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return vectors.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def delete_vectors(vectors: DataFrame, ids: DataFrame, model: str | None = None) -> DataFrame:
    """The vectors (id, model, ...) without those of the given ids: of one model, or of all."""
    gone = ids.select("id").distinct()
    if model is not None:
        gone = gone.withColumn("model", F.lit(model))
    return vectors.join(gone, gone.columns, "left_anti")


def aligned_vectors(facts: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """All notes with their vector of a model; null where they have none."""
    return facts.join(vectors.filter(F.col("model") == model).select("id", "vector"), "id", "left")


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Store:
    """Notes and folders as a log of operations, changed by whole batches: all of a batch or nothing.

    A batch is one folder of rows, appended below ``root`` (without one: for the life of the program); it counts from when it
    is complete, with its notes and its folders at once. What the notes are is the last snapshot with the log after it folded
    in; notes that the later log does not name are read from the snapshot as they are. Every ``snapshot_after`` batches a
    snapshot is written, sorted by id, so that a batch on few notes reads few row groups of it. The log stays, as it is the
    record of what was done. Opened again, a store has its last complete batch, its roots and its own greatest depth.

    One writer at a time. ``clock`` gives the times of operations.
    """

    #: Rows of a log: operations, what is said of them, and notes put in place as they are (by ``update``).
    LOGGED = T.StructType([*OPS.fields, *WAS.fields, *SAID.fields, *[T.StructField(c, T.StringType()) for c in ("before_text", "after_text", "project_after")], T.StructField("path_after", PATH), T.StructField("hidden", T.BooleanType())])
    #: Ids of a batch up to which they are looked up by value, so that statistics of the snapshot's files leave most unread.
    BY_VALUE = 500

    def __init__(self, spark: SparkSession, roots: Sequence[str] | None = None, max_depth: int = MAX_DEPTH, strict: bool = False, root: str | None = None, snapshot_after: int = 32, clock: Callable[[], str] = _now):
        self.spark, self.strict, self.snapshot_after, self.clock = spark, strict, snapshot_after, clock
        self.root = (root or Scratch(spark).root).rstrip("/")
        self._files = Folder(spark, self.root)
        done = lambda folder, mark: sorted(int(n) for n in Folder(spark, f"{self.root}/{folder}").names() if n.isdigit() and Folder(spark, f"{self.root}/{folder}/{n}").has(mark))
        self.version, self.snapshot_at = max(done("log", "_SUCCESS"), default=-1), max(done("snapshot", "done"), default=-1)
        self.meta: dict[str, str] = {**META, "MAX_DEPTH": str(max_depth), **json.loads(self._files.read("meta.json") or "{}")}
        self.max_depth = int(self.meta["MAX_DEPTH"])
        if roots is not None or "FIXED_ROOTS" not in self.meta:
            self.set_roots(DEFAULT_ROOTS if roots is None else roots)

    # ---- metadata

    def set_meta(self, key: str, value: str) -> None:
        self.meta[key] = value
        self._files.write("meta.json", json.dumps(self.meta))

    def get_meta(self, key: str) -> str | None:
        return self.meta.get(key)

    def conflict_policy(self) -> str:
        return self.meta["CONFLICT_POLICY"]

    @property
    def roots(self) -> tuple[str, ...]:
        return tuple(json.loads(self.meta["FIXED_ROOTS"]))

    def set_roots(self, roots: Sequence[str]) -> None:
        """The roots from now on; their folders are made, which is no operation of the log's readers."""
        names = [r.strip().strip("/") for r in roots]
        if not names or any(n in ("", ".", "..") for n in names):
            raise ValueError("roots must not be empty")
        rows = self.spark.createDataFrame([(i, "MKDIR", [r], True) for i, r in enumerate(names)], "seq long, op string, path array<string>, hidden boolean")
        self._append(rows)
        self.set_meta("FIXED_ROOTS", json.dumps(names))

    # ---- log and snapshot

    def _append(self, rows: DataFrame) -> DataFrame:
        """The next batch: written as a whole, complete with Spark's mark of success."""
        batch = self.version + 1
        rows = with_fields(rows, self.LOGGED).withColumn("before", F.coalesce("before", F.lit(False))).withColumn("hidden", F.coalesce("hidden", F.lit(False)))
        rows = rows.withColumn("seq", F.col("seq") + F.lit(batch << 32)).select(*[F.col(f.name).cast(f.dataType) for f in self.LOGGED])
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/log/{batch}")
        self.version = batch
        if batch - self.snapshot_at >= self.snapshot_after:
            self.snapshot()
        return self._batches(batch, batch)

    def _batches(self, first: int, last: int) -> DataFrame:
        paths = [f"{self.root}/log/{i}" for i in range(first, last + 1)]
        return self.spark.read.schema(self.LOGGED).parquet(*paths) if paths else self.spark.createDataFrame([], self.LOGGED)

    def _tail(self) -> DataFrame:
        return self._batches(self.snapshot_at + 1, self.version)

    def _held(self, kind: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/snapshot/{self.snapshot_at}/{kind}") if self.snapshot_at >= 0 else self.spark.createDataFrame([], schema)

    def _folded(self, held: DataFrame, tail: DataFrame) -> DataFrame:
        """Notes of a snapshot after a log; those that the log does not name pass without a shuffle of theirs."""
        tail = tail.filter("fact_id IS NOT NULL")
        named = tail.select(F.col("fact_id").alias("id")).distinct()
        after = state(log(tail, held.join(named, "id", "left_semi"), checked=True))
        return held.join(named, "id", "left_anti").unionByName(after)

    def _notes_of(self, ids: DataFrame) -> DataFrame:
        """The notes with these ids (a column id) as they are now."""
        held, tail = self._held("facts", FACTS), self._tail()
        few = [r.id for r in ids.limit(self.BY_VALUE + 1).collect()]
        if len(few) <= self.BY_VALUE:
            held, tail = held.filter(F.col("id").isin(few)), tail.filter(F.col("fact_id").isin(few))
        else:
            held, tail = held.join(ids, "id", "left_semi"), tail.join(ids.withColumnRenamed("id", "fact_id"), "fact_id", "left_semi").select(*self.LOGGED.names)
        return self._folded(held, tail)

    def snapshot(self) -> None:
        """Writes the notes and folders as they are now; the snapshot before the last goes."""
        if self.snapshot_at == self.version:
            return
        at = f"{self.root}/snapshot/{self.version}"
        self.facts.sort("id").write.mode("overwrite").parquet(f"{at}/facts")
        self.dirs.write.mode("overwrite").parquet(f"{at}/dirs")
        Folder(self.spark, at).write("done", "")
        before, self.snapshot_at = self.snapshot_at, self.version
        folder = Folder(self.spark, f"{self.root}/snapshot")
        for n in folder.names():  # a reader may still have the one before open
            if n.isdigit() and int(n) < before:
                folder.delete(n)

    @property
    def facts(self) -> DataFrame:
        return self._folded(self._held("facts", FACTS), self._tail())

    @property
    def dirs(self) -> DataFrame:
        return self._held("dirs", DIRS).unionByName(made_dirs(self._tail(), self.strict).select("path_key", "path")).dropDuplicates(["path_key"])

    # ---- changes

    def apply_ops(self, ops: Sequence[dict] | DataFrame, manager: str | None = None) -> list[dict] | DataFrame:
        """Runs a batch; the first wrong operation raises (KeyError for a missing note, else ValueError) and nothing changes.

        A list comes back as a list of what ran. A DataFrame (columns of OPS, ``seq`` from 0 on in the order to run, and those
        of SAID where there are such) comes back as the batch's rows of ``ops_log``, and does not pass through the driver.
        """
        whole = T.StructType([*OPS.fields, *SAID.fields])
        frame = isinstance(ops, DataFrame)
        rows = with_fields(ops, whole) if frame else self.spark.createDataFrame([tuple({**o, "seq": i}.get(f) for f in whole.names) for i, o in enumerate(ops)], whole)
        now = self.clock()
        rows = rows.withColumn("ts", F.coalesce("ts", F.lit(now))).withColumn("manager", F.coalesce("manager", F.lit(manager).cast("string")))
        batch = prepare(rows).withColumn("op", F.col("raw_op")).drop("raw_op")
        scratch = Scratch(self.spark)
        try:
            if frame:
                batch = scratch.save(batch)
            ids = batch.filter("fact_id IS NOT NULL").select(F.col("fact_id").alias("id")).distinct()
            done = scratch.save(with_texts(log(batch, self._notes_of(ids), self.dirs if self.strict else None, self.roots, self.max_depth, self.strict)).filter("NOT before"))
            bad = done.filter("error IS NOT NULL").orderBy("seq").limit(1).collect()
            if bad:
                raise (KeyError if bad[0]["kind_of_error"] == "Key" else ValueError)(bad[0]["error"])
            targets = F.coalesce("target_ids", F.array().cast(PATH))
            targets = F.when(F.col("fact_id").isNull() | F.col("op").isin("NOOP", "MKDIR") | F.array_contains(targets, F.col("fact_id")), targets).otherwise(F.concat(F.array("fact_id"), targets))
            made = self._append(done.withColumn("target_ids", targets))
        finally:
            scratch.close()
        if frame:
            return self._said(made)
        return [r.asDict() for r in made.orderBy("seq").select((F.col("seq") % (1 << 32)).alias("seq"), "op", "fact_id").collect()]

    def update(self, fact_id: str, **fields) -> None:
        """Sets fields of a note, also to nothing; a note that is not there or deleted is an error."""
        if set(fields) - set(SETTABLE):
            raise ValueError(f"no fields of a note: {sorted(set(fields) - set(SETTABLE))}")
        names = [f.name for f in FACTS if f.name in SETTABLE]
        schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("fields", PATH), *[f for f in FACTS if f.name in SETTABLE], T.StructField("ts", T.StringType())])
        change = self.spark.createDataFrame([(fact_id, list(fields), *[fields.get(n) for n in names], self.clock())], schema)
        scratch = Scratch(self.spark)
        try:
            done = scratch.save(update_fields(self._notes_of(change.select("id")), change, self.roots, self.max_depth))
            bad = done.filter("error IS NOT NULL").limit(1).collect()
            if bad:
                raise (KeyError if bad[0]["error"] == "fact not found" else ValueError)(bad[0]["error"])
            was = {"was_valid": "valid", "was_revision": "revision", "was_created": "created_at", "was_updated": "updated_at"}
            self._append(done.select(F.lit(0).cast("long").alias("seq"), F.lit("ADD").alias("op"), F.col("id").alias("fact_id"), *[n for n in names], F.lit(True).alias("before"), *[F.col(v).alias(k) for k, v in was.items()], F.lit(True).alias("hidden")))
        finally:
            scratch.close()

    # ---- reads

    @staticmethod
    def _said(rows: DataFrame) -> DataFrame:
        number = F.sha1(F.col("seq").cast("string").cast("binary"))
        said = [F.concat(F.lit("op_"), F.substring(number, 1, 16)).alias("op_id"), "ts", "op", "fact_id", F.coalesce("target_ids", F.array().cast(PATH)).alias("target_ids"), "before_text", "after_text"]
        return rows.filter("NOT hidden").select("seq", *said, F.col("project_after").alias("project"), F.col("path_after").alias("path"), "manager", "reason", F.coalesce("retrieve_ids", F.array().cast(PATH)).alias("retrieve_ids"))

    def ops_log(self, limit: int | None = None) -> DataFrame:
        """All operations that ever ran, in order; or the first ``limit`` of them."""
        rows = self._said(self._batches(0, self.version)).orderBy("seq")
        return rows if limit is None else rows.limit(limit)

    def read_all(self, valid_only: bool = True) -> DataFrame:
        return self.facts.filter("valid") if valid_only else self.facts

    def read_subtree(self, active: Sequence[str]) -> DataFrame:
        return self.read_all().filter(F.slice("path", 1, max(1, len(active))) == F.array(*map(F.lit, active))) if active else self.read_all()

    def read_by_project(self, project: str | None) -> DataFrame:
        return self.read_all().filter(F.col("project").eqNullSafe(F.lit(project)))

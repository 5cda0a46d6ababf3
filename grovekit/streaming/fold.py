"""The operation log as a stream: each note is state under its key, kept up to date as operations arrive.

``transformWithState`` keeps a value for each note in a RocksDB store; a micro-batch reads and writes the notes that it names,
and what goes to the checkpoint is the log of these changes. The notes are read from the checkpoint with Spark's reader of
state; what became of each operation goes to a table beside it. Both go on from the last complete batch after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import DEFAULT_ROOTS, MAX_DEPTH
from ..operators.store import FACTS, KIND, PROJECT_ROOTS, checked_ops
from ..sources.folder import Folder

#: What the session is set to while a stream starts: state on disk, and changes alone to the checkpoint.
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DONE = "seq long, op string, fact_id string, error string"
_FIELDS = FACTS.names


def run_one(note: dict | None, o: Row) -> tuple[dict | None, str | None]:
    """A note (None: there is none) after one operation on it, and what was wrong with that."""
    if o.static is not None:
        return note, o.static
    if o.op in ("NOOP", "MKDIR"):
        return note, None
    if o.op == "ADD":
        if note:
            return note, "duplicate fact id"
        new = {f: getattr(o, f, None) for f in _FIELDS}
        return new | {"id": o.fact_id, "kind": o.kind if o.kind is not None else KIND, "valid": True, "revision": 1, "created_at": o.ts, "updated_at": o.ts}, None
    if not note:
        return None, "fact not found"
    if o.op == "DELETE":
        return (None if o.hard else note | {"valid": False, "updated_at": o.ts}), None
    if o.op == "MOVE" and not note["valid"]:
        return note, "cannot move a deleted fact"
    new = note | {"revision": note["revision"] + 1, "updated_at": o.ts}
    if o.path is not None:
        new["path"] = list(o.path)
    if o.op == "MOVE":
        if o.path[0] in PROJECT_ROOTS and len(o.path) > 1:
            new["project"] = o.path[1]
        return new, None
    if o.project is not None or o.path == ["global"]:
        new["project"] = o.project
    for f in ("text", "parent_id", "episode_id", "confidence"):
        if getattr(o, f) is not None:
            new[f] = getattr(o, f)
    return new, None


class NoteFold(StatefulProcessor):
    """The operations of one note, in the order of ``seq`` within a batch. A batch is as large as the stream's source lets it
    be (``maxFilesPerTrigger`` and the like), which bounds what one note can have in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.note = handle.getValueState("note", FACTS)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        held = self.note.get() if self.note.exists() else None
        before = note = dict(zip(_FIELDS, held)) if held is not None else None
        for o in sorted(rows, key=lambda o: o.seq):
            note, error = run_one(note, o)
            yield Row(seq=o.seq, op=o.op, fact_id=o.fact_id, error=error)
        if note is None and before is not None:
            self.note.clear()
        elif note is not before:
            self.note.update(tuple(note[f] for f in _FIELDS))

    def close(self) -> None:
        pass


class StreamFold:
    """Folds a stream of operations (columns as in ``operators.store``) into notes, kept under ``root``.

    Operations of one note come in the order of batches, and within a batch of ``seq``. Folders are not checked: whether one
    exists is no state of a note. The number of tasks that hold the notes is that of the shuffle partitions at the first start.
    """

    def __init__(self, spark: SparkSession, root: str, roots: Sequence[str] = DEFAULT_ROOTS, max_depth: int = MAX_DEPTH):
        self.spark, self.root, self.roots, self.max_depth = spark, root.rstrip("/"), roots, max_depth

    def facts(self) -> DataFrame:
        """The notes after the last complete batch."""
        if not Folder(self.spark, f"{self.root}/checkpoint/commits").names():
            return self.spark.createDataFrame([], FACTS)
        return self.spark.read.format("statestore").option("stateVarName", "note").load(f"{self.root}/checkpoint").select("value.*")

    def done(self) -> DataFrame:
        """What became of each operation."""
        return self.spark.read.schema(DONE).parquet(f"{self.root}/done")

    def run(self, stream: DataFrame) -> DataFrame:
        """Takes all that the stream has now, and returns the notes."""
        ops = checked_ops(stream, self.roots, self.max_depth)
        # operations on no note leave no state; they are dealt over many keys
        keyed = ops.withColumn("key", F.coalesce(F.concat(F.lit("f"), "fact_id"), F.concat(F.lit("n"), (F.col("seq") % 1024).cast("string"))))
        folded = keyed.groupBy("key").transformWithState(NoteFold(), DONE, "append", "none")
        old = {k: self.spark.conf.get(k, None) for k in _CONF}
        try:
            for k, v in _CONF.items():
                self.spark.conf.set(k, v)
            q = folded.writeStream.format("parquet").option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start(f"{self.root}/done")
            q.awaitTermination()
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.facts()

"""A store of vectors by text that keeps what it has embedded.

Vectors are appended in versions, each written as a whole. A text is found by a hash, which joins, and told apart by the
text itself; of several vectors of one text the one of the latest version counts. Texts that are not there are embedded once
each, also where several lookups run at a time: whoever embeds holds a lock file, and looks again once it has it.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import unit
from .folder import Folder
from .scratch import Scratch

ENTRIES = T.StructType([T.StructField("hash", T.LongType()), T.StructField("text", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("version", T.LongType())])


_HELD: dict[str, threading.Lock] = {}


class VectorStore:
    """Vectors below ``root``. ``embed`` maps a list of texts to their vectors, on executors; without one a text that is missing
    is an error. A lock that is older than ``stale`` seconds was left by a program that died, and is taken away."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64, stale: float = 3600.0):
        self.spark, self.root, self.embed, self.batch, self.stale = spark, root.rstrip("/"), embed, batch, stale
        self.folder, self.lock = Folder(spark, f"{self.root}/v"), Folder(spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if n.isdigit() and self.folder.has(f"{n}/_SUCCESS"))

    def entries(self) -> DataFrame:
        """All vectors of all versions."""
        paths = [f"{self.root}/v/{n}" for n in self.versions()]
        return self.spark.read.schema(ENTRIES).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRIES)

    @contextmanager
    def _alone(self) -> Iterator[None]:
        with _HELD.setdefault(self.root, threading.Lock()):  # within a program: a local file system does not make files atomically
            while not self.lock.claim("lock"):
                if self.lock.age("lock") > self.stale:
                    self.lock.delete("lock")
                time.sleep(0.2)
            try:
                yield
            finally:
                self.lock.delete("lock")

    def _append(self, rows: DataFrame) -> int:
        version = max(self.versions(), default=-1) + 1
        rows = rows.filter("text IS NOT NULL").select(F.xxhash64("text").alias("hash"), "text", F.col("vector").cast("array<double>").alias("vector"), F.lit(version).cast("long").alias("version"))
        rows.write.mode("overwrite").parquet(f"{self.root}/v/{version}")
        return version

    def put(self, rows: DataFrame) -> int:
        """Sets the vectors of texts (text, vector), each text once; the number of the version."""
        with self._alone():
            return self._append(rows)

    def _found(self, asked: DataFrame) -> DataFrame:
        """Of the texts asked for (hash, text) those that are there, with their vector."""
        return self.entries().join(asked, ["hash", "text"], "left_semi").groupBy("hash", "text").agg(F.max_by("vector", "version").alias("vector"))

    def lookup(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The rows with the unit vector of their text (null for null); what was missing is in the store from then on."""
        scratch = Scratch(self.spark)
        asked = scratch.save(df.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).distinct())
        missing = lambda: asked.join(self.entries(), ["hash", "text"], "left_anti").select("text")
        if missing().limit(1).count():
            if self.embed is None:
                raise KeyError(f"{missing().count()} texts have no vector")
            embed, size = self.embed, self.batch

            def run(frames):
                for f in frames:
                    for a in range(0, len(f), size):
                        part = f.iloc[a : a + size]
                        yield part.assign(vector=embed(part["text"].tolist()))

            with self._alone():
                left = scratch.save(missing())  # another lookup may have been here meanwhile
                if left.limit(1).count():
                    self._append(left.mapInPandas(run, "text string, vector array<double>"))
        found = self._found(asked).select(F.col("hash").alias("_h"), F.col("text").alias("_t"), unit(F.col("vector"), 0.0, 1e-9).alias("vector"))
        return df.join(found, (F.xxhash64(text) == F.col("_h")) & (F.col(text) == F.col("_t")), "left").drop("_h", "_t")

"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset a temporary one is made, on a local master
only: on a cluster each machine would write to a disk of its own. A written table cuts the lineage, so a lost executor
costs the tasks that it ran, not the whole history.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="grovekit-")
    return _LOCAL["dir"]


class Scratch:
    """Tables under one folder of their own, which goes with ``close``, or when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, 0
        self.root = f"{shared_folder(spark)}/grovekit-{uuid.uuid4().hex}"
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm = spark.sparkContext._jvm
        _OPEN.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """The table, written and read again."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self._conf).delete(p, True)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        self._delete(df._scratch_path)

    def close(self) -> None:
        """Deletes all tables."""
        if self in _OPEN:
            _OPEN.remove(self)
        self._delete(self.root)


@contextmanager
def released() -> Iterator[None]:
    """Deletes at its end what was saved inside: for steps whose result has been written elsewhere by then."""
    first = len(_OPEN)
    try:
        yield
    finally:
        for s in _OPEN[first:][::-1]:
            s.close()


def _at_exit() -> None:
    for s in list(_OPEN):
        try:
            s.close()
        except Exception:  # the engine may have gone before
            shutil.rmtree(s.root, ignore_errors=True)
    for path in _LOCAL.values():
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_at_exit)

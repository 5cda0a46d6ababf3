"""Small files in a folder of whatever file system Spark writes to."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        p = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        size = self._fs.getFileStatus(p).getLen()
        stream = self._fs.open(p)
        try:
            return bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none of it."""
        self._fs.mkdirs(self._path(self.root))
        part, whole = self._path(f"{self.root}/.{name}.part"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(whole):
            self._fs.delete(whole, False)
        self._fs.rename(part, whole)

    def claim(self, name: str) -> bool:
        """Makes an empty file, if there is none of that name; whether it did."""
        self._fs.mkdirs(self._path(self.root))
        try:
            return self._fs.createNewFile(self._path(f"{self.root}/{name}"))
        except Py4JJavaError as e:  # another one was quicker
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def age(self, name: str) -> float:
        """Seconds since a file was written; 0 if there is none."""
        p = self._path(f"{self.root}/{name}")
        return time.time() - self._fs.getFileStatus(p).getModificationTime() / 1000 if self._fs.exists(p) else 0.0

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

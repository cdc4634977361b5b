"""Small files through Hadoop's file systems, so that a store may lie wherever Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError

from palimpsest.sources.errors import IoError


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._new, self.root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, root.rstrip("/")  # sought once: each name in it is a call
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._new(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one. Of several writers one wins."""
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise IoError(str(e.java_exception)) from e
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        return True

    def create_whole(self, name: str, text: str) -> bool:
        """Like :meth:`create`, but the file is seen whole or not at all.

        It is written under a hidden name, which Spark's sources pass over and
        which a single writer can create, and renamed. Hidden files that a crash
        left are removed by :meth:`sweep`.
        """
        folder, base = name.rsplit("/", 1)
        claim = f"{folder}/.{base}.claim"
        if self.exists(name) or not self.create(claim, text):
            return False
        done = False
        try:
            if self.exists(name):  # another one was done between the two questions
                return False
            done = self._fs.rename(self._path(claim), self._path(name))
            if not done:
                raise IoError(f"can't rename to {name}")
        finally:
            if not done:
                self.delete(claim)
        return True

    def sweep(self, folder: str) -> None:
        """Remove hidden files; only for the owner of the folder."""
        for n in self.names(folder):
            if n.startswith("."):
                self.delete(f"{folder}/{n}")

    def replace(self, name: str, text: str) -> None:
        """Write beside, then rename over."""
        self.delete(name + ".new")
        self.create(name + ".new", text)
        self.delete(name + ".old")
        if self.exists(name):
            self._fs.rename(self._path(name), self._path(name + ".old"))
        if not self._fs.rename(self._path(name + ".new"), self._path(name)):
            raise IoError(f"can't rename {name}")

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

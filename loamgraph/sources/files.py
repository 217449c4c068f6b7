"""Small files of any file system that the session knows (local, HDFS, object stores), through Hadoop's client."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


class Files:
    """Names, sizes, renames and texts below a path."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names inside a folder, sorted; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(path)) if not (n := s.getPath().getName()).startswith((".", "_")))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def size(self, path: str) -> int:
        return int(self._fs.getContentSummary(self._path(path)).getLength())

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str):
        return self._fs.create(self._path(path), True)


@contextmanager
def written(spark: SparkSession, path: str):
    """A function that appends text to a file, which appears under its name when the block ends well."""
    fs = Files(spark, path)
    stream = fs.create(f"{path}.tmp")
    try:
        yield lambda text: stream.write(bytearray(text.encode("utf-8")))
    except BaseException:
        stream.close()
        fs.delete(f"{path}.tmp")
        raise
    stream.close()
    fs.delete(path)
    fs.rename(f"{path}.tmp", path)

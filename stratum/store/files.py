"""Small files of a store, through Hadoop's file systems, so that a root may be anywhere Spark can read and write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def size(self, folder: str) -> int:
        """Bytes of the files in a folder."""
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return (self._jvm.System.currentTimeMillis() - self._fs.getFileStatus(self._path(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file whole: it appears under its name by a rename, or not at all."""
        folder, _, last = name.rpartition("/")
        self._fs.mkdirs(self._path(folder))
        part = f"{folder}/.{last}.part" if folder else f".{last}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not self._fs.rename(self._path(part), self._path(name)):
            self._fs.delete(self._path(part), False)
            raise FileExistsError(self.full(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

"""Small files (logs, manifests) on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import Conflict, NotFound


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def size(self, folder: str = "") -> int:
        return self.fs.getContentSummary(self._path(folder)).getLength()

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise NotFound(f"{self.root}/{name}")
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file whole: it appears under its name by one rename, which fails if the name is taken."""
        draft = self._path(f"{name}.{self.jvm.java.util.UUID.randomUUID()}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(draft, self._path(name)):
            self.fs.delete(draft, False)
            raise Conflict(f"{self.root}/{name} was written by another session")

    def replace(self, name: str, content: bytes) -> None:
        """Put other bytes in a file's place: they are written aside first."""
        draft = self._path(f"_{name.rpartition('/')[2]}.{self.jvm.java.util.UUID.randomUUID()}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(content))
        out.close()
        self.fs.delete(self._path(name), False)
        self.fs.rename(draft, self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

"""Small files in whatever store Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by Spark's file systems; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """What stands in a folder; nothing where there is none."""
        if not self.exists(name):
            return []
        return sorted(entry.getPath().getName() for entry in self._fs.listStatus(self._at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """A whole file at once, by renaming; False if it is there already and may not be replaced."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._at(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace:
            self._fs.delete(self._at(name), False)
        elif self.exists(name):
            self._fs.delete(self._at(draft), False)
            return False
        done = self._fs.rename(self._at(draft), self._at(name))
        if not done:
            self._fs.delete(self._at(draft), False)
        return done

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

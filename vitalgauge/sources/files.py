"""The few file operations of the driver, through Spark's own file systems (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """File system of one path, as Spark's settings give it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._fs.makeQualified(self._hadoop.Path(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names inside a folder, sorted; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(entry.getPath().getName() for entry in self._fs.listStatus(self._path(path)))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def publish_text(self, path: str, scratch: str, text: str) -> bool:
        """Write under a scratch name, then rename: the file appears whole or not at all. False if it exists already."""
        stream = self._fs.create(self._path(scratch), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        target = self._path(path)
        self._fs.mkdirs(target.getParent())
        context = self._hadoop.FileContext.getFileContext(target.toUri(), self._conf)
        rename = getattr(self._hadoop, "Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(self._path(scratch), target, options)
            return True
        except Exception as error:  # noqa: BLE001 - py4j wraps every Java exception
            if "FileAlreadyExists" not in str(error):
                raise
            self.delete(scratch)
            return False

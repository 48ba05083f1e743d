"""File operations of the log, over Hadoop's file systems, so that a store may lie wherever Spark can read."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Files:
    """Reads, atomic creation and listing below one folder. On a local file system put-if-absent is a hard link, which fails
    if the name is taken; elsewhere it is a create without overwrite, which HDFS and object stores with conditional
    writes make atomic."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._missing = "java.io.FileNotFoundException"
        root_path = self._path(root)
        self.fs = root_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = str(self.fs.makeQualified(root_path).toString()).rstrip("/")
        self.local = urlparse(self.root).path if self.root.startswith("file:") else None

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _local(self, name: str) -> str | None:
        return None if self.local is None else os.path.join(self.local, name) if name else self.local

    def exists(self, name: str) -> bool:
        return os.path.exists(p) if (p := self._local(name)) else self.fs.exists(self._path(self.at(name)))

    def size(self, name: str) -> int:
        return os.path.getsize(p) if (p := self._local(name)) else int(self.fs.getFileStatus(self._path(self.at(name))).getLen())

    def read(self, name: str) -> bytes:
        if p := self._local(name):
            with open(p, "rb") as f:
                return f.read()
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def put_if_absent(self, name: str, data: bytes, sync: bool = True) -> bool:
        """Creates the file with all its bytes; False if it exists."""
        if p := self._local(name):
            os.makedirs(os.path.dirname(p), exist_ok=True)
            temporary = f"{p}.{uuid.uuid4().hex}.tmp"
            try:
                with open(temporary, "wb") as f:
                    f.write(data)
                    if sync:
                        f.flush()
                        os.fsync(f.fileno())
                os.link(temporary, p)
                return True
            except FileExistsError:
                return False
            finally:
                if os.path.exists(temporary):
                    os.unlink(temporary)
        path = self._path(self.at(name))
        if self.fs.exists(path):
            return False
        try:
            stream = self.fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(data))
        if sync and hasattr(stream, "hsync"):
            stream.hsync()
        stream.close()
        return True

    def force(self, name: str) -> None:
        """Forces a file that was created without it to disk; nothing where the file system has no such call, or the file is gone."""
        if (p := self._local(name)) and os.path.exists(p):
            with open(p, "rb") as f:
                os.fsync(f.fileno())

    def replace(self, name: str, data: bytes) -> None:
        """Writes the file, over an older one if need be; readers see the old or the new bytes."""
        self.delete(name)
        self.put_if_absent(name, data)

    def list(self, name: str = "") -> list[str]:
        """Names of the files directly in a folder; none if it does not exist."""
        if p := self._local(name):
            return sorted(x for x in os.listdir(p) if os.path.isfile(os.path.join(p, x)) and not x.endswith(".tmp")) if os.path.isdir(p) else []
        path = self._path(self.at(name))
        return sorted(str(s.getPath().getName()) for s in self.fs.listStatus(path) if s.isFile()) if self.fs.exists(path) else []

    def tree(self, name: str) -> dict[str, tuple[int, float]]:
        """Size and time of change (in seconds) of all Parquet files below a folder, by their names from the root."""
        out = {}
        if p := self._local(name):
            for folder, _, names in os.walk(p):
                for x in names:
                    if x.endswith(".parquet"):
                        found = os.stat(os.path.join(folder, x))
                        out[os.path.relpath(os.path.join(folder, x), self.local)] = (found.st_size, found.st_mtime)
            return out
        path = self._path(self.at(name))
        if self.fs.exists(path):
            it = self.fs.listFiles(path, True)
            while it.hasNext():
                status = it.next()
                full = str(status.getPath().toString())
                if full.endswith(".parquet"):
                    out[f"{name}/" + full.rsplit(f"/{name}/", 1)[1]] = (int(status.getLen()), int(status.getModificationTime()) / 1000)
        return out

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)

    def mkdirs(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(self.at(name)))

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self._path(self.at(source)), self._path(self.at(target))):
            raise OSError(f"cannot rename {source} to {target}")

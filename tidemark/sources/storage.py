"""Small files on any Hadoop file system, from the driver."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

from tidemark.errors import NotFoundError, StorageError


#: Schemes of local disks, of file systems whose rename fails at a taken name, and the key that asks S3A for a conditional put.
LOCAL = (None, "file")
EXCLUSIVE_RENAME = ("hdfs", "webhdfs", "swebhdfs", "ofs")
CONDITIONAL_PUT = "fs.option.create.conditional.overwrite"


def _sync(path: str) -> None:
    """Makes a local file or folder durable."""
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def url(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.url(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def files(self, name: str = "") -> list[tuple[str, int]]:
        """(name, bytes) of the plain files in a folder."""
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(name)) if s.isFile()) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getLen()

    def modified(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getModificationTime()

    def read(self, name: str) -> bytes:
        if not self.exists(name):
            raise NotFoundError(name)
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Creates a file that isn't there yet, whole or not at all; False if another writer was first.

        On a local disk a finished temporary file is synced and linked to the name,
        on file systems whose rename fails at a taken name it is renamed. Elsewhere,
        as on object stores, the file is put on the condition that there is none; a
        store that can't put so refuses. A crash leaves no more than a temporary file.
        """
        if self._scheme() not in (*LOCAL, *EXCLUSIVE_RENAME):
            return self._put_if_absent(name, data)
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(temp, data)
        try:
            if self._scheme() in LOCAL:
                local = [self._local(n) for n in (temp, name)]
                _sync(local[0])
                try:
                    os.link(*local)
                except FileExistsError:
                    return False
                _sync(os.path.dirname(local[1]))
                return True
            return not self.exists(name) and self._fs.rename(self._path(temp), self._path(name))
        finally:
            self.delete(temp)

    def _scheme(self) -> str | None:
        """The scheme of the file system that the folder really stands on."""
        return self._fs.resolvePath(self._path("")).toUri().getScheme() if self.exists() else self._path("").toUri().getScheme()

    def _local(self, name: str) -> str:
        return self._fs.resolvePath(self._path("")).toUri().getPath().rstrip("/") + "/" + name

    def _put_if_absent(self, name: str, data: bytes) -> bool:
        builder = self._fs.createFile(self._path(name)).overwrite(False)
        if self._scheme() == "s3a":
            builder = builder.must(CONDITIONAL_PUT, True)
        try:
            stream = builder.build()
            try:
                stream.write(bytearray(data))
            finally:
                stream.close()
        except Exception as e:
            if self.exists(name):
                return False
            raise StorageError(name, f"can't be created exclusively: {str(e).splitlines()[0]}") from e
        return True

    def append(self, name: str, data: bytes, sync: bool = False) -> bool:
        """Adds to a file on a local disk; False elsewhere, where files can't grow."""
        if self._scheme() not in LOCAL:
            return False
        with open(self._local(name), "ab") as f:
            f.write(data)
            f.flush()
            if sync:
                os.fsync(f.fileno())
        return True

    def write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise StorageError(old, f"can't become {new}")


#: Names of the files of an embedded store's folder: pattern and kind (fixed formats).
FILE_NAMES = (
    (r"CURRENT", "current"),
    (r"LOCK", "lock"),
    (r"LOG(\.old)?", "info-log"),
    (r"MANIFEST-([0-9]+)", "manifest"),
    (r"([0-9]+)\.log", "log"),
    (r"([0-9]+)\.(ldb|sst)", "table"),
    (r"([0-9]+)\.dbtmp", "temp"),
)


def parse_file_name(name: str) -> tuple[str, int] | None:
    """(kind, number) of a file of an embedded store, None for others."""
    for pattern, kind in FILE_NAMES:
        m = re.fullmatch(pattern, name)
        if m:
            digits = next((g for g in m.groups() if g and g.isdigit()), "0")
            return (kind, int(digits)) if int(digits) < 1 << 64 else None
    return None

"""Small files in any storage that Spark reaches, by Hadoop's file systems."""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..errors import Conflict


def plain(uri: str) -> str:
    """The path of a file without scheme and host."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", uri)


def plain_from_scan(uri: str) -> str:
    """The same of what a scan says of its file, which is encoded as a URI."""
    return unquote(plain(uri))


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        path = self.path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def path(self, p: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def mkdirs(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def names(self, p: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        if not self.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p)))

    def modified(self, p: str) -> int:
        """Milliseconds, by the storage's own clock."""
        return self.fs.getFileStatus(self.path(p)).getModificationTime()

    def data_below(self, p: str) -> list[str]:
        """Data files in a folder and the folders in it."""
        out = []
        for s in self.fs.listStatus(self.path(p)) if self.exists(p) else []:
            name = s.getPath().getName()
            if s.isDirectory():
                out += self.data_below(f"{p}/{name}")
            elif name.startswith("part-"):
                out.append(f"{p}/{name}")
        return sorted(out)

    def size(self, p: str) -> int:
        return self.fs.getFileStatus(self.path(p)).getLen()

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> None:
        """Publish a file whole, or raise Conflict if there is one of that name."""
        if self.exists(p):
            raise Conflict(f"{p} is there already")
        folder, _, name = p.rpartition("/")
        draft = f"{folder}/.{name}-{self.jvm.java.util.UUID.randomUUID().toString()}"
        out = self.fs.create(self.path(draft), False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(p).toUri(), self.conf)
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(draft), self.path(p), options)
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if self.exists(p):
                raise Conflict(f"{p} is there already") from e
            raise

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

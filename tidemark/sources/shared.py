"""The folder that driver and executors share, and files of any file system that Spark reaches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local folder stands in, but only if driver and executors are one
    process: on a cluster each would see a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Files:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}"))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under a temporary name first, then renamed over."""
        jvm, temp = self.spark._jvm, self.path(f"{self.root}/.{name.replace('/', '_')}.{uuid.uuid4().hex}")
        stream = self.fs.create(temp)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.root).toUri() if "://" in self.root else jvm.java.net.URI.create("file:///"), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temp, self.path(f"{self.root}/{name}"), options)

    def parts(self, folder: str) -> list[str]:
        return sorted(f"{folder}/{s.getPath().getName()}" for s in self.fs.listStatus(self.path(f"{self.root}/{folder}")) if s.getPath().getName().startswith("part-"))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def all(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        it, out = self.fs.listFiles(self.path(f"{self.root}/{folder}"), True), []
        base = self.fs.makeQualified(self.path(self.root)).toString()
        while it.hasNext():
            out.append(it.next().getPath().toString().removeprefix(base).lstrip("/"))
        return out

    def copy(self, name: str, to: Files) -> None:
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(f"{self.root}/{name}"), to.fs, self.path(f"{to.root}/{name}"), False, self.spark._jsc.hadoopConfiguration())

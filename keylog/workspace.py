"""Paths: the folder that driver and executors share, tables written there, and small file operations on any Hadoop file system."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset on one machine (tests) a folder is made and set; on a cluster that is an error,
    since executors would not see a folder of the driver.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keylog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/keylog/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What reads it twice reads the same rows in the same partitions, and a lost executor costs only its own running tasks.
    """
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few operations the store needs; local paths by ``os``, others by Hadoop."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        parsed = urlparse(root)
        self.local = parsed.scheme in ("", "file")
        self.root = parsed.path if self.local else root
        self.spark = spark

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        if self.local:
            return sorted(os.listdir(folder)) if os.path.isdir(folder) else []
        p, fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, folder: str) -> None:
        if self.local:
            os.makedirs(folder, exist_ok=True)
        else:
            p, fs = self._fs(folder)
            fs.mkdirs(p)

    def read(self, path: str) -> bytes:
        if self.local:
            with open(path, "rb") as f:
                return f.read()
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Write a new file whole or not at all; False if there is one already."""
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        if self.local:
            with open(temp, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temp, path)  # fails if the name is taken
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
        p, fs = self._fs(temp)
        out = fs.create(p, False)
        out.write(bytearray(data))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(p, jvm.org.apache.hadoop.fs.Path(path), options)  # without OVERWRITE: fails if the name is taken
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(p, False)
            return False

    def remove(self, path: str) -> None:
        if self.local:
            import shutil

            shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.exists(path) and os.unlink(path)
        else:
            p, fs = self._fs(path)
            fs.delete(p, True)

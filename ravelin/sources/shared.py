"""Tables in the folder that the driver and all executors share, which cut the lineage of what is read more than once."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a temporary folder takes its place on one machine; on a cluster
    that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='ravelin-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` gave."""
    for table in tables:
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that Spark hands to a Python function at once, and the setting for it.
BATCH_BYTES, BATCH_LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session come in ``BATCH_BYTES`` at most (and one row), unless it has a limit of its own. Without one a batch
    is 10000 rows, however long: with more rows in a task, its Python function holds more of them at once."""
    if not spark.sparkContext.getConf().contains(BATCH_LIMIT):
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


class Files:
    """Small files under one root of any Hadoop file system, by relative names."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.hadoop, self.conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = lambda name: self.hadoop.Path(f"{self.root}/{name}" if name else self.root)
        self.fs = self.path("").getFileSystem(self.conf)
        self.none = spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)) if not s.getPath().getName().startswith("."))

    def get(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A file that appears whole, for the first of several writers only; False for the others. The text is written beside and then
        renamed without leave to overwrite, which a distributed file system does as one step; a local one links instead."""
        beside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/")
        out = self.fs.create(self.path(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda x: unquote(urlparse(self.path(x).toString()).path)
                os.link(local(beside), local(name))
            else:
                self.hadoop.FileContext.getFileContext(self.path(beside).toUri(), self.conf).rename(self.path(beside), self.path(name), self.none)
            return True
        except Exception:
            if self.fs.exists(self.path(name)):
                return False
            raise
        finally:
            self.fs.delete(self.path(beside), False)

    def age(self, name: str) -> float:
        """Seconds since it was changed."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

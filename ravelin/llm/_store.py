"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import small_batches


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a temporary folder takes its place on one machine; on a
    cluster that is an error, since executors would write where nobody else reads."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='ravelin-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call.

    A written table cuts the lineage: what an executor lost is read again, not computed again. ``drop`` removes tables
    that neither a later step nor the result reads."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sample_rows(rows: DataFrame, n: int) -> DataFrame:
    """About n rows (at most some more by chance) of those with the column r, a 64-bit hash: those whose hash is below a
    share that follows from the number of rows. No task hands on more than its part, unlike a sort with a limit."""
    total = rows.count()
    if total <= n:
        return rows
    scale = 1 << 40
    return rows.filter(F.pmod("r", F.lit(scale)) < F.lit(int(scale * min(1.0, 1.05 * n / total))))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: dict[int, int], *, id_col: str, text_col: str, label_col: str, max_chars: int | None = None) -> DataFrame:
    """A bounded sample of labelled rows (text, y, r): of each label up to so many rows, in order of a hash r of the id, and with
    ``max_chars`` as many as have an equal part of these characters together. Hashes and lengths are joined and come to the
    driver; the texts of the rows chosen by them are then found by a broadcast of their hashes, never shuffled."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(*most)).dropDuplicates(["k"])
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    name = F.xxhash64(F.col(id_col), F.col(text_col))
    sizes = rows.select(F.col(id_col).alias("k"), F.xxhash64(F.col(id_col)).alias("r"), name.alias("h"), F.length(text_col).alias("n")).join(known, "k")
    chosen = []
    for y, limit in most.items():
        sized = sample_rows(sizes.filter(F.col("y") == y), limit).select("r", "h", "n").distinct().toPandas().sort_values(["r", "h"])[:limit]
        total = 0
        for r, h, n in sized.itertuples(index=False):
            if max_chars is None or total + n <= max_chars // len(most):
                total += n
                chosen.append((int(h), int(r), y))
    wanted = docs.sparkSession.createDataFrame(chosen, "h long, r long, y int")
    return rows.select(name.alias("h"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "h").select("text", "y", "r", "h")

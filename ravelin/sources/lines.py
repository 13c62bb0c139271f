"""Numbered lines of text files that many tasks read.

A file is read in blocks. A first scan counts the lines of each block; running sums over the blocks of a file, a row a block, give
the number of each block's first line. A second scan numbers lines within their block by their place in the scan. The blocks are
written first and, up to ``SENT_BLOCKS`` of them, sent to all tasks, so lines are neither shuffled nor collected. Both scans must cut the files alike: each line checks that its block is one of the first scan's
and its place among those of that block, and the job fails otherwise, so a wrong number cannot come out. Files are cut by the
cluster's parallelism unless ``spark.sql.files.minPartitionNum`` is set; ``read_lines`` sets it to what it is now.

Lines end at \\n, \\r\\n or \\r. A file that cannot be split (compressed) is one block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

PARTS = "spark.sql.files.minPartitionNum"
#: A broadcast holds so many blocks at most (some 100 bytes each); more are joined by a shuffle.
SENT_BLOCKS = 500_000


def blocks(lines: DataFrame) -> DataFrame:
    """Per block of the scan: file, start, length, the place of its first line in the scan (``first``), its number of lines and the
    lines before it in its file (``before``) and in all files in order of their names (``before_all``)."""
    found = lines.groupBy("file", "start", "length").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    all_earlier = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)  # a row a block, not a line
    return found.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "before_all": F.coalesce(F.sum("n").over(all_earlier), F.lit(0))})


def read_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """file, line (from 1 in each file, blank ones counted), row (from 0 over all files in order of their names) and value; blank lines
    are left out unless asked for."""
    if not spark.conf.get(PARTS, None):
        spark.conf.set(PARTS, str(spark.sparkContext.defaultParallelism))
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"),
        F.monotonically_increasing_id().alias("at"), "value")
    known = written(blocks(scan.drop("value")), "blocks")
    known = F.broadcast(known) if known.count() <= SENT_BLOCKS else known
    numbered = scan.join(known, ["file", "start", "length"], "left")
    place = F.col("at") - F.col("first")
    fits = F.coalesce((place >= 0) & (place < F.col("n")), F.lit(False))
    place = F.when(fits, place).otherwise(F.raise_error(F.concat(F.lit("files were cut in another way by the second scan: "), "file")).cast("long"))
    out = numbered.withColumn("place", place).select("file", (F.col("before") + F.col("place") + 1).alias("line"), (F.col("before_all") + F.col("place")).alias("row"), "value")
    return out if blank else out.filter(F.col("value").rlike(r"\S"))

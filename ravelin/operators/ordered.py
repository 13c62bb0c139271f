"""Global order without a window over all rows or over one hot group.

Rows are dealt to ranges of an ascending key (nulls first). The ranges come from a sort of the keys alone, whose first keys and
counts (one row a range) go to the driver; then each row finds its range by comparing its key with those first keys, in the one
shuffle of whole rows. That assignment follows from the key only, so a task that runs again puts every row where it was. What
runs over range ends (a number, a running sum of a group cut by an end) is made in each range by itself and then raised by an
offset for each range, summed up on the driver from one row a range and group cut by its ends.

Rows with equal keys stay in one range: a key should name a row where it can. Driver and plan hold a row for each range, which
the caller chooses (``spark.sql.shuffle.partitions`` by default), whatever the number of rows."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How totals of a group in several ranges become one.
MERGE = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "bit_xor": lambda a, b: a ^ b, "min": min, "max": max}


class Ranges:
    """``rows``: all columns and ``bucket``, the number of the row's range, by which the rows are partitioned. ``heads`` and
    ``counts``: first key and number of rows of each range. ``key``: the ordering columns by name."""

    def __init__(self, df: DataFrame, key: list[str], parts: int | None = None, bucket: str = "bucket"):
        parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.key, self.bucket = key, bucket
        named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]
        thin = df.select(*named)
        whole = F.struct(*(F.col(c) for c in thin.columns))
        ranged = thin.repartitionByRange(parts, *(F.asc_nulls_first(c) for c in thin.columns))
        found = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(whole).alias("head"), F.count("*").alias("n")).orderBy("p").collect()
        self.heads, self.counts = [tuple(r["head"]) for r in found], [r["n"] for r in found]
        self.rows = df.withColumn(bucket, self._place(thin.schema)).repartitionById(max(1, len(found)), F.col(bucket))

    def _place(self, schema: T.StructType) -> Column:
        if not self.heads:
            return F.lit(0)
        own = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(self.key)))
        array = lambda heads: F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(h, schema))) for h in heads))
        step = max(1, round(len(self.heads) ** 0.5))  # first among every step-th head, then among those of one step
        coarse = F.size(F.filter(array(self.heads[::step]), lambda x: x <= own)) - 1
        fine = F.size(F.filter(F.slice(array(self.heads), coarse * step + 1, step), lambda x: x <= own)) - 1
        return (coarse * step + fine).cast("int")

    def window(self, *group: str):
        return Window.partitionBy(self.bucket, *group).orderBy(*(F.asc_nulls_first(f"`{c}`") for c in self.key if c not in group))

    def offsets(self, values: list, kind: str) -> Column:
        """The value of the row's range."""
        array = F.array(*(F.lit(v).cast(kind) for v in values or [0]))
        return F.element_at(array, F.col(self.bucket) + 1)

    def numbers(self) -> Column:
        """The row's number in the whole order, from 0."""
        before = [0, *accumulate(self.counts[:-1])]
        return F.row_number().over(self.window()).cast("long") - 1 + self.offsets(before, "long")

    def running(self, group: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
        """``rows`` with a running aggregate (``sum``, ``count``, ``bit_xor``, ``min`` or ``max``) for each name, over the rows of
        the same group up to this one. ``group`` names the first columns of the key, or some columns that these settle."""
        width = len(group)
        if self.key[:width] != group:
            raise ValueError("the key must begin with the group")
        frame = self.window(*group).rowsBetween(Window.unboundedPreceding, 0)
        inner = self.rows.withColumns({f"{name} in range": getattr(F, kind)(value).over(frame) for name, (kind, value) in values.items()})
        started = [h[:width] for h in self.heads]  # the group that each range begins with
        totals: dict[tuple[int, int], tuple] = {}
        if len(started) > 1:  # rows of the group that begins a range may end the range before
            kinds = [self.rows.schema[c].dataType for c in group]
            heads = self.rows.sparkSession.createDataFrame([(b, *started[b]) for b in range(len(started))], T.StructType([T.StructField("b", T.IntegerType()), *(T.StructField(f"g{i}", k) for i, k in enumerate(kinds))]))
            same = reduce(lambda x, y: x & y, (F.col(f"`{c}`").eqNullSafe(F.col(f"g{i}")) for i, c in enumerate(group)))
            ends = F.col(self.bucket) == F.col("b") - 1
            named = {f"v{i}": getattr(F, kind)(value).alias(f"v{i}") for i, (kind, value) in enumerate(values.values())}
            joined = self.rows.join(F.broadcast(heads), ends & same)
            for r in joined.groupBy(F.col("b").alias("of"), F.col(self.bucket).alias("at")).agg(*named.values()).collect():
                totals[r["of"], r["at"]] = tuple(r[f"v{i}"] for i in range(len(values)))
        offsets = []
        for b in range(len(started)):
            before: tuple = (None,) * len(values)
            if b and (b, b - 1) in totals:
                before = totals[b, b - 1]
                if started[b - 1] == started[b]:  # the range before holds nothing else, or began with this group
                    before = tuple(_merge(kind, x, y) for (kind, _), x, y in zip(values.values(), before, offsets[b - 1]))
            offsets.append(before)
        kinds = {name: inner.schema[f"{name} in range"].dataType for name in values}
        first = F.element_at(F.array(*(F.struct(*(F.lit(v).cast(self.rows.schema[c].dataType).alias(f"g{i}") for i, (c, v) in enumerate(zip(group, s)))) for s in started or [(None,) * width])), F.col(self.bucket) + 1)
        starts = reduce(lambda x, y: x & y, (first[f"g{i}"].eqNullSafe(F.col(f"`{c}`")) for i, c in enumerate(group)), F.lit(True))
        out = {}
        for i, (name, (kind, _)) in enumerate(values.items()):
            own, carried = F.col(f"`{name} in range`"), F.when(starts, self.offsets([o[i] for o in offsets], kinds[name].simpleString()))
            joined_up = {"sum": own + carried, "count": own + carried, "bit_xor": own.bitwiseXOR(carried), "min": F.least(own, carried), "max": F.greatest(own, carried)}[kind]
            out[name] = F.coalesce(joined_up, own, carried)
        return inner.withColumns(out).drop(*(f"{name} in range" for name in values))


def _merge(kind: str, a, b):
    return b if a is None else a if b is None else MERGE[kind](a, b)


def numbered(df: DataFrame, key: list[str], name: str = "row", parts: int | None = None) -> DataFrame:
    """All rows with their number in ascending order of the key (nulls first), from 0."""
    ranges = Ranges(df, key, parts, bucket="row bucket")
    return ranges.rows.withColumn(name, ranges.numbers()).drop("row bucket")

"""Exact order statistics by refining histograms.

A value becomes an integer key of the same order (of doubles, the bits of their magnitude with the sign). Each pass counts, in every
group, the next ``BITS`` bits of the keys that begin like a wanted one, and so settles as many bits of it; a bin whose least and
greatest key are equal settles it at once. After at most 64 / BITS passes every wanted key is known, and with it the value: exact,
like a sort, but only counts of bins move, at most 2**BITS a wanted value, group and task, however many distinct values there are.
A group with most of the rows is counted by all tasks that read it; wanted keys' beginnings are joined to the rows and written
between passes, so a lost executor costs a pass. Once the bins that are still wanted hold ``FEW`` rows together, the next
pass counts whole keys and is the last.

Nulls are not counted. NaN is the greatest value, as in Spark's order; -0.0 is 0.0. A group without values has no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import drop, written

BITS = 16
#: Rows that are few enough to be counted by their whole keys.
FEW = 1_000_000
#: Fixed values of the double format: bits of the fraction, bias and least normal exponent.
FRACTION, BIAS, LEAST = 52, 1023, -1022
INFINITY = 2047 << FRACTION


def with_keys(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Rows with ``value``, a number, date, timestamp or boolean, and ``key``, a long in the order of the values in its place."""
    value = F.col("value")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        power = lambda e: F.pow(F.lit(2.0), e.cast("double"))  # noqa: E731  exact
        rows = rows.withColumn("size", F.abs(value.cast("double"))).withColumn("e", F.when(F.col("size") < float("inf"), F.floor(F.log2("size")).cast("int")))
        rows = rows.withColumn("e", F.when(power(F.col("e")) > F.col("size"), F.col("e") - 1).when(power(F.col("e") + 1) <= F.col("size"), F.col("e") + 1).otherwise(F.col("e")))
        part = ((F.col("size") / power(F.col("e")) - 1) * float(1 << FRACTION)).cast("long")
        normal = (F.col("e") + BIAS).cast("long") * F.lit(1 << FRACTION) + part
        bits = F.when(F.col("size") == 0, F.lit(0)).when(F.isnan("size"), F.lit(INFINITY + 1)).when(F.col("size") == float("inf"), F.lit(INFINITY)).when(F.col("size") < 2.0**LEAST, (F.col("size") / F.lit(5e-324)).cast("long")).otherwise(normal)
        rows = rows.withColumn("key", bits.cast("long"))
        return rows.withColumn("key", F.when((value < 0) & ~F.isnan("size"), -F.col("key")).otherwise(F.col("key"))).drop("size", "e", "value")
    if isinstance(kind, T.TimestampType):
        key = F.unix_micros(value)
    elif isinstance(kind, T.DateType):
        key = F.unix_date(value).cast("long")
    elif isinstance(kind, T.BooleanType):
        key = value.cast("int").cast("long")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        key = value.cast("long")
    else:
        raise TypeError(f"no order-preserving key for {kind.simpleString()}")
    return rows.withColumn("key", key).drop("value")


def with_values(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """``value`` in the place of ``key``."""
    key = F.col("key")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        rows = rows.withColumn("bits", F.abs(key)).withColumn("e", F.shiftright("bits", FRACTION).cast("int"))
        rows = rows.withColumn("part", (F.col("bits") - F.shiftleft(F.col("e").cast("long"), FRACTION)).cast("double"))
        normal = (1 + F.col("part") / float(1 << FRACTION)) * F.pow(F.lit(2.0), (F.col("e") - BIAS).cast("double"))
        size = F.when(F.col("bits") > INFINITY, F.lit(float("nan"))).when(F.col("bits") == INFINITY, F.lit(float("inf"))).when(F.col("e") == 0, F.col("part") * F.lit(5e-324)).otherwise(normal)
        rows = rows.withColumn("size", size).drop("bits", "e", "part")
        return rows.withColumn("value", F.when(key < 0, -F.col("size")).otherwise(F.col("size")).cast(kind)).drop("size", "key")
    if isinstance(kind, T.TimestampType):
        value = F.timestamp_micros(key)
    elif isinstance(kind, T.DateType):
        value = F.date_from_unix_date(key.cast("int"))
    else:
        value = key.cast("int").cast(kind) if isinstance(kind, T.BooleanType) else key.cast(kind)
    return rows.withColumn("value", value).drop("key")


def at_ranks(rows: DataFrame, value: str, ranks: dict[str, Column], *by: str, bits: int = BITS) -> DataFrame:
    """Per group: its columns, n (values) and for each name the value at that place of the ascending order; a place is an expression
    of ``n`` that gives a long from 0 to n - 1."""
    kind = rows.schema[value].dataType
    groups = [f"g{i}" for i in range(len(by))]
    keys = with_keys(rows.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, groups)), F.col(value).alias("value")), kind)
    shifts = [max(0, 64 - bits * k) for k in range(1, -(-64 // bits) + 1)]
    cell = [F.count("*").alias("c"), F.min("key").alias("low"), F.max("key").alias("high")]
    shift = lambda s: F.shiftright("key", s) if s else F.col("key")
    counted = keys.groupBy(*groups, shift(shifts[0]).alias("begin")).agg(*cell)
    ordered = W.partitionBy(*groups).orderBy("begin")
    counted = counted.withColumns({"upto": F.sum("c").over(ordered), "n": F.sum("c").over(W.partitionBy(*groups))})
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("rank")) for name, place in ranks.items()))
    inside = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
    held = [*groups, "n", "name", "rank", "begin", "low", "high", "c"]
    first = counted.withColumn("w", F.explode(wanted)).select("*", "w.name", "w.rank").filter(inside)
    state = written(first.withColumn("rank", F.col("rank") - (F.col("upto") - F.col("c"))).select(*held), "ranks")
    grouped = reduce(lambda x, y: x & y, (F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups), F.lit(True))
    for before, now in zip(shifts, shifts[1:]):
        open_ = state.filter("low < high")
        begins = open_.select(*(F.col(g).alias(f"w{g}") for g in groups), F.col("begin").alias("wanted"), "c").distinct()
        left = begins.agg(F.sum("c")).first()[0]
        if not left:
            break
        match = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"w{g}")) for g in groups), shift(before) == F.col("wanted"))
        rest = keys.join(begins, match, "left_semi")
        last_pass = left <= FEW
        bins = rest.groupBy(*groups, shift(before).alias("was"), (F.col("key") if last_pass else shift(now)).alias("begin")).agg(*cell)
        bins = bins.withColumn("upto", F.sum("c").over(W.partitionBy(*groups, "was").orderBy("begin")))
        o = open_.select(*groups, "n", "name", "rank", F.col("begin").alias("was")).alias("a")
        found = o.join(bins.alias("b"), grouped & (F.col("a.was") == F.col("b.was")) & inside)
        found = found.select(*(F.col(f"a.{g}").alias(g) for g in groups), "n", "name", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), "begin", "low", "high", "c")
        last, state = state, written(state.filter("low = high").select(*held).unionByName(found), "ranks")
        drop(rows.sparkSession, last)
        if last_pass:
            break
    known = with_values(state.select(*groups, "n", "name", F.col("low").alias("key")), kind)
    out = known.groupBy(*groups, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks))
    return out.select(*(F.col(g).alias(c) for g, c in zip(groups, by)), "n", *ranks)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Per group: n and for each name the quantile of that share, linear between neighbours (place share * (n - 1))."""
    place = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = {f"{name} {side}": f(place[name]) for name in shares for side, f in (("low", F.floor), ("high", F.ceil))}
    found = at_ranks(rows.withColumn(value, F.col(value).cast("double")), value, ranks, *by)

    def between(name: str) -> Column:
        low, high = F.col(f"`{name} low`"), F.col(f"`{name} high`")
        return F.when(low == high, low).otherwise(low + (high - low) * (place[name] - F.floor(place[name])))

    return found.select(*by, "n", *(between(name).alias(name) for name in shares))

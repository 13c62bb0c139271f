"""Running aggregates along time for keys of which a few may hold most rows.

A key's time is cut into slots. Windows run within (key, slot), so one key has as many tasks as it has slots; what came before a
slot is a running aggregate over the totals of the key's slots, a row a slot, which joins the slot's rows as one more row. So a
window over a whole key, which would be one task, is never made; rows are shuffled once, and totals are summed before they move.

Rows of one key in one slot meet in one task; a slot is as narrow as the caller says. Slots without rows cost nothing. Rows whose
time is null stand in a slot of their own, before all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT, TOTAL = "time slot", "is a total"
#: Rows that a key should have in a slot at most, and passes that look for a slot as narrow as that.
SLOT_ROWS, PASSES = 100_000, 4


def slot(us: str, width_us: int) -> Column:
    return F.expr(f"(`{us}` - pmod(`{us}`, {width_us})) div {width_us}")


def fitting(rows: DataFrame, by: list[str], us: str, width_us: int, most: int | None = None) -> int:
    """A width up to ``width_us`` with which no key has more than ``most`` (``SLOT_ROWS``) rows in a slot; rows of one time stay together.
    Each pass counts the rows of the slots."""
    most = most or SLOT_ROWS
    for _ in range(PASSES):
        counts = rows.filter(F.col(us).isNotNull()).groupBy(*by, slot(us, width_us).alias(SLOT)).agg(F.count("*").alias("n"))
        top = counts.agg(F.max("n")).first()[0] or 0
        if top <= most or width_us == 1:
            break
        width_us = max(1, width_us // -(-top // most))
    return width_us


def running(rows: DataFrame, by: list[str], order: list[str], width_us: int, values: dict[str, tuple[str, Column, bool]], *, backwards: bool = False) -> DataFrame:
    """Rows with, for each name, an aggregate (``sum``, ``count``, ``min`` or ``max``) of the key's rows up to this one (the flag:
    with it) in the order of these columns, of which the first is the time in microseconds; ``backwards``: from this one on."""
    way = F.desc_nulls_last if backwards else F.asc_nulls_first
    rows = rows.withColumns({SLOT: slot(order[0], width_us)} | {f"{name} own": value for name, (_, value, _) in values.items()})
    totals = rows.groupBy(*by, SLOT).agg(*(getattr(F, kind)(f"{name} own").alias(f"{name} total") for name, (kind, *_) in values.items()))
    earlier = W.partitionBy(*by).orderBy(way(SLOT)).rowsBetween(W.unboundedPreceding, -1)
    over_totals = {"count": F.sum}
    base = totals.select(*by, SLOT, F.lit(True).alias(TOTAL), *(over_totals.get(kind, getattr(F, kind))(f"{name} total").over(earlier).alias(f"{name} base") for name, (kind, *_) in values.items()))
    both = rows.withColumn(TOTAL, F.lit(False)).unionByName(base, allowMissingColumns=True)
    inside = W.partitionBy(*by, SLOT).orderBy(F.asc(TOTAL), *(way(c) for c in order))
    out = {}
    for name, (kind, _, own) in values.items():
        part = getattr(F, kind)(f"{name} own").over(inside.rowsBetween(W.unboundedPreceding, 0 if own else -1))
        before = F.max(f"{name} base").over(W.partitionBy(*by, SLOT))
        out[name] = {"min": F.least, "max": F.greatest}[kind](before, part) if kind in ("min", "max") else F.coalesce(before + part, before, part)
    return both.withColumns(out).filter(~F.col(TOTAL)).drop(SLOT, TOTAL, *(f"{name} {x}" for name in values for x in ("own", "base")))


def levels(events: DataFrame, window_us: int, by: list[str], pieces: int = 8) -> DataFrame:
    """by, us, level: how many events the window that ends at us holds, at each time at which an event comes or leaves. An event
    comes at us and leaves at us + window_us; changes at one time are added up before they move."""
    both = F.explode(F.array(F.struct(F.col("us").alias("us"), F.lit(1).alias("change")), F.struct((F.col("us") + window_us).alias("us"), F.lit(-1).alias("change"))))
    changes = events.filter("us is not null").select(*by, both.alias("x")).groupBy(*by, F.col("x.us").alias("us")).agg(F.sum("x.change").alias("change"))
    return running(changes, by, ["us"], max(1, window_us // pieces), {"level": ("sum", F.col("change"), True)}).drop("change")

"""Online state over events in batch form: windows anchored at events, quotas, budgets, caches, admission; and time series.

Operators whose state depends on all earlier events of a key (not a running sum) read the key's events as a sorted stream
within one partition (``fold``): state has constant size, so a hot key costs time but no memory. Rows come as Arrow values, so
null keys are one key and integers stay integers."""

from __future__ import annotations

import math
from collections import OrderedDict, namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import written
from . import timeline

#: Output rows that a task gathers before it hands them on.
ROWS_OUT = 10_000


def simulate(rows: DataFrame, key: str, order: list[str], run: Callable[[Iterator], Iterator[dict]], schema: str) -> DataFrame:
    """``run`` over each key's rows in order, as an iterator of tuples with the columns' names; it gives output rows as dicts."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    Row = namedtuple("Row", rows.columns)
    place = rows.columns.index(key)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _, group in groupby(walk(batches), key=lambda r: r[place]):
            for made in run(map(Row._make, group)):
                out.append(made)
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(part, schema)


def fold(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """step(state, row) -> (state, output row as a dict), over each key's rows in order."""

    def run(group: Iterator) -> Iterator[dict]:
        state = start()
        for row in group:
            state, made = step(state, row)
            yield made

    return simulate(rows, key, order, run, schema)


@dataclass(frozen=True)
class Fold:
    """What is carried from event to event of a key. ``columns`` besides key and order; ``ends``: the time in microseconds from
    which a state is as good as none, so that a stream can forget it."""

    columns: list[str]
    start: Callable
    step: Callable
    schema: str
    ends: Callable

    def over(self, rows: DataFrame, key: str) -> DataFrame:
        return fold(rows.select("event_id", key, "us", *self.columns), key, ["us", "event_id"], self.start, self.step, self.schema)


def anchored_limit(limit: int, window_us: int) -> Fold:
    """Windows start at a key's first event after the last window; denied events count."""

    def step(state, row):
        begin, count = state
        if begin is None or row.us - begin >= window_us:
            begin, count = row.us, 0
        count += 1
        allowed = count <= limit
        return (begin, count), {"event_id": row.event_id, "count": count, "allowed": allowed, "remaining": max(limit - count, 0), "retry_us": 0 if allowed else begin + window_us - row.us}

    return Fold([], lambda: (None, 0), step, "event_id long, count long, allowed boolean, remaining long, retry_us long", lambda state: state[0] + window_us)


def rate_limit(events: DataFrame, limit: int, window_us: int, key: str = "user_id") -> DataFrame:
    """events: event_id, key, us."""
    return anchored_limit(limit, window_us).over(events, key)


def ttl_cache(requests: DataFrame, ttl_us: int) -> DataFrame:
    """Hit or miss of each request of a key; a miss stores. requests: event_id, key, us, cacheable."""

    def step(state, row):
        hit = state != () and row.us - state[0] < ttl_us
        if not hit and row.cacheable:
            state = (row.us,)
        return state, {"event_id": row.event_id, "hit": hit}

    return fold(requests.select("event_id", "key", "us", "cacheable"), "key", ["us", "event_id"], lambda: (), step, "event_id long, hit boolean")


def ewma(rows: DataFrame, alpha: float, key: str = "user_id") -> DataFrame:
    """The running average of each key; the first value starts it. rows: event_id, key, us, value."""

    def step(state, row):
        state = row.value if state is None else alpha * row.value + (1 - alpha) * state
        return state, {"event_id": row.event_id, "ewma": state}

    return fold(rows.select("event_id", key, "us", "value"), key, ["us", "event_id"], lambda: None, step, "event_id long, ewma double")


#: Slots of running counts of a day or a key, in microseconds.
MINUTE, HOUR = 60_000_000, 3_600_000_000


def daily_quota(events: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    """Per key and UTC day. events: event_id, key, us."""
    rows = events.select("event_id", key, "us", F.floor(F.col("us") / 86_400_000_000).alias("day"))
    rows = timeline.running(rows, [key, "day"], ["us", "event_id"], HOUR, {"used": ("count", F.lit(1), True)})
    return rows.select("event_id", key, F.col("used").cast("int").alias("used"), (F.col("used") <= limit).alias("allowed"))


def quota_guard(events: DataFrame, zone: str = "America/Los_Angeles", rpm: int = 15, rpd: int = 500, margin: float = 0.9, key: str = "user_id") -> DataFrame:
    """Cooldown, then minute quota, then day quota (days of ``zone``); what a step denies does not use the later ones. events:
    event_id, key, us, until (end of the cooldown that earlier rejections opened, or null, see ``cooldown``)."""
    per_minute, per_day = math.floor(rpm * margin), math.floor(rpd * margin)
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros("us"), zone))
    rows = events.withColumns({"day": day, "cooling": F.coalesce(F.col("until") > F.col("us"), F.lit(False))})
    rows = rows.withColumn("in_minute", F.row_number().over(W.partitionBy(key, "cooling", F.floor(F.col("us") / 60_000_000)).orderBy("us", "event_id")))
    passed = (~F.col("cooling") & (F.col("in_minute") <= per_minute)).cast("int")
    rows = timeline.running(rows, [key, "day"], ["us", "event_id"], MINUTE, {"used": ("sum", passed, True)})
    reason = F.when(F.col("cooling"), "cooldown").when(F.col("in_minute") > per_minute, "rpm_exhausted").when(F.col("used") > per_day, "rpd_exhausted").otherwise("ok")
    rows = rows.withColumn("reason", reason)
    case = lambda cooling, minute, daily, ok: F.when(F.col("reason") == "cooldown", cooling).when(F.col("reason") == "rpm_exhausted", minute).when(F.col("reason") == "rpd_exhausted", daily).otherwise(ok)
    midnight = F.unix_micros(F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), zone))
    counted = ~F.col("reason").isin("cooldown", "rpm_exhausted")
    return rows.select(
        "event_id",
        "reason",
        case(F.lit(0), F.lit(0), F.lit(per_minute) - F.col("in_minute"), F.lit(per_minute) - F.col("in_minute")).alias("remaining_rpm"),
        case(F.lit(0), F.lit(per_day), F.lit(0), F.lit(per_day) - F.col("used")).cast("long").alias("remaining_rpd"),
        case(F.col("until") - F.col("us"), F.lit(60_000_000) - F.col("us") % 60_000_000, midnight - F.col("us"), F.lit(0)).alias("retry_us"),
        (counted & (F.col("used") >= per_day * 0.8)).alias("alert"),
    )


def cooldown(events: DataFrame, default_us: int = 60_000_000, key: str = "user_id") -> DataFrame:
    """With ``until``, the latest of earlier rejections plus their retry time (null: none), until which the key is closed. events:
    event_id, key, us, rejected, retry_us (null: the default)."""
    ends = F.when(F.col("rejected"), F.col("us") + F.coalesce("retry_us", F.lit(default_us)))
    return timeline.running(events, [key], ["us", "event_id"], HOUR, {"until": ("max", ends, False)})


def daily_budget(limit: int, margin: float = 0.9) -> Fold:
    """``budget`` of each key from event to event; a state ends with its UTC day."""
    enforced, day_us = math.floor(limit * margin), 86_400_000_000

    def step(state, row):
        day, used = state
        if row.us // day_us != day:
            day, used = row.us // day_us, 0
        opened = used >= enforced
        made = {"event_id": row.event_id, "used_before": used, "open": opened, "alert": not opened and used + row.n >= enforced * 0.8}
        return (day, used if opened else used + row.n), made

    return Fold(["n"], lambda: (None, 0), step, "event_id long, used_before long, open boolean, alert boolean", lambda state: (state[0] + 1) * day_us)


def budget(events: DataFrame, limit: int, margin: float = 0.9, key: str = "resource") -> DataFrame:
    """Open once the use before an event reached the limit; open events use nothing, so the use stays what it was when the limit
    was first reached. events: event_id, key, us, n."""
    enforced = math.floor(limit * margin)
    day = F.floor(F.col("us") / 86_400_000_000)
    order = [key, "day"], ["us", "event_id"], MINUTE
    rows = timeline.running(events.withColumn("day", day), *order, {"total": ("sum", F.col("n"), True)})
    rows = timeline.running(rows, *order, {"reached": ("min", F.when(F.col("total") >= enforced, F.col("total")), False)})
    rows = rows.withColumn("before", F.coalesce("reached", F.col("total") - F.col("n")))
    opened = F.col("before") >= enforced
    return rows.select("event_id", F.col("before").alias("used_before"), opened.alias("open"), (~opened & (F.col("before") + F.col("n") >= enforced * 0.8)).alias("alert"))


def breaker(limit: int, margin: float = 0.9, alert_share: float = 0.8, cache_us: int = 60_000_000) -> Fold:
    """Whether writes are allowed by the size of a store, which is read anew once a reading is ``cache_us`` old; a reading that
    failed (null) counts as 0."""
    enforced = math.floor(limit * margin)

    def step(state, row):
        at, size = state
        if at is None or row.us - at >= cache_us:
            at, size = row.us, row.size or 0
        name = "open" if size >= enforced else "alert" if size >= alert_share * enforced else "closed"
        return (at, size), {"event_id": row.event_id, "state": name, "allowed": name != "open", "size": size}

    return Fold(["size"], lambda: (None, 0), step, "event_id long, state string, allowed boolean, size long", lambda state: state[0] + cache_us)


def storage_breaker(checks: DataFrame, limit: int, margin: float = 0.9, alert_share: float = 0.8, cache_us: int = 60_000_000, key: str = "store") -> DataFrame:
    """checks: event_id, key, us, size."""
    return breaker(limit, margin, alert_share, cache_us).over(checks, key)


def first_alerts(alerts: DataFrame, key: str) -> DataFrame:
    """The first alert of each key and UTC day. alerts: event_id, key, us."""
    day = F.floor(F.col("us") / 86_400_000_000)
    return alerts.groupBy(key, day.alias("day")).agg(F.min_by("event_id", F.struct("us", "event_id")).alias("event_id"))


def admission(jobs: DataFrame, slots: int = 2, depth: int = 4, alpha: float = 0.2, key: str = "server") -> DataFrame:
    """A queue with ``slots`` servers: a job that must wait while ``depth`` wait is rejected, with a time after which to try
    again. jobs: job_id, key, at, seconds."""

    def run(group):
        busy: list[float] = []  # ends of running jobs
        waiting: list[float] = []  # start times of waiting jobs
        average = 1.0
        ended: list[tuple[float, float]] = []
        for job in group:
            for end, took in sorted(x for x in ended if x[0] <= job.at):
                average = alpha * took + (1 - alpha) * average
            ended = [x for x in ended if x[0] > job.at]
            busy = [e for e in busy if e > job.at]
            waiting = [s for s in waiting if s > job.at]
            running = len(busy) - len(waiting)
            if running >= slots and len(waiting) >= depth:
                yield {"job_id": job.job_id, "admitted": False, "start": None, "retry_after": max(1, math.ceil((len(waiting) + running) * average / slots))}
                continue
            start = job.at if running < slots else sorted(busy)[-slots]
            busy.append(start + job.seconds)
            ended.append((start + job.seconds, job.seconds))
            if start > job.at:
                waiting.append(start)
            yield {"job_id": job.job_id, "admitted": True, "start": start, "retry_after": None}

    return simulate(jobs.select("job_id", key, "at", "seconds"), key, ["at", "job_id"], run, "job_id long, admitted boolean, start double, retry_after double")


def fifo_cache(requests: DataFrame, size: int = 256, ttl_us: int = 3_600_000_000, key: str = "server") -> DataFrame:
    """A cache of bounded size: the oldest entry goes first. requests: event_id, server, query, us."""

    def run(group):
        held: OrderedDict[str, int] = OrderedDict()
        for r in group:
            at = held.get(r.query)
            hit = at is not None and r.us - at < ttl_us
            if not hit:
                held.pop(r.query, None)
                while len(held) >= size:
                    held.popitem(last=False)
                held[r.query] = r.us
            yield {"event_id": r.event_id, "hit": hit}

    return simulate(requests.select("event_id", key, "query", "us"), key, ["us", "event_id"], run, "event_id long, hit boolean")


# Time series --------------------------------------------------------------------------------------------------------

#: Upper bounds of the request duration histogram.
BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.5, 5.0, 10.0, 30.0)


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def increase(events: DataFrame, window_us: int, *by: str) -> DataFrame:
    """Events of the window that ends with each event. events: event_id, us; an event without a time has no row."""
    held = timeline.levels(events, window_us, list(by)).alias("h")
    rows = events.alias("e")
    return rows.join(held, same(rows, held, [*by, "us"])).select("e.event_id", *(F.col(f"e.{c}") for c in by), F.col("h.level").alias("increase"))


def counter_rate(samples: DataFrame, window_us: int, *by: str) -> DataFrame:
    """Of the samples of a cumulative counter in the window that ends with each: the increase (falls are resets), stretched to the
    window as far as its ends are near samples, and its rate a second. samples: us (once for each of ``by``), value. Slots get narrower
    with more samples, so a task's memory does not grow with them; the running sums are written, since three steps read them."""
    keys = list(by)
    width = timeline.fitting(samples, keys, "us", max(1, window_us // 8))
    rows = written(timeline.running(counter_increase(samples, *by, width_us=width), keys, ["us"], width, {"place": ("count", F.lit(1), True), "upto": ("sum", F.col("increase"), True)}), "counter")
    # The first sample of each window: the next one after the time at which the window begins.
    probes = rows.select(*keys, (F.col("us") - window_us).alias("us"), F.col("us").alias("of"))
    marked = rows.withColumn("of", F.lit(None).cast("long")).unionByName(probes, allowMissingColumns=True)
    sample = F.when(F.col("of").isNull(), F.struct("us", "value", "increase", "place", "upto"))
    # Of a sample and a probe at one time the sample comes later on the way back, so the probe does not see it.
    first = timeline.running(marked.withColumn("probe", F.col("of").isNotNull()), keys, ["us", "probe", "of"], width, {"first": ("min", sample, False)}, backwards=True)
    first = first.filter("of is not null").select(*keys, F.col("of").alias("us"), "first").alias("f")
    rows = rows.alias("r")
    rows = rows.join(first, same(rows, first, [*keys, "us"])).select("r.*", "f.first")
    gained, span, n = F.col("upto") - F.col("first.upto"), F.col("us") - F.col("first.us"), F.col("place") - F.col("first.place") + 1
    lead = F.col("first.us") - (F.col("us") - window_us)
    step = span / (n - 1)
    before = F.when(lead < step * 1.1, lead).otherwise(step / 2)
    zero = F.when((gained > 0) & (F.col("first.value") >= 0), span * F.col("first.value") / gained)  # a counter is not carried on below 0
    full = F.when(n > 1, gained * (span + F.least(before, F.coalesce(zero, before))) / span)
    return rows.select(*by, "us", F.round(full, 6).alias("increase"), F.round(full * 1_000_000 / window_us, 9).alias("rate"))


def counter_increase(samples: DataFrame, *by: str, width_us: int = HOUR) -> DataFrame:
    """The increase between samples of a cumulative counter; a fall is a reset. samples: us, value."""
    rows = timeline.running(samples.select(*by, "us", "value"), list(by), ["us"], width_us, {"last": ("max", F.struct("us", "value"), False)})
    last = F.col("last.value")
    return rows.select(*by, "us", "value", F.when(last.isNull(), 0.0).when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last).alias("increase"))


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """buckets: le (infinity for the last), n (not cumulative). Linear within the bucket; the top finite bound beyond it."""
    w = W.partitionBy(*by).orderBy("le")
    rows = buckets.withColumns({"cum": F.sum("n").over(w), "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.sum("n").over(W.partitionBy(*by))})
    rows = rows.withColumn("rank", F.lit(q) * F.col("total")).filter((F.col("cum") >= F.col("rank")) & (F.col("total") > 0))
    first = rows.groupBy(*by).agg(F.min_by(F.struct("le", "low", "cum", "n", "rank"), "le").alias("b"))
    within = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * (F.col("b.rank") - (F.col("b.cum") - F.col("b.n"))) / F.col("b.n")
    return first.select(*by, F.round(F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(within), 6).alias("quantile"))


def firing(states: DataFrame, steps: int, *by: str) -> DataFrame:
    """Grid points at which a condition has held at each of the last steps + 1 points without a break. states: step, active."""
    w = W.partitionBy(*by).orderBy("step")
    on = states.filter("active").withColumn("island", F.col("step") - F.row_number().over(w))
    held = F.row_number().over(W.partitionBy(*by, "island").orderBy("step"))
    return on.withColumn("held", held).filter(F.col("held") > steps).select(*by, "step")

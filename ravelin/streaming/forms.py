"""Structured Streaming forms of windowed counts, alert dedupe and folds over the events of a key (rate limit, budget, breaker).

Rows that come later than the watermark are dropped, which the batch forms do not do."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import Fold


def windowed_counts(events: DataFrame, window: str, slide: str | None, *by: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), *by).agg(F.count("*").alias("n"))


def first_per_day(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return events.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key, "day"])


def folded(events: DataFrame, folds: Fold, key: str, late: str = "10 minutes") -> DataFrame:
    """The fold over each key's events in order of time, as a stream: what the batch form gives, in whatever order the events come,
    as long as they are not late. events: event_id, ts, us (the same time in microseconds), key and the fold's columns.

    An event waits until the watermark has passed it and is then handled in its turn, so the stream holds each key's events of the
    last ``late`` and the fold's state. A timer on event time wakes a key whose waiting events are due without new ones, and one
    whose state has ended; that state is removed, so a key that falls silent costs nothing. Events with a null key are one key."""
    columns = ["us", "event_id", *folds.columns]
    out = [f.name for f in T.StructType.fromDDL(folds.schema)]
    Row = namedtuple("Row", columns)

    def run(_, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting = json.loads(group.get[0]) if group.exists else (None, [])
        for frame in frames:
            waiting += json.loads(frame[columns].to_json(orient="values"))
        passed = group.getCurrentWatermarkMs()
        due = sorted(row for row in waiting if row[0] < passed * 1000)
        waiting = [row for row in waiting if row[0] >= passed * 1000]
        made = []
        state = tuple(state) if state is not None else folds.start()
        for row in due:
            state, told = folds.step(state, Row(*row))
            made.append(told)
        over = folds.ends(state) if state != folds.start() else 0  # a state that has ended is as good as none
        wake = min([row[0] for row in waiting], default=over) // 1000 + 1
        if waiting or over >= passed * 1000:
            group.update((json.dumps([state, waiting]),))
            group.setTimeoutTimestamp(max(wake, passed + 1))
        elif group.exists:
            group.remove()
        if made:
            yield pd.DataFrame(made, columns=out)

    marked = events.withWatermark("ts", late).groupBy(key)
    return marked.applyInPandasWithState(run, folds.schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)

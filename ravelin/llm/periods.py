"""Periodic run detection.

A run is a stretch of consecutive words with smallest period q, of ``MIN_WORDS`` words and two periods at least, that no neighbouring
word extends keeping period q. Words q apart that are equal are matches at lag q; a run of length L has L - q consecutive ones, an
island. First the matches at every lag up to half the text are counted: for frequent words by an exact autocorrelation (Fourier
transforms of 0/1 rows, rounded), for rare words by the differences of all pairs of their places. Only a lag with as many matches
as the shortest run of that period has is searched for islands.

Lags go up. An island at lag q whose stretch has a smaller period is a run found before: that period divides q, since the stretch is as
long as both together, and the stretch is the whole run. So all matches of a run at multiples of its period are explained; they are taken off the counts when the run is found, and a text of one word a million times over
costs one scan. In the lags that are left, islands are first looked for on a grid: an island of q matches or more covers several grid
places in a row (``GRID`` to a period), so that long lags cost a few places a period, not all words.

Every text is handled by itself, in the task that reads it. Results: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have
none and no runs; repeated rows are judged alike; other columns are not read."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import frugal, small_batches

MIN_WORDS = 12
#: A word is frequent if its pairs cost more than a transform: its count squared is above this times N log2 N.
HEAVY = 0.5
#: Grid places to a period, and the least period for which a grid is used.
GRID, GRID_FROM = 8, 64
#: Words of rows transformed at once.
TRANSFORM_WORDS = 1 << 22


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word, in order of first use."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def lag_counts(ids: np.ndarray) -> np.ndarray:
    """How many pairs of equal words are q apart, for q = 0 (left 0) to half the number of words."""
    n = len(ids)
    most = n // 2
    counts = np.zeros(most + 1, np.int64)
    often = np.bincount(ids)
    size = 1 << (2 * n - 1).bit_length()
    heavy = np.flatnonzero(often.astype(float) ** 2 > HEAVY * size * np.log2(size))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        step = max(1, TRANSFORM_WORDS // size)
        for k in range(0, len(heavy), step):
            rows = (ids == heavy[k : k + step, None]).astype(float)
            power += (np.abs(np.fft.rfft(rows, size, axis=1)) ** 2).sum(axis=0)
        counts[1:] += np.rint(np.fft.irfft(power, size)[1 : most + 1]).astype(np.int64)
    place = np.argsort(ids, kind="stable")
    if len(heavy):
        place = place[~np.isin(ids[place], heavy)]
    word = ids[place]
    for k in range(1, n):
        same = word[k:] == word[:-k]
        if not same.any():
            break
        apart = (place[k:] - place[:-k])[same]
        apart = apart[apart <= most]
        counts += np.bincount(apart, minlength=most + 1)
    return counts


def islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Stretches [start, stop) of at least so many consecutive matches at lag q, where ``least`` is q or more."""
    n = len(ids) - q
    if q >= GRID_FROM:
        step = q // GRID
        hit = ids[:n:step] == ids[q::step]
        known = _stretches(hit, least // step)  # an island covers that many grid places at least
        found = []
        for a, b in known:  # grid places a..b-1 match, a-1 and b do not
            low, high = max(0, (a - 1) * step), min(n, b * step + 1)
            found += [(low + s, low + e) for s, e in _stretches(ids[low:high] == ids[low + q : high + q], least)]
        return found
    return _stretches(ids[:n] == ids[q:], least)


def _stretches(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    start, stop = edge[0::2], edge[1::2]
    long = stop - start >= least
    return list(zip(start[long].tolist(), stop[long].tolist()))


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start, then period."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    left = lag_counts(ids)
    lag = np.arange(len(left))
    need = np.maximum(MIN_WORDS - lag, lag)
    need[0] = n + 1
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(left >= need).tolist():
        if left[q] < need[q]:  # explained meanwhile
            continue
        for a, b in islands(ids, q, int(need[q])):
            length = b - a + q
            if (a, length) in found:  # a run of a smaller period, which then divides q
                continue
            found[a, length] = q
            again = np.arange(2 * q, min(length, len(left)), q)
            left[again] -= length - again
    return sorted(((a, length, q) for (a, length), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that stand in a run after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period; by start, then period) and collapsed_text, the words left when each run
    keeps its first period only, joined by one space. ``prepare`` may change the words of a row, given its id."""
    small_batches(docs.sparkSession)
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            sizes, found, collapsed = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if prepare:
                    words = prepare(name, words)
                own = runs_of(word_ids(words))
                sizes.append(len(words))
                found.append([{"start": s, "length": m, "period": p} for s, m, p in own])
                if own:
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), own)).tolist()]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(span)), pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """Of the output of ``periodic_runs``: the longest run (ties: the first, then the shortest period) and digests of all runs and of
    the collapsed text."""
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    said = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rest = [c for c in found.columns if c not in ("runs", "collapsed_text", "n_words")]
    return found.withColumn("best", F.array_max(ranked)).select(
        *rest, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text"), 256).alias("collapsed_sha256"),
    )

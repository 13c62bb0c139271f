"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated from labelled rows.

Rule statistics of a text are counted over its whole words and lines. The forest works on four ratios of them that do not depend
on a text's length, each put on the scale of the rows labelled good: their quantiles, and beyond these the distance (``Scale``),
so that a good row with a rare but good value is no outlier. Random trees split a random ratio at a random place between the
values of a sample of labelled rows, in which rows labelled bad are a small share; a text that few splits isolate (a short path)
is anomalous. The threshold is the score above which the labelled rows that did not fit the trees have the most bad rows found,
with at most ``false_rejects`` of the good rows rejected.

The forest and threshold are fitted on a bounded sample of labelled rows (``max_rows`` of each label, by hash of the id); all
rows are judged. Results: null and wordless texts have statistics 0 and fail the base rules; without labelled rows of both
kinds only the base rules decide; repeated rows are judged alike; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import frugal
from ._store import labelled_rows
from ._text import Words, chunks, running, sequence, space_table, utf8

#: The characters counted as symbols, and the base rules' limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50


def statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Of each text the rule statistics, and the counts that ratios need."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines")
    out = {name: np.zeros(len(texts), np.int64) for name in names}
    spaces = space_table()
    tables = {"n_symbols": np.isin(np.arange(256), list(SYMBOLS))}
    starts = np.ones(256, bool)
    starts[128:192] = False  # continuation bytes
    starts &= ~spaces
    for a, b in chunks(texts, 400_000):
        words = Words(texts[a:b], spaces)
        raw, base, first = words.raw, words.base, words.first
        out["n_words"][a:b] = np.diff(first)
        for name, table in [*tables.items(), ("word_chars", starts)]:
            out[name][a:b] = np.diff(np.concatenate([[0], np.cumsum(table[raw])])[base])
        if len(words) >= 3:
            grams = sequence(running(words.hashes()), np.arange(len(words) - 2), 3)
        for d in range(b - a):
            n = first[d + 1] - first[d]
            if n >= 4:
                own = grams[first[d] : first[d + 1] - 2]
                order = np.argsort(own, kind="stable")
                same = own[order[1:]] == own[order[:-1]]
                if same.any():
                    again = np.zeros(len(own), bool)
                    again[order[1:][same]] = again[order[:-1][same]] = True
                    cover = np.zeros(n, bool)
                    cover[:-2] |= again
                    cover[1:-1] |= again
                    cover[2:] |= again
                    out["n_repeat_words"][a + d] = int(cover.sum())
            text = texts[a + d]
            if text:
                lines = [x for x in text.split(b"\n") if x and not x.isspace()]
                out["lines"][a + d] = len(lines)
                out["n_dup_lines"][a + d] = len(lines) - len(set(lines))
    return out


def ratios(s: dict[str, np.ndarray]) -> np.ndarray:
    """Word length, and the shares of symbols, repeated lines and words in repeated windows."""
    chars, words, lines = np.maximum(s["word_chars"], 1), np.maximum(s["n_words"], 1), np.maximum(s["lines"], 1)
    return np.stack([s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words], axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def average_path(n):
    """The mean path length of an unsuccessful search in a tree of n values."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Scale:
    """Each ratio by its place among the good rows' quantiles (0 to 1), and beyond them by its distance in units of a quarter of
    their range (of ``LEAST_RANGE`` at least), up to 2."""

    KNOTS, LEAST_RANGE = 64, 1e-2

    def __init__(self, good: np.ndarray):
        self.knots = np.quantile(good, np.linspace(0, 1, self.KNOTS), axis=0)
        self.unit = np.maximum(self.knots[-1] - self.knots[0], self.LEAST_RANGE) / 4

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape)
        for c, (own, knots) in enumerate(zip(x.T, self.knots.T)):
            place = (np.searchsorted(knots, own) + np.searchsorted(knots, own, side="right")) / 2 / len(knots)
            out[:, c] = place + np.clip((own - knots[-1]) / self.unit[c], 0, 2) - np.clip((knots[0] - own) / self.unit[c], 0, 2)
        return out


class Forest:
    """Random trees in arrays: column, cut, left child (right is left + 1; -1: leaf) and the leaf's path length."""

    def __init__(self, x: np.ndarray, trees: int = 200, rows: int = 256, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        most = int(np.ceil(np.log2(max(len(x), 2))))
        column, cut, child, path = [0], [0.0], [-1], [0.0]
        todo = [(0, x, 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= most or len(rows) < 2 or not len(able):
                path[node] = depth + float(average_path(len(rows)))
                continue
            c = int(rng.choice(able))
            at = rng.uniform(low[c], high[c])
            column[node], cut[node], child[node] = c, at, len(column)
            left = rows[:, c] < at
            for part in (rows[left], rows[~left]):
                column.append(0)
                cut.append(0.0)
                child.append(-1)
                path.append(float(depth + 1))
                if len(part):
                    todo.append((len(column) - 1, part, depth + 1))
        return np.array(column), np.array(cut), np.array(child), np.array(path)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the usual one: higher is more anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, cut, child, path in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = child[node] >= 0
                if not inner.any():
                    break
                go = child[node] + (x[rows, column[node]] >= cut[node])
                node = np.where(inner, go, node)
            total += path[node]
        return 2.0 ** -(total / len(self.trees) / max(float(average_path(self.rows)), 1e-9))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000, bad_share: float = 0.03, false_rejects: float = 0.002) -> tuple[Scale, Forest, float] | None:
    """``bad_share``: rows labelled bad among those that fit the trees, by the good ones."""
    def measure(batches):
        for batch in batches:
            s = statistics(utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ratios(s).tolist(), pa.list_(pa.float64())), pa.array(base_failed(s))], ["y", "r", "x", "failed"])

    chosen = labelled_rows(docs, labels, {0: max_rows, 1: max_rows}, id_col=id_col, text_col=text_col, label_col=label_col)
    found = chosen.select("text", "y", "r").mapInArrow(frugal(measure), "y int, r long, x array<double>, failed boolean").filter("not failed").toPandas().sort_values("r")
    return calibrated(*(np.array(found[found["y"] == y]["x"].tolist()).reshape(-1, 4) for y in (1, 0)), bad_share, false_rejects)


def calibrated(good: np.ndarray, bad: np.ndarray, bad_share: float, false_rejects: float) -> tuple[Scale, Forest, float] | None:
    """The model from labelled rows' ratios: half of each kind fits scale and trees, half sets the threshold."""
    if len(good) < 20 or len(bad) < 3:
        return None
    few = max(1, round(bad_share * len(good) / 2))
    scale = Scale(good[::2])
    forest = Forest(np.concatenate([scale(good[::2]), scale(bad[::2][:few])]))
    calm, odd = np.sort(forest.scores(scale(good[1::2]))), forest.scores(scale(bad[1::2]))
    allowed = int(false_rejects * len(calm))
    low = calm[len(calm) - 1 - allowed]
    above = odd[odd > low]
    # Halfway between the good rows and the nearest bad row beyond them, for rows as good that the sample lacks.
    return scale, forest, float((low + above.min()) / 2 if len(above) else low)


def judge(docs: DataFrame, model: tuple[Scale, Forest, float] | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the rule statistics, base_failed, anomaly (the forest's score) and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            s = statistics(utf8(batch.column(1)))
            failed = base_failed(s)
            anomaly = model[1].scores(model[0](ratios(s))) if model else np.zeros(batch.num_rows)
            kept = ~failed & (anomaly <= model[2] if model else True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[n]) for n in names), pa.array(failed), pa.array(anomaly), pa.array(kept)], ["id", *names, "base_failed", "anomaly", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, anomaly double, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema).withColumnRenamed("id", id_col)

"""Language identification: interpolated Kneser-Ney character language models, one per language.

The counts of 4-grams of letters come from every training text, added up by Spark; the models are made of all counts on
the driver. Their number grows with the alphabets and with noise in the texts; none is left out, so a corpus with more
grams than the driver holds fails instead of getting another model. Each order is a sorted array of gram hashes
beside the log probabilities under all languages. A text gets the language with the least cross-entropy per letter; its score
is that language's share of the likelihood of the whole text, all languages being as likely beforehand.
Rejection: a text's cross-entropy, in standard deviations for its length, must not exceed what training texts show that a
model of the other half of them has not seen.

Results: null texts and texts without a letter are ``und``, score 0 and rejected; so is everything if there is nothing to
learn from. Null languages are not learned; repeated rows count as often as they occur; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._letters import letter_table, letters
from ._memory import frugal
from ._store import Scratch
from ._text import U8, mix

ORDER = 4
#: Share of a language's training texts that are within its rejection limit before the margin.
QUANTILE = 0.999
#: Characters handled at once.
CHUNK_CHARS = 400_000


def parts(texts: list[str | None]):
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and total + n > CHUNK_CHARS:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def grams(symbols: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each place from 3 on, 16 bits a symbol."""
    s = symbols.astype(U8)
    return s[:-3] << U8(48) | s[1:-2] << U8(32) | s[2:-1] << U8(16) | s[3:]


def ends(begin: np.ndarray, n: int) -> np.ndarray:
    """True for grams that stand within one text."""
    ok = np.ones(n - 3, bool)
    for b in begin[1:]:
        ok[b - 3 : b] = False
    return ok


def count_grams(batches):
    """Arrow function: lang, half, text -> lang, half, gram, count, as found in the task."""
    table = letter_table()
    held: dict[tuple, list] = {}
    size = 0

    def out():
        for (lang, half), found in held.items():
            values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in found]), len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(np.full(len(values), half, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "half", "gram", "n"])

    for batch in batches:
        texts, own_texts = batch.column(2).to_pylist(), {}
        for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), texts):
            own_texts.setdefault(key, []).append(text)
        for key, own in own_texts.items():
            for a, b in parts(own):
                symbols, begin = letters(own[a:b], table, ORDER - 1)
                found = np.unique(grams(symbols)[ends(begin, len(symbols))], return_counts=True)
                held.setdefault(key, []).append(found)
                size += len(found[0])
        if size > 3_000_000:
            yield from out()
            held, size = {}, 0
    yield from out()


class Level:
    """Sorted gram hashes of one order; ``logs``: log probability of the gram's last symbol after the others, one column a
    language; ``back``: log weight of the shorter context, by context hash."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, contexts: np.ndarray, back: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order].astype(np.float32)
        order = np.argsort(contexts)
        self.contexts, self.back = contexts[order], back[order].astype(np.float32)

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)


def _hash(code: np.ndarray, order: int) -> np.ndarray:
    return mix(code ^ U8(order << 60))


class Model:
    def __init__(self, langs: list[str], levels: dict[int, Level], floor: np.ndarray):
        self.langs, self.levels, self.floor = langs, levels, floor
        self.rules: dict = {}

    def logs(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log P of each gram's last symbol under every language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(code), len(self.langs)))
        level = self.levels[order]
        at = Level.find(level.keys, _hash(code, order))
        out = level.logs[np.maximum(at, 0)] if len(level.logs) else np.zeros((len(code), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            short = code[miss] & U8((1 << 16 * (order - 1)) - 1)
            below = self.logs(short, order - 1)
            context = Level.find(level.contexts, _hash(code[miss] >> U8(16), order))
            weight = np.where((context >= 0)[:, None], level.back[np.maximum(context, 0)], 0)
            out[miss] = below + weight
        return out

    def entropies(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the cross-entropy in nats per symbol under each language, and its number of symbols."""
        symbols, begin = letters(texts, table, ORDER - 1)
        logs = self.logs(grams(symbols))
        logs[~ends(begin, len(symbols))] = 0
        n = np.diff(np.append(begin, len(symbols))) - ORDER  # letters and spaces; the first gram ends 3 places on
        total = np.add.reduceat(logs, np.minimum(begin, len(logs) - 1), axis=0) if len(texts) else np.zeros((0, len(self.langs)))
        return -total / np.maximum(n + 1, 1)[:, None], n


def train(counts, langs: list[str]) -> Model:
    """counts: columns lang (its place in langs), gram, n."""
    lang = counts["lang"].to_numpy(np.int64)
    code, n = counts["gram"].to_numpy(np.int64).view(U8), counts["n"].to_numpy(np.float64)
    symbols = len(np.unique(code & U8(0xFFFF))) + 1
    tables = {}  # by order: grams, and their counts (continuation counts below the highest order) by language
    for order in range(ORDER, 0, -1):
        values, at = np.unique(code, return_inverse=True)
        table = np.zeros((len(values), len(langs)))
        np.add.at(table, (at, lang), n)
        tables[order] = values, table
        code, lang, n = np.repeat(values, (table > 0).sum(axis=1)), np.nonzero(table > 0)[1], None
        code = code & U8((1 << 16 * (order - 1)) - 1)
        n = np.ones(len(code))
    floor = np.full(len(langs), -np.log(symbols))
    model = Model(langs, {}, floor)
    for order in range(1, ORDER + 1):
        values, table = tables[order]
        once, twice = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.05, 0.95)
        contexts, at = np.unique(values >> U8(16), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, at, table)
        np.add.at(kinds, at, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, discount * kinds / total, 1.0)
            own = np.where(total[at] > 0, np.maximum(table - discount, 0) / total[at], 0)
        below = np.exp(model.logs(values & U8((1 << 16 * (order - 1)) - 1), order - 1))
        logs = np.log(own + back[at] * below)
        model.levels[order] = Level(_hash(values, order), logs, _hash(contexts, order), np.log(back))
    return model


def measure(model: Model):
    """Arrow function: lang, text -> the language's place, and the text's cross-entropy under it and number of symbols."""
    place = {lang: i for i, lang in enumerate(model.langs)}

    def run(batches):
        table = letter_table()
        for batch in batches:
            own, texts = np.array([place[x] for x in batch.column(0).to_pylist()], np.int32), batch.column(1).to_pylist()
            for a, b in parts(texts):
                e, n = model.entropies(texts[a:b], table)
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(own[a:b][some]), pa.array(e[np.arange(b - a), own[a:b]][some], pa.float64()), pa.array(n[some].astype(np.float64))], ["lang", "e", "n"])

    return run


def calibrate(model: Model, rows: DataFrame, margin: float, few: int = 5) -> None:
    """For each language the mean cross-entropy, how its variance falls with length, and the rejection limit, from all these texts
    of it; languages with fewer than ``few`` take those of all languages' texts together."""
    scratch = Scratch(rows.sparkSession, "langid")
    found = scratch.write(rows.select("lang", "text").mapInArrow(frugal(measure(model)), "lang int, e double, n double"), "measured")
    found = found.withColumn("lang", F.explode(F.array("lang", F.lit(-1))))  # -1: all languages
    weight = F.least("n", F.lit(1000.0))
    means = found.groupBy("lang").agg(F.count("*").alias("rows"), (F.sum(F.col("e") * weight) / F.sum(weight)).alias("mean"), F.percentile_approx("n", 0.5).alias("mid"))
    means = scratch.write(means, "means")
    off = found.join(F.broadcast(means), "lang").withColumn("d", F.col("e") - F.col("mean"))
    spread = off.groupBy("lang").agg(F.greatest(F.coalesce(F.avg(F.when(F.col("n") > F.col("mid"), F.col("d") * F.col("d"))), F.lit(0.0)), F.lit(1e-4)).alias("fixed"), F.greatest(F.avg(F.col("d") * F.col("d") * F.col("n")), F.lit(1e-3)).alias("per"))
    spread = scratch.write(spread, "spread")
    z = F.col("d") / F.sqrt(F.col("fixed") + F.col("per") / F.col("n"))
    limits = off.join(F.broadcast(spread), "lang").groupBy("lang").agg(F.percentile_approx(z, QUANTILE, 100_000).alias("z"))
    rules = {r["lang"]: r for r in means.join(spread, "lang").join(limits, "lang").collect()}
    scratch.drop("measured", "means", "spread")
    for i in range(len(model.langs)):
        r = rules.get(i)
        r = rules.get(-1) if r is None or r["rows"] < few else r
        model.rules[i] = (r["mean"], r["fixed"], r["per"], max(r["z"], 3.0) * margin) if r else (0.0, 0.0, 1.0, np.inf)


def half_of(text: Column) -> Column:
    """The half of the training texts that a text is in; equal texts are in one."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def predict(model: Model | None):
    """Arrow function: id, text -> id, lang_pred, score, rejected, cross_entropy."""

    def run(batches):
        table = letter_table()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score, rejected, entropy = [], [], [], []
            for a, b in parts(texts):
                if model is None:
                    e, n = np.zeros((b - a, 1)), np.zeros(b - a)
                else:
                    e, n = model.entropies(texts[a:b], table)
                for row, m in zip(e, n):
                    if m <= 0:
                        lang.append("und")
                        score.append(0.0)
                        rejected.append(True)
                        entropy.append(None)
                        continue
                    i = int(row.argmin())
                    mean, fixed, per, limit = model.rules[i]
                    lang.append(model.langs[i])
                    score.append(float(1 / np.exp(-(row - row[i]) * m).sum()))
                    rejected.append(bool((row[i] - mean) / np.sqrt(fixed + per / m) > limit))
                    entropy.append(float(row[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())], ["id", "lang_pred", "score", "rejected", "cross_entropy"])

    return run


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = 2.5) -> Model | None:
    """``margin``: how far beyond the training texts a text may be."""
    rows = docs.filter(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    # Languages as numbers: what comes to the driver is 20 bytes a gram.
    rows = rows.withColumn("half", half_of(F.col("text")))
    counts = rows.select("lang", "half", "text").mapInArrow(frugal(count_grams), "lang string, half int, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("half") == 0, F.col("n")).otherwise(0)).alias("n0"))
    counts = counts.select((F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("short").alias("lang"), "gram", "n", "n0")
    found = counts.toPandas()
    if not len(found):
        return None
    model = train(found, langs)
    seen = found[found["n0"] > 0]
    learned = sorted({langs[i] for i in seen["lang"]})
    if learned:  # the other half's texts, under a model of this half
        judge = train(seen.assign(n=seen["n0"]), langs)
        del found, seen
        judge.rules = model.rules
        calibrate(judge, rows.filter((F.col("half") == 1) & F.col("lang").isin(learned)), margin)
    else:
        model.rules |= {i: (0.0, 0.0, 1.0, np.inf) for i in range(len(langs))}
    return model


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id (any column, also a struct of a row's columns), lang_pred, score, rejected and cross_entropy."""
    schema = T.StructType().add("id", docs.schema[id_col].dataType)
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"), ("cross_entropy", "double")):
        schema = schema.add(name, kind)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(predict(model)), schema).withColumnRenamed("id", id_col)

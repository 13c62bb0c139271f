"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into bags of ``BAG_WORDS`` words; a bag is the average of the embeddings of its character n-grams (hashed
to buckets), so a misspelt or inflected word that training never saw shares most of its vectors with the words that it did.
Embeddings and softmax are trained together by minibatch Adagrad. Labels are of texts: all bags of a clean text are clean;
of a toxic text at first all bags are marked, then only those that the model itself finds most toxic. A text's score is that
of its most toxic bag. Vectors start at 0, and n-grams of fewer than ``LEAST`` training texts keep that, so what training
never saw adds nothing. ``FOLDS`` models are trained, each without one part of the sample, and averaged; each text's value
under the model that did not see it gives the scale: an isotonic fit of the labels, so that some wrong labels do not flatten it.

The model is fitted on a bounded sample of labelled rows: up to ``max_rows`` toxic ones and twice as many clean ones, in order
of a hash of the id, of each kind as many as have ``max_chars`` / 2 characters together (texts that would go beyond it are
passed over). All rows are scored over their whole texts. Results: null and wordless texts have the score of an empty bag;
without labelled rows of both kinds every score is 0; repeated rows are scored alike; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._letters import SPACE, letter_table, letters
from ._text import U8, mix
from ._memory import frugal
from ._store import labelled_rows
from .langid import parts

BUCKETS, DIM, BAG_WORDS, SIZES = 1 << 18, 8, 3, (3, 4, 5, 6)
#: Training texts that an n-gram must be in, models that are averaged, and bags of one step of training.
LEAST, FOLDS, BATCH = 4, 3, 512


def features(texts: list[str | None], table: np.ndarray):
    """Of each n-gram its bucket and bag; and the first bag of each text (every text has one or more)."""
    symbols, begin = letters(texts, table, 1)
    inside = symbols != SPACE
    word = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]]))  # number of the word at or before a place
    before = word[begin]
    last = np.append(begin[1:], len(symbols)) - 1
    count = word[last] - before
    bags = np.maximum(-(-count // BAG_WORDS), 1)
    first = np.cumsum(bags) - bags
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(begin, len(symbols))))
    code = symbols.astype(U8)
    buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    for n in SIZES:
        if len(symbols) < n:
            continue
        at = np.flatnonzero(gaps[n - 1 : len(symbols)] - gaps[1 : len(symbols) - n + 2] == 0)
        h = np.full(len(at), n, U8)
        for k in range(n):
            h = h * U8(0x100000001B3) + code[at + k]
        t = text[at]
        buckets.append((mix(h) >> U8(46)).astype(np.int32))
        owners.append(first[t] + np.maximum(word[at + 1] - before[t] - 1, 0) // BAG_WORDS)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    return bucket, owner, first, int(bags.sum())


class Toxicity:
    """``weight``: each bucket's part of a bag's log-odds. ``curve``: values of a text's most toxic bag, and their scores."""

    def __init__(self, weight: np.ndarray, bias: float, curve: tuple[np.ndarray, np.ndarray]):
        self.weight, self.bias, self.curve = weight.astype(np.float32), bias, curve

    def bags(self, bucket, owner, n: int) -> np.ndarray:
        total, count = np.bincount(owner, self.weight[bucket], n), np.bincount(owner, minlength=n)
        return total / np.maximum(count, 1) + self.bias

    def raw(self, texts, table) -> np.ndarray:
        out = []
        for a, b in parts(texts):
            bucket, owner, first, n = features(texts[a:b], table)
            out.append(np.maximum.reduceat(self.bags(bucket, owner, n), first))
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts, table) -> np.ndarray:
        return np.interp(self.raw(texts, table), *self.curve)


class Bags:
    """The bags of some texts: their n-grams that enough texts have, one bag after the other; of each bag how many these are,
    how many n-grams it has in all, and its text."""

    def __init__(self, texts: list[str], least: int):
        table = letter_table()
        seen = np.zeros(BUCKETS, np.int64)
        for a, b in parts(texts):
            bucket, of, first, n = features(texts[a:b], table)
            text = np.searchsorted(first, of, side="right") - 1
            seen += np.bincount(np.unique(text * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
        grams, held, size, owner = [], [], [], []
        for a, b in parts(texts):
            bucket, of, first, n = features(texts[a:b], table)
            order = np.argsort(of, kind="stable")
            order = order[seen[bucket[order]] >= least]
            grams.append(bucket[order])
            held.append(np.bincount(of[order], minlength=n))
            size.append(np.bincount(of, minlength=n))
            owner.append(a + np.searchsorted(first, np.arange(n), side="right") - 1)
        self.grams, self.held, self.size, self.owner = (np.concatenate(x) for x in (grams, held, size, owner))
        self.start = np.cumsum(self.held) - self.held

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some bags that have any, and where each bag's begin."""
        held = self.held[at]
        start = np.cumsum(held) - held
        return self.grams[np.repeat(self.start[at] - start, held) + np.arange(int(held.sum()))], start

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(len(self.held), bias)
        some = np.flatnonzero(self.held)
        for k in range(0, len(some), 100_000):
            at = some[k : k + 100_000]
            bucket, start = self.of(at)
            out[at] += np.add.reduceat(weight[bucket], start) / self.size[at]
        return out


def gradients(embed, soft, bucket, start, held, size, label, weight):
    """Of the weighted cross-entropy of some bags, by the softmax and by each n-gram's vector (for the bag's whole average)."""
    hidden = np.add.reduceat(embed[bucket], start, axis=0) / size[:, None]
    hidden = np.hstack([hidden, np.ones((len(size), 1))])
    logit = hidden @ soft
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(size)), label] -= 1
    p *= weight[:, None] / len(size)
    return hidden.T @ p, np.repeat((p @ soft[:-1].T) / size[:, None], held, axis=0)


def _steps(embed, soft, past, bags: Bags, chosen, label, weight, rng, rate: float) -> None:
    """One pass of minibatch Adagrad over some bags."""
    order = rng.permutation(len(chosen))
    for k in range(0, len(order), BATCH):
        part = order[k : k + BATCH]
        at = chosen[part]
        bucket, start = bags.of(at)
        g_soft, g_gram = gradients(embed, soft, bucket, start, bags.held[at], bags.size[at], label[part], weight[part])
        used, back = np.unique(bucket, return_inverse=True)
        g_embed = np.stack([np.bincount(back, g_gram[:, d], len(used)) for d in range(DIM)], axis=1)
        past[0][used] += (g_embed**2).sum(axis=1)
        past[1] += g_soft**2
        embed[used] -= (rate * g_embed / np.sqrt(past[0][used] + 1e-12)[:, None]).astype(np.float32)
        soft -= 0.3 * rate * g_soft / np.sqrt(past[1] + 1e-12)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps nearest to y in the order of x: of each step the mean x, and the mean y drawn a little to the middle."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        steps.append([a, b, 1])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [u + v for u, v in zip(steps[-1], last)]
    sums = np.array(steps)
    return sums[:, 0] / sums[:, 2], np.maximum.accumulate((sums[:, 1] + 0.5) / (sums[:, 2] + 1))


def train(texts: list[str], toxic: np.ndarray, *, seed: int = 7, passes: int = 4, rounds: int = 1, rate: float = 0.2) -> Toxicity | None:
    rng = np.random.default_rng(seed)
    if len(set(np.asarray(toxic).tolist())) < 2:
        return None
    bags = Bags(texts, min(LEAST, len(texts)))
    fold = rng.permutation(len(texts)) % FOLDS
    label = toxic[bags.owner].astype(np.int64)
    weight, bias, value = np.zeros(BUCKETS), 0.0, np.zeros(len(texts))
    for k in range(FOLDS):
        embed, soft = np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 0.5, (DIM + 1, 2))
        past = [np.zeros(BUCKETS), np.zeros_like(soft)]
        use = (fold[bags.owner] != k) & (bags.held > 0)

        def model():
            way = soft[:, 1] - soft[:, 0]
            return embed @ way[:-1].astype(np.float32), float(way[-1])

        def tops(z):
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, bags.owner, z)
            return top

        for turn in range(rounds + 1):
            own = use
            if turn:
                z = bags.logits(*model())
                own = use & ((label == 0) | (z >= tops(z)[bags.owner] - 1e-9) | (z > 1.0))
            at = np.flatnonzero(own)
            if not len(at):
                break
            share = label[at].mean()
            each = np.minimum(np.where(label[at] == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)), 8.0)
            for _ in range(passes):
                _steps(embed, soft, past, bags, at, label[at], each, rng, rate if not turn else rate / 2)
        w, b = model()
        value[fold == k] = tops(bags.logits(w, b))[fold == k]
        weight += w / FOLDS
        bias += b / FOLDS
    return Toxicity(weight, bias, isotonic(value, toxic.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 1200, max_chars: int = 12_000_000) -> Toxicity | None:
    """``max_rows``: toxic rows that training takes, beside twice as many clean ones; ``max_chars``: characters of all of these.
    Lengths come to the driver first, then the texts that were chosen by them."""
    rows = labelled_rows(docs.filter(training), labels, {0: 2 * max_rows, 1: max_rows}, id_col=id_col, text_col=text_col, label_col=label_col, max_chars=max_chars)
    found = rows.toPandas().sort_values(["y", "r", "h"], ignore_index=True).drop_duplicates(["h", "y"])
    return train(list(found["text"]), found["y"].to_numpy())


def score(docs: DataFrame, model: Toxicity | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    def run(batches):
        table = letter_table()
        for batch in batches:
            values = model.scores(batch.column(1).to_pylist(), table) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)

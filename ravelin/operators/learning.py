"""Learned grounding: labelled sentences, standardised features, class weights and logistic training by distributed Newton steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sentences(rows: DataFrame, *, sentences_col: str = "response_sentences", documents_col: str = "documents", unsupported_col: str = "unsupported_response_sentence_keys") -> DataFrame:
    """One row a sentence: the other columns, index, total, key, sentence, context (documents parted by blank lines) and label (1:
    its key is among the unsupported ones). Items of fewer than two elements (key, text) are left out."""
    keep = [c for c in rows.columns if c not in (sentences_col, documents_col, unsupported_col)]
    pairs = F.filter(F.coalesce(F.col(sentences_col), F.array()), lambda p: F.size(p) >= 2)
    none = F.array().cast("array<string>")
    base = rows.select(*keep, pairs.alias("pairs"), F.array_join(F.coalesce(F.col(documents_col), none), "\n\n").alias("context"), F.coalesce(F.col(unsupported_col), none).alias("bad"))
    out = base.select(*keep, "context", "bad", F.size("pairs").alias("total"), F.posexplode("pairs").alias("index", "pair"))
    key = F.element_at("pair", 1)
    return out.select(*keep, "index", "total", key.alias("key"), F.element_at("pair", 2).alias("sentence"), "context", F.array_contains("bad", key).cast("int").alias("label"))


def scales(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean and std: the population's, with 1 for a constant feature."""
    one = rows.agg(*(x for n in names for x in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))))
    stack = ", ".join(f"'{n}', m_{n}, s_{n}" for n in names)
    out = one.selectExpr(f"stack({len(names)}, {stack}) as (feature, mean, std)")
    return out.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: a positive row weighs as many times a negative one as there are more of these; the mean weight is 1."""
    one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label)), F.lit(0)).alias("p"))
    ratio = F.when(F.col("p") > 0, (F.col("n") - F.col("p")) / F.col("p")).otherwise(1.0)
    mean = (F.col("p") * ratio + F.col("n") - F.col("p")) / F.col("n")
    rows = one.select(F.explode(F.array(F.struct(F.lit(0).alias("label"), (F.col("n") - F.col("p")).alias("n"), (1 / mean).alias("weight")), F.struct(F.lit(1).alias("label"), F.col("p").alias("n"), (ratio / mean).alias("weight")))).alias("r"))
    return rows.select("r.*").filter("n > 0")


def gradient(rows: DataFrame, model: dict, names: list[str], l2: float, label: str = "label", weight: str = "weight") -> DataFrame:
    """feature, gradient (and 'intercept') of the mean weighted logistic loss with l2 w / n, at a model's coefficients."""
    z = {n: (F.col(n) - F.lit(float(m))) / F.lit(float(s) or 1.0) for n, m, s in zip(names, model["mean"], model["std"])}
    logit: Column = F.lit(float(model["intercept"]))
    for n, w in zip(names, model["coefficients"]):
        logit = logit + z[n] * F.lit(float(w))
    error = (1 / (1 + F.exp(-logit)) - F.col(label)) * F.col(weight)
    one = rows.select(error.alias("e"), *(z[n].alias(n) for n in names)).agg(F.count("*").alias("n"), F.avg("e").alias("g_intercept"), *(F.avg(F.col("e") * F.col(n)).alias(f"g_{n}") for n in names))
    parts = ", ".join(f"'{n}', g_{n} + {l2 * w}d / n" for n, w in zip(names, model["coefficients"]))
    return one.selectExpr(f"stack({len(names) + 1}, {parts}, 'intercept', g_intercept) as (feature, gradient)")


def train(rows: DataFrame, names: list[str], *, l2: float = 50.0, steps: int = 25, tolerance: float = 1e-9, label: str = "label") -> dict:
    """A model (mean, std, coefficients, intercept) at the minimum of the class-weighted logistic loss with l2 |w|^2 / 2n, the
    intercept free. Each Newton step is one pass: tasks add up gradient and Hessian of their rows, so only matrices of the
    number of features reach the driver. Rows without a label are an error; a corpus of one class gives coefficients 0."""
    found = {r["feature"]: r for r in scales(rows, names).collect()}
    mean, std = (np.array([found[n][c] for n in names], float) for c in ("mean", "std"))
    weights = {r["label"]: r["weight"] for r in class_weights(rows, label).collect()}
    d = len(names) + 1

    def sums(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, d + 2))
            for batch in batches:
                x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns[:-1]], axis=1)
                x = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
                y = np.asarray(batch.columns[-1].to_numpy(zero_copy_only=False), float)
                each = np.array([weights.get(0, 1.0), weights.get(1, 1.0)])[y.astype(int)]
                p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
                total[:, 0] += x.T @ (each * (p - y))
                total[0, 1] += len(y)
                total[:, 2:] += (x * (each * p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        return run

    given = rows.select(*(F.col(n).cast("double") for n in names), F.col(label).cast("double")).persist()
    w = np.zeros(d)
    try:
        for _ in range(steps if len(weights) == 2 else 0):
            total = sum(np.array(r["sums"]).reshape(d, d + 2) for r in given.mapInArrow(sums(w), "sums array<double>").toLocalIterator())
            n = total[0, 1]
            ridge = np.append(np.full(d - 1, l2), 0.0) / n
            step = np.linalg.solve(total[:, 2:] / n + np.diag(ridge + 1e-12), total[:, 0] / n + ridge * w)
            w = w - step
            if np.abs(step).max() < tolerance:
                break
    finally:
        given.unpersist()
    return {"mean": mean.tolist(), "std": std.tolist(), "coefficients": w[:-1].tolist(), "intercept": float(w[-1])}

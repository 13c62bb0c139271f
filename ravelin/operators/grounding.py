"""Sentence grounding, citation validation, answer assembly and the status of an answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import capitalised, citation_markers, content_tokens, first_sentences, held, is_idk, numerals, share_held, split_sentences, without_markers
from ..sources.shared import small_batches

THRESHOLD = 0.7
#: Statuses of answers that may be cached, and the names of the features.
CACHEABLE = ("ok", "ok_partial_rejected", "ok_no_answer", "no_results", "degraded_no_llm")
FEATURES = ["coverage", "bigram_coverage", "longest_shared_run", "numeral_coverage", "has_numeral", "long_token_coverage", "capitalised_coverage", "missing_count", "token_count", "position", "is_first", "context_size"]


def pairs(tokens: Column) -> Column:
    """Neighbouring tokens, joined by a space."""
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))  # a type, since the module is imported before there is a session
def lacking(lists: pa.Array, pool: pa.Array) -> pa.Array:
    """Of each list of a row's lists the distinct items, in order, that the row's pool lacks; null where the pool is null. All items of a
    batch are compared at once by sorted (row, item) numbers, so the cost grows with the items, not with lists times pool."""
    inner = pc.list_flatten(lists)
    if not len(inner):  # an empty list of lists comes without the offsets that its own lists would need
        return pa.array([None if x is None else [] for x in lists.to_pylist()], lists.type)
    row = pc.list_parent_indices(lists).to_numpy()
    items, at = pc.list_flatten(inner), pc.list_parent_indices(inner).to_numpy()
    given, given_row = pc.list_flatten(pool), pc.list_parent_indices(pool).to_numpy()
    coded = pa.concat_arrays([items, given]).dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    own = code[: len(items)]
    lost = np.flatnonzero(~np.isin(row[at] * size + own, given_row * size + code[len(items) :]))
    lost = lost[np.sort(np.unique(at[lost] * size + own[lost], return_index=True)[1])]
    stops = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    unknown = np.asarray(pool.is_null())[row] if len(row) else np.zeros(0, bool)
    lost = lost[~unknown[at[lost]]]
    found = pa.ListArray.from_arrays(stops(np.bincount(at[lost], minlength=len(inner))), items.take(pa.array(lost)), mask=pa.array(unknown))
    return pa.ListArray.from_arrays(stops(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), found, mask=lists.is_null())


def sentences(answers: DataFrame, answer_col: str, context_col: str, parts: bool = False) -> DataFrame:
    """One row a sentence: index, sentence, total, its content tokens, those that the context lacks (``missing``) and ``context_size``, the
    number of the context's distinct tokens; with ``parts`` also pairs of tokens, numerals and capitalised words, and which of them the
    context lacks. The sentences of an answer meet its context together (``lacking``), and only small rows come out of the explosion: a
    long context is neither made, hashed nor copied for each sentence. They come to Python in small batches."""
    small_batches(answers.sparkSession)
    keep = [c for c in answers.columns if c not in (answer_col, context_col)]
    pools = {"tokens": "context"} | ({"bigrams": "context_bigrams", "nums": "context_nums", "caps": "context"} if parts else {})
    lost = {"tokens": "missing", "bigrams": "bigrams lost", "nums": "nums lost", "caps": "caps lost"}
    told = F.transform(split_sentences(F.col(answer_col)), lambda x: F.struct(x.alias("sentence"), content_tokens(x).alias("tokens")))
    rows = answers.select(*keep, told.alias("s"), content_tokens(F.col(context_col)).alias("context_list"), F.col(context_col).alias("context_text"))
    if parts:
        more = lambda x: F.struct(x.sentence.alias("sentence"), x.tokens.alias("tokens"), pairs(x.tokens).alias("bigrams"), numerals(x.sentence).alias("nums"), capitalised(x.sentence).alias("caps"))
        rows = rows.select(*keep, F.transform("s", more).alias("s"), "context_list", F.array_distinct(pairs(F.col("context_list"))).alias("context_bigrams"), numerals(F.col("context_text")).alias("context_nums"))
    rows = rows.withColumn("context", F.array_distinct("context_list"))
    told = [lacking(F.col("s")[name], F.col(pool)).alias(f"{name} lacking") for name, pool in pools.items()]
    rows = rows.select(*keep, "s", F.size("context").alias("context_size"), *told)
    met = lambda x, i: F.struct(x.sentence.alias("sentence"), *(x[name].alias(name) for name in pools), *(F.get(f"{name} lacking", i).alias(lost[name]) for name in pools))
    rows = rows.select(*keep, F.size("s").alias("total"), "context_size", F.posexplode(F.transform("s", met)).alias("index", "x"))
    return rows.select(*keep, "index", "total", "context_size", "x.*")


def support(rows: DataFrame, *by: str, threshold: float = THRESHOLD) -> DataFrame:
    """Sentences and tokens without support; sentences without content tokens do not count."""
    rows = rows.withColumn("c", share_held(F.col("tokens"), F.col("missing"))).withColumn("lost", F.size("tokens") - held(F.col("tokens"), F.col("missing")))
    rows = rows.filter(F.size("tokens") > 0)
    return rows.groupBy(*by).agg(F.sum((F.col("c") < threshold).cast("long")).alias("unsupported_sentences"), F.count("*").alias("sentences"), F.sum("lost").alias("unsupported_tokens"), F.sum(F.size("tokens")).alias("tokens"))


def verdicts(answers: DataFrame, answer_col: str, chunks_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row a sentence with content: cited chunks (1-based), verdict and coverage. chunks: array of texts, tokenised once an answer."""
    keep = [c for c in answers.columns if c not in (answer_col, chunks_col)]
    rows = answers.select(*keep, F.transform(chunks_col, lambda c: F.array_distinct(content_tokens(c))).alias("chunks"), split_sentences(F.col(answer_col)).alias("s"))
    rows = rows.select(*keep, "chunks", F.array_distinct(F.flatten("chunks")).alias("pool"), "s")
    rows = rows.select(*keep, "chunks", "pool", F.posexplode("s").alias("index", "sentence"))
    rows = rows.withColumn("cited", citation_markers(F.col("sentence"))).withColumn("tokens", content_tokens(without_markers(F.col("sentence")))).filter(F.size("tokens") > 0)
    bad = F.exists("cited", lambda m: (m < 1) | (m > F.size("chunks")))
    valid = F.filter("cited", lambda m: (m >= 1) & (m <= F.size("chunks")))
    context = F.when(F.size("cited") > 0, F.flatten(F.transform(valid, lambda m: F.element_at("chunks", m)))).otherwise(F.col("pool"))
    rows = rows.withColumn("bad", bad).withColumn("missing", F.array_except("tokens", context))
    rows = rows.withColumn("c", share_held(F.col("tokens"), F.col("missing")))
    verdict = F.when(F.col("bad"), "invalid_citation").when(F.col("c") < threshold, "unsupported").when(F.size("cited") > 0, "supported").otherwise("supported_uncited")
    return rows.select(*keep, "index", "sentence", "cited", verdict.alias("verdict"), F.when(F.col("bad"), 0.0).otherwise(F.round("c", 4)).alias("coverage"))


def assemble(judged: DataFrame, *by: str) -> DataFrame:
    """The kept sentences joined in order, citations in order of first use, and counts."""
    kept = F.col("verdict").isin("supported", "supported_uncited")
    held = F.array_sort(F.collect_list(F.when(kept, F.struct("index", "sentence", "cited"))))
    out = judged.groupBy(*by).agg(held.alias("k"), F.sum(kept.cast("long")).alias("kept"), F.sum((~kept).cast("long")).alias("rejected"))
    return out.select(*by, F.array_join("k.sentence", " ").alias("answer"), F.array_join(F.transform(F.array_distinct(F.flatten("k.cited")), lambda x: x.cast("string")), ",").alias("citations"), "kept", "rejected")


def context_cut(chunks: Column, most: int = 5) -> Column:
    """The chunks that go into a prompt: the best ``most``, in order."""
    return F.slice(chunks, 1, most)


def low_signal(query: Column, chunks: Column) -> Column:
    """The query has content and shares none of it with any chunk."""
    asked = content_tokens(query)
    return (F.size(asked) > 0) & ~F.exists(chunks, lambda c: F.arrays_overlap(asked, content_tokens(c)))


#: What an outcome of the model call makes of an answer.
FAILURES = {"quota_429": "degraded_quota", "throttled": "degraded_quota_throttled", "timeout": "degraded_timeout", "server_error": "degraded_llm_error", "malformed": "degraded_llm_malformed", "config": "degraded_llm_config", "auth": "degraded_llm_auth"}


def failure_status(outcome: Column) -> Column:
    out = F.when(outcome == "none", "degraded_no_llm")
    for name, status in FAILURES.items():
        out = out.when(outcome == name, status)
    return out


def answer_status(retrieved: Column, weak: Column, primary: Column, fallback: Column, text: Column, kept: Column, rejected: Column) -> Column:
    """The states of an answer. Without a first provider there is no second one; if both fail, the first one's failure stands."""
    answered = (primary == "ok") | (fallback == "ok")
    return (
        F.when(retrieved == 0, "no_results")
        .when(weak, "ok_no_answer")
        .when(primary == "none", "degraded_no_llm")
        .when(~F.coalesce(answered, F.lit(False)), failure_status(primary))
        .when(is_idk(text), "ok_no_answer")
        .when(kept == 0, "degraded_citation_rejected")
        .when(rejected > 0, "ok_partial_rejected")
        .otherwise("ok")
    )


def http_outcome(code: Column, body: Column | None = None, failure: Column | None = None) -> Column:
    """The outcome of a model call: by the failure before an answer ('timeout' or 'network'), the HTTP status, and the text that the
    body holds (null or blank: malformed)."""
    out = F.when(code == 429, "quota_429").when(code.isin(401, 403), "auth").when(code >= 500, "server_error").when(code != 200, "config")
    if failure is not None:
        out = F.when(failure == "timeout", "timeout").when(failure == "network", "server_error").otherwise(out)
    if body is not None:
        out = F.coalesce(out, F.when(F.coalesce(F.trim(body), F.lit("")) == "", "malformed"))
    return F.coalesce(out, F.lit("ok"))


def extractive(text: Column) -> Column:
    return F.coalesce(F.nullif(first_sentences(text), F.lit("")), F.lit("No answer found."))


def features(rows: DataFrame) -> DataFrame:
    """The twelve features of ``sentences`` rows with their parts, in the order of FEATURES."""
    t, n, missing = F.col("tokens"), F.size("tokens"), F.col("missing")
    rows = rows.withColumn("long", F.filter(t, lambda x: F.length(x) >= 8)).withColumnRenamed("context_size", "size of context")
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    step = lambda s, x: F.when(~F.array_contains(missing, x), F.struct((s.run + 1).alias("run"), F.greatest(s.best, s.run + 1).alias("best"))).otherwise(F.struct(F.lit(0).alias("run"), s.best.alias("best")))
    of = lambda c: F.when(n == 0, 1.0).otherwise(share_held(F.col(c), F.col(f"{c} lost")))
    values = {
        "coverage": share_held(t, missing),
        "bigram_coverage": of("bigrams"),
        "longest_shared_run": F.when(n == 0, 1.0).otherwise(F.aggregate(t, start, step, lambda s: s.best) / n),
        "numeral_coverage": of("nums"),
        "has_numeral": F.when((n == 0) | (F.size("nums") == 0), 0.0).otherwise(1.0),
        "long_token_coverage": F.when(n == 0, 1.0).otherwise(share_held(F.col("long"), missing)),
        "capitalised_coverage": of("caps"),
        "missing_count": F.least((n - held(t, missing)) / 10, F.lit(1.0)),
        "token_count": F.least(n / 40, F.lit(1.0)),
        "position": F.col("index") / F.greatest(F.col("total"), F.lit(1)),
        "is_first": (F.col("index") == 0).cast("double"),
        "context_size": F.least(F.col("size of context") / 1000, F.lit(1.0)),
    }
    return rows.withColumns(values).drop("long", "size of context", *(x for c in ("bigrams", "nums", "caps") for x in (c, f"{c} lost")))


def logistic(model: dict, names: list[str] = FEATURES) -> Column:
    """Probability under a model of mean, std, coefficients, intercept; the logit is held within 60."""
    z = F.lit(float(model["intercept"]))
    for name, mean, std, weight in zip(names, model["mean"], model["std"], model["coefficients"]):
        z = z + (F.col(name) - F.lit(float(mean))) / F.lit(float(std) or 1.0) * F.lit(float(weight))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))

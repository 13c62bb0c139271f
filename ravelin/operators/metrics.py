"""Retrieval and classifier metrics, descriptive statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .quantiles import at_ranks, quantiles


def safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def retrieval_quality(queries: DataFrame, ranked: DataFrame, gold: DataFrame, cut: int = 10) -> DataFrame:
    """One row: queries, p_at_1, mrr. queries: qid; ranked: qid, id, rank; gold: qid, id. A query without results counts 0."""
    best = ranked.filter(F.col("rank") <= cut).join(gold, ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r"))
    rows = queries.select("qid").join(best, "qid", "left")
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce((F.col("r") == 1).cast("int"), F.lit(0))), 4).alias("p_at_1"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 4).alias("mrr"))


def unknown_gold(gold: DataFrame, known: DataFrame) -> DataFrame:
    return gold.join(known, "id", "left_anti")


def auc(rows: DataFrame, *by: str) -> DataFrame:
    """Mann-Whitney AUC with ties at one half; null if a class is absent. rows: score, actual (0/1). Equal scores are added
    up before they are ordered."""
    ties = rows.groupBy(*by, "score").agg(F.sum("actual").alias("p"), F.sum(1 - F.col("actual")).alias("n"))
    before = W.partitionBy(*by).orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    ties = ties.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = ties.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"))
    return out.select(*by, "positives", "negatives", F.round(F.col("wins") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0)), 4).alias("auc"))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn and rates; 0/0 is 0. rows: predicted, actual (boolean)."""
    count = lambda p, a: F.count_if((F.col("predicted") == p) & (F.col("actual") == a))
    out = rows.groupBy(*by).agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(*by, "tp", "fp", "fn", "tn", F.round(safe(tp, tp + fp), 4).alias("precision"), F.round(safe(tp, tp + fn), 4).alias("recall"), F.round(safe(2 * tp, 2 * tp + fp + fn), 4).alias("f1"), F.round(safe(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"))


def best_f1(rows: DataFrame, *by: str, digits: int | None = None, inclusive: bool = False) -> DataFrame:
    """The cut with the best F1 (rounded to 4), the smallest of equals. Predicted: score > cut, with -1 a cut too; inclusive:
    score >= cut over the distinct scores (rounded to ``digits``). rows: score, actual (0/1)."""
    cut = F.round("score", digits) if digits is not None else F.col("score")
    ties = rows.groupBy(*by, cut.alias("cut")).agg(F.sum("actual").alias("p"), F.count("*").alias("n"))
    if not inclusive:
        least = rows.groupBy(*by).agg(F.lit(-1.0).alias("cut"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
        ties = ties.unionByName(least).groupBy(*by, "cut").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = W.partitionBy(*by).orderBy(F.desc("cut")).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    total = F.sum("p").over(W.partitionBy(*by))
    swept = ties.select(*by, "cut", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("flagged"), total.alias("all"))
    swept = swept.withColumn("f1", F.round(safe(2 * F.col("tp"), F.col("flagged") + F.col("all")), 4))
    return swept.groupBy(*by).agg(F.max_by(F.struct("cut", "f1"), F.struct("f1", -F.col("cut"))).alias("b")).select(*by, F.round("b.cut", 4).alias("threshold"), "b.f1")


def percentile_rank(rows: DataFrame, value: str, p: int, *by: str) -> DataFrame:
    """The value at place max(1, p/100 n rounded half to even)."""
    place = F.greatest(F.lit(1), F.bround(F.col("n") * p / 100).cast("long")) - 1
    return at_ranks(rows, value, {f"p{p}": place}, *by).drop("n")


def load_summary(requests: DataFrame, by: str, statuses: list[str], shed: str) -> DataFrame:
    """Per level: requests, their number by status (a column for each name), the share shed, requests a second between the first and
    the last, quantiles and mean of the value. requests: by, status, us, value."""
    counts = requests.groupBy(by).agg(
        F.count("*").alias("requests"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses), F.round(F.avg((F.col("status") == shed).cast("int")), 6).alias("shed_rate"),
        F.round(F.count("*") * 1_000_000 / F.nullif(F.max("us") - F.min("us"), F.lit(0)), 9).alias("rps"), F.round(F.avg("value"), 6).alias("mean"))
    found = quantiles(requests, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by).drop("n").withColumnRenamed(by, "of")
    joined = counts.join(found, F.col(by).eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumns({q: F.round(q, 6) for q in ("p50", "p95", "p99")})


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, current, baseline, delta, worse. Both: metric, value, higher_is_better."""
    rows = current.select("metric", F.col("value").alias("current"), "higher_is_better").join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    delta = F.round(F.col("current") - F.col("baseline"), 4)
    return rows.select("metric", "current", "baseline", delta.alias("delta"), F.when(F.col("higher_is_better"), delta < 0).otherwise(delta > 0).alias("worse"))


def describe(rows: DataFrame, *columns: str) -> DataFrame:
    """One row a column: count, mean, std (sample), min, quartiles (linear), max."""
    stacked = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = written(rows.selectExpr(f"stack({len(columns)}, {stacked}) as (column_name, v)"), "described")  # read several times
    basic = long.groupBy("column_name").agg(F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    found = quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "column_name").drop("n")
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return basic.join(found, "column_name", "left").select("column_name", *(F.round(n, 6).alias(n) for n in names))


def present(rows: DataFrame, column: str) -> Column:
    """Neither null nor NaN."""
    here = F.col(f"`{column}`").isNotNull()
    kind = rows.schema[column].dataType
    return here & ~F.isnan(F.col(f"`{column}`")) if isinstance(kind, (T.DoubleType, T.FloatType)) else here


def completeness(rows: DataFrame) -> DataFrame:
    """One row a column: its type, the rows that have a value there (NaN is none), those that lack it, and the share of those that have
    one in percent (null for an empty table). One pass, whatever the number of columns."""
    counted = rows.agg(F.count("*").alias("n"), F.array(*(F.count_if(present(rows, c)) for c in rows.columns)).alias("had"))
    told = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type")) for f in rows.schema))
    long = counted.select("n", F.explode(F.arrays_zip(told.alias("told"), F.col("had"))).alias("x")).select("x.told.*", F.col("x.had").alias("present"), "n")
    return long.select("column_name", "type", "present", (F.col("n") - F.col("present")).alias("missing"), F.round(100 * F.col("present") / F.nullif("n", F.lit(0)), 6).alias("percent"))


def table_shape(rows: DataFrame) -> DataFrame:
    """One row a column type: columns of that type, values missing in them, and of the whole table rows, columns and duplicated rows (rows
    equal to another in every column, all but one of each; null equals null). Rows meet by a 256-bit digest of their JSON form."""
    whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}), 256)
    all_rows = rows.select(whole.alias("h")).groupBy("h").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicated"))
    types = completeness(rows).groupBy("type").agg(F.count("*").alias("columns"), F.sum("missing").alias("missing"))
    return types.join(F.broadcast(all_rows)).withColumn("all_columns", F.lit(len(rows.columns)))  # one row


def histogram(rows: DataFrame, value: str, bins: int = 28) -> DataFrame:
    """Bins of equal width from the least to the greatest value (of one value only: half a unit to both sides): bin, low, high, n, empty
    bins, too; the last one holds its upper end. Nulls, NaN and infinite values are not counted; without values there is no bin."""
    v = F.col("v")
    held = written(rows.select(F.col(f"`{value}`").cast("double").alias("v")).filter(F.abs("v") < float("inf")), "binned")  # read twice
    ends = held.agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    of = F.least(F.floor((v - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
    counts = held.join(F.broadcast(ends)).groupBy(of.alias("bin")).agg(F.count("*").alias("n"))  # ends: one row
    edge = lambda i: F.round(F.col("a") + (F.col("b") - F.col("a")) * i / bins, 6)
    all_bins = ends.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def boxes(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """What a box plot shows of each group: n, quartiles (linear), whiskers (the least and greatest value within 1.5 interquartile ranges
    of the box, or the box's end where there is none beyond it) and the number of values outside them. Quartiles are exact; nulls and NaN are not counted."""
    long = written(rows.select(*by, F.col(f"`{value}`").cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")), "boxes")  # read several times
    found = quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, *by).select(*(F.col(c).alias(f"of {c}") for c in by), "q25", "q50", "q75")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("v") >= F.col("q25") - reach) & (F.col("v") <= F.col("q75") + reach)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"of {c}")) for c in by), F.lit(True))
    low, high = F.least(F.min(F.when(inside, F.col("v"))), F.col("q25")), F.greatest(F.max(F.when(inside, F.col("v"))), F.col("q75"))
    out = long.join(found, same).groupBy(*by, "q25", "q50", "q75").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"), F.count_if(~inside).alias("outside"))
    return out.select(*by, "n", *(F.round(c, 6).alias(c) for c in ("low", "q25", "q50", "q75", "high")), "outside")


def correlations(rows: DataFrame, *columns: str) -> DataFrame:
    """All pairs of columns with Pearson's r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs)) + ") as (a, b, r)")


def methods(sentences: DataFrame, baselines: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """Long rows (example, domain, method, predicted, score, actual) by which methods are compared: of each example whether a
    sentence is flagged, and the score of its worst sentence. sentences: example, domain (null: '?'), adherence (false: the
    example is positive; null is not), coverage (null: no content, passed over; the example then scores 0) and learned (the
    learned probability; null for examples without sentences, which that method passes over). baselines: example, method,
    value; their score is 1 - value, and nothing is predicted."""
    one = sentences.groupBy("example").agg(F.coalesce(F.first("domain"), F.lit("?")).alias("domain"), F.coalesce(~F.first("adherence"), F.lit(False)).alias("actual"), F.min("coverage").alias("least"), F.max("learned").alias("most"), F.max("learned_flag").alias("flag"))
    worst = 1 - F.coalesce("least", F.lit(1.0))
    lexical = one.select("example", "domain", F.lit("lexical").alias("method"), (F.coalesce("least", F.lit(1.0)) < threshold).alias("predicted"), worst.alias("score"), "actual")
    learned = one.filter("most is not null").select("example", "domain", F.lit("learned").alias("method"), F.col("flag").alias("predicted"), F.col("most").alias("score"), "actual")
    out = lexical.unionByName(learned)
    if baselines is not None:
        given = baselines.filter("value is not null").join(one.select("example", "domain", "actual"), "example")
        out = out.unionByName(given.select("example", "domain", "method", F.lit(None).cast("boolean").alias("predicted"), (1 - F.col("value")).alias("score"), "actual"))
    return out


def by_method(rows: DataFrame) -> DataFrame:
    """AUC, best F1 and its threshold, and the confusion at the methods' own predictions, of each method by domain and over all
    ('ALL'). rows: as ``methods`` gives them."""
    both = rows.withColumn("domain", F.explode(F.array(F.col("domain"), F.lit("ALL"))))
    keys = ["method", "domain"]
    numbered = both.select(*keys, "score", F.col("actual").cast("int").alias("actual"))
    counts = confusion(both.filter("predicted is not null"), *keys).select(*keys, "precision", "recall", "f1")
    best = best_f1(numbered, *keys).select(*keys, "threshold", F.col("f1").alias("best_f1"))
    return both.groupBy(*keys).agg(F.count("*").alias("examples")).join(auc(numbered, *keys).select(*keys, "auc"), keys).join(best, keys).join(counts, keys, "left")


#: What is counted, by which label.
INSTRUMENTS = {"errors": "type", "cache_requests": "result", "citation_sentences": "verdict", "citation_rejected_answers": None, "quota_throttled": "reason", "llm_requests": "outcome", "llm_fallback": "outcome", "rerank_status": "status", "admission_rejected": None}


def instruments(events: DataFrame) -> DataFrame:
    """Counters (metric, label, value) of events (metric, label); those that the list does not have, or whose label is missing where
    one is asked for, are left out."""
    named = F.create_map(*(x for k, v in INSTRUMENTS.items() for x in (F.lit(k), F.lit(v is not None))))
    rows = events.withColumn("labelled", F.try_element_at(named, F.col("metric"))).filter(F.col("labelled").isNotNull() & (~F.col("labelled") | F.col("label").isNotNull()))
    return rows.groupBy("metric", F.when(F.col("labelled"), F.col("label")).otherwise("").alias("label")).agg(F.count("*").alias("value"))

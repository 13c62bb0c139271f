"""Reciprocal-rank fusion, budgeted reranking and the merge of reranked and fused candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: list[DataFrame], top_k: int | None = None, k: int = RRF_K) -> DataFrame:
    """lists: qid, id, rank. Score sum 1/(k + rank); ties by best rank, then by first list and place in it. An id twice in one list
    of a query fails the job."""
    if k <= 0 or (top_k is not None and top_k <= 0):
        raise ValueError("k and top_k must be positive")
    every = None
    for i, one in enumerate(lists):
        # As a struct, so that the lists' own partitionings are not taken for the union's.
        part = one.select(F.struct("qid", "id").alias("k"), "rank", F.lit(i).alias("list"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("k").agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"), F.min(F.struct("list", "rank")).alias("arrival"), F.count("*").alias("n"), F.bit_count(F.bit_or(F.expr("shiftleft(1, list)"))).alias("in_lists"))
    fused = fused.select("k.qid", "k.id", "score", "best", "arrival", "n", "in_lists")
    fused = fused.withColumn("score", F.when(F.col("n") == F.col("in_lists"), F.col("score")).otherwise(F.raise_error(F.lit("an id occurs twice in a ranked list")).cast("double")))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "best", "arrival")
    out = fused.select("qid", "id", "score", F.row_number().over(order).alias("rank"))
    return out.filter(F.col("rank") <= top_k) if top_k else out


def check_lists(lists: list[DataFrame]) -> None:
    """An id twice in one list of a query is an error."""
    for one in lists:
        if not one.groupBy("qid", "id").count().filter("count > 1").isEmpty():
            raise ValueError("an id occurs twice in a ranked list")


def rerank(fused: DataFrame, *, depth: int = 20, final: int = 10, batch: int = 5, cost: float | None = None, budget: float | None = None) -> DataFrame:
    """fused: qid, id, rank, rerank_score. Micro-batches of candidates run while cost x candidates so far stays below the
    budget (None: no limit; the cost is an input, not the clock). Scored candidates come first by score, the others after
    them in fused order; returns qid, id, position, source, status."""
    if depth < 0 or 0 < depth < final:
        raise ValueError("depth must be 0 or at least final")
    size = F.least(F.count("*").over(W.partitionBy("qid")), F.lit(depth))
    rows = fused.withColumn("depth", size)
    within = F.col("rank") <= F.col("depth")
    through = F.least((F.floor((F.col("rank") - 1) / batch) + 1) * batch, F.col("depth"))
    runs = within if budget is None else within & (F.lit(float(cost or 0.0)) * through < F.lit(float(budget))) & F.lit(budget > 0)
    rows = rows.withColumn("scored", runs)
    total = F.sum(F.col("scored").cast("int")).over(W.partitionBy("qid"))
    status = F.when(F.lit(depth) == 0, "disabled").when(total == 0, "skipped_budget").when(total < F.col("depth"), "partial").otherwise("full")
    order = W.partitionBy("qid").orderBy(F.desc("scored"), F.when(F.col("scored"), F.col("rerank_score")).desc_nulls_last(), "rank")
    out = rows.select("qid", "id", F.row_number().over(order).alias("position"), F.when(F.col("scored"), "rerank").otherwise("rrf").alias("source"), status.alias("status"))
    return out.filter(F.col("position") <= final)


def by_relevance(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """Candidates (qid, id, rank, rerank_score) of each query by relevance alone, without budget or fallback: greatest score first, ties in
    order of rank; an unknown score (null or NaN) comes last. Returns qid, id, position, rerank_score."""
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")
    order = W.partitionBy("qid").orderBy(F.nanvl("rerank_score", F.lit(None).cast("double")).desc_nulls_last(), "rank")
    out = scored.select("qid", "id", F.row_number().over(order).alias("position"), "rerank_score")
    return out.filter(F.col("position") <= top_k) if top_k else out


def with_empty(queries: DataFrame, reranked: DataFrame) -> DataFrame:
    """With one row (position 0) of status 'no_candidates' for each query (qid) that has no candidate."""
    rows = queries.select("qid").distinct().join(reranked, "qid", "left")
    return rows.select("qid", "id", F.coalesce("position", F.lit(0)).alias("position"), "source", F.coalesce("status", F.lit("no_candidates")).alias("status"))


def union_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index rebuild: an id that is there keeps its place and takes the new text; new ids follow in their order. Chunks of a
    document that got shorter stay. Columns: id, text, ord."""
    kept = old.join(new.select("id", F.col("text").alias("fresh")), "id", "left").select("id", F.coalesce("fresh", "text").alias("text"), "ord")
    last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    added = new.join(old.select("id"), "id", "left_anti").crossJoin(F.broadcast(last)).select("id", "text", (F.col("last") + 1 + F.col("ord")).alias("ord"))
    return kept.unionByName(added)

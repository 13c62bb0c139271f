"""The whole ways from a query to ranked chunks and to an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens, first_sentences, prompt, tokenize
from ..sources.shared import written
from . import dense, fusion, grounding, lexical

#: Candidates that each search hands to the fusion, that are reranked, and that an answer's prompt takes.
CANDIDATES, DEPTH, FINAL, CONTEXT = 30, 20, 10, 5


class Reranker(Protocol):
    """Relevance of passages to a query, a few at a time."""

    def scores(self, query: str, passages: list[str]) -> list[float]: ...


class Outcome(RuntimeError):
    """A model call that failed: one of the outcomes of ``grounding.FAILURES``, and when to try again."""

    def __init__(self, name: str, retry_after: float | None = None):
        super().__init__(name)
        self.name, self.retry_after = name, retry_after


def skeleton(queries: DataFrame, docs: DataFrame, top_k: int = FINAL) -> tuple[DataFrame, DataFrame]:
    """BM25 hits (qid, id, score, rank), and an answer a query of the first two sentences of its best hit."""
    hits = lexical.bm25(queries, docs, top_k)
    best = hits.filter("rank = 1").join(docs, F.col("id") == F.col("doc_id")).select("qid", "id", first_sentences(F.col("text"), keep_blank=True).alias("answer"))
    return hits, best


def fused(queries: DataFrame, docs: DataFrame, top_k: int | None = None) -> DataFrame:
    """BM25 and hashed-vector candidates of each query, fused by rank."""
    asked = dense.hashing_vectors(queries, id_col="qid", text_col="query").withColumnRenamed("id", "qid")
    return fusion.rrf([lexical.bm25(queries, docs, CANDIDATES), dense.hashed_topk(asked, docs, CANDIDATES)], top_k)


def with_texts(found: DataFrame, docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows (id and others) with the texts of their documents. Rows are written and counted; up to so many go to all tasks, so that texts
    are not shuffled, and more meet them by a shuffle."""
    found = written(found, "found")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return texts.join(F.broadcast(found) if found.count() <= most else found, "id")


def lexical_relevance(rows: DataFrame) -> DataFrame:
    """The reranker in place of a model: the share of a query's content tokens that a passage has. rows: query, text."""
    asked, own = content_tokens(F.col("query")), tokenize(F.col("text"))
    return rows.withColumn("rerank_score", F.round(F.size(F.filter(asked, lambda t: F.array_contains(own, t))) / F.greatest(F.size(asked), F.lit(1)), 6))


def model_relevance(rows: DataFrame, make: Callable[[], Reranker], batch: int = 5) -> DataFrame:
    """rerank_score of rows (qid, id, rank, query, text) by a model that each task makes once, some passages of a query a call."""
    kinds = f"qid {rows.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, rank int, rerank_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part in batches:
            queries, texts = part.column(3).to_pylist(), part.column(4).to_pylist()
            out: list[float] = []
            first = 0
            while first < len(queries):
                stop = first + 1
                while stop < min(len(queries), first + batch) and queries[stop] == queries[first]:
                    stop += 1
                out += [float(s) for s in model.scores(queries[first] or "", [t or "" for t in texts[first:stop]])]
                first = stop
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2).cast(pa.int32()), pa.array(out, pa.float64())], ["qid", "id", "rank", "rerank_score"])

    return rows.select("qid", "id", "rank", "query", "text").repartition("qid").sortWithinPartitions("qid", "rank").mapInArrow(run, kinds)


def hybrid(queries: DataFrame, docs: DataFrame, *, make: Callable[[], Reranker] | None = None, depth: int = DEPTH, final: int = FINAL, cost: float | None = None, budget: float | None = None) -> DataFrame:
    """Fused candidates, the first ``depth`` of them reranked within the budget: qid, id, position, source, status; a query without
    candidates has one row of status 'no_candidates'. A budget of 0 is the fallback by fused rank."""
    found = with_texts(fused(queries, docs).join(queries, "qid"), docs)
    scored = model_relevance(found.filter(F.col("rank") <= depth), make) if make else lexical_relevance(found)
    if make:
        scored = found.select("qid", "id", "rank").join(scored.select("qid", "id", "rerank_score"), ["qid", "id"], "left")
    return fusion.with_empty(queries, fusion.rerank(scored.select("qid", "id", "rank", "rerank_score"), depth=depth, final=final, cost=cost, budget=budget))


def generate(queries: DataFrame, ranked: DataFrame, docs: DataFrame, call: Callable[[str], str] | None = None, fallback: Callable[[str], str] | None = None, context: int = CONTEXT) -> DataFrame:
    """Answers from ranked chunks (qid, id, position): qid, status, answer, citations, retry_after. ``call`` makes a text of a
    prompt or raises an Outcome; a server error is tried once more, and another failure goes to ``fallback``. Sentences that
    the chunks do not support are left out; without any, or without a call, the answer is an extract of the best chunk."""
    hits = ranked.filter(F.col("id").isNotNull() & (F.col("position") <= context)).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    chunks = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("c"))
    rows = queries.join(chunks, "qid", "left").select("qid", "query", F.coalesce(F.col("c.text"), F.array().cast("array<string>")).alias("chunks"))
    rows = rows.withColumn("weak", grounding.low_signal(F.col("query"), F.col("chunks"))).withColumn("prompt", prompt(F.col("query"), F.col("chunks")))

    def attempt(ask: Callable[[str], str] | None, text: str) -> tuple[str, str | None, float | None]:
        if ask is None:
            return "none", None, None
        for again in (False, True):
            try:
                said = ask(text)
                return ("ok", said, None) if (said or "").strip() else ("malformed", None, None)
            except Outcome as failure:
                if failure.name != "server_error" or again:
                    return failure.name, None, failure.retry_after
        raise AssertionError("unreachable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, texts, later = [], [], [], []
            for chunks, weak, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                one = attempt(call if chunks and not weak else None, text)
                two = attempt(fallback, text) if one[0] not in ("ok", "none") else ("none", None, None)
                first.append(one[0])
                second.append(two[0])
                texts.append(one[1] if one[0] == "ok" else two[1])
                later.append(one[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(texts, pa.string()), pa.array(later, pa.float64())], ["qid", "query", "chunks", "weak", "first", "second", "said", "retry_after"])

    kind = queries.schema["qid"].dataType.simpleString()
    asked = rows.select("qid", "query", "chunks", "weak", "prompt").mapInArrow(run, f"qid {kind}, query string, chunks array<string>, weak boolean, first string, second string, said string, retry_after double")
    judged = grounding.assemble(grounding.verdicts(asked.filter("said is not null").select("qid", "said", "chunks"), "said", "chunks"), "qid")
    out = asked.join(judged.withColumnRenamed("answer", "kept_answer"), "qid", "left")
    kept, rejected = F.coalesce("kept", F.lit(0)), F.coalesce("rejected", F.lit(0))
    status = grounding.answer_status(F.size("chunks"), F.col("weak"), F.col("first"), F.col("second"), F.coalesce("said", F.lit("")), kept, rejected)
    out = out.withColumn("status", status)
    answer = F.when(F.col("status") == "no_results", "No relevant documents were found for this question.").when(F.col("status") == "ok_no_answer", "I don't know.").when(F.col("status").isin("ok", "ok_partial_rejected"), F.col("kept_answer")).otherwise(grounding.extractive(F.get("chunks", F.lit(0))))
    return out.select("qid", "status", answer.alias("answer"), F.when(F.col("status").isin("ok", "ok_partial_rejected"), F.col("citations")).otherwise("").alias("citations"), "retry_after")

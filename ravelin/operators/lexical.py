"""BM25: postings, term statistics and ranked search as joins and aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.shared import small_batches, written
from .blocks import BLOCK_DOCS, by_document, entries, top_by_blocks

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a term and document: term, id, tf, dl."""
    rows = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens"))
    return rows.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n and avgdl, over all documents, those without tokens included."""
    length = F.coalesce(F.size(tokenize(F.col(text_col))), F.lit(0))
    return docs.agg(F.count("*").alias("n"), F.avg(length).alias("avgdl"))


def term_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf of ``document_frequencies`` and ``corpus_stats``."""
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("idf"))


def build_index(docs: DataFrame, path: str, buckets: int = 64, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores postings (by ``buckets`` of a term's hash) and statistics under a path of any file system. A stored index is never
    built over; a corpus without documents is an error."""
    rows = postings(docs, id_col, text_col).withColumn("bucket", bucket_of(F.col("term"), buckets))
    stats = corpus_stats(docs, text_col).withColumn("buckets", F.lit(buckets))
    if stats.first()["n"] == 0:
        raise ValueError("empty corpus")
    rows.repartition(buckets, "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    stats.write.mode("errorifexists").parquet(f"{path}/stats")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def search_index(queries: DataFrame, path: str, top_k: int = 30) -> DataFrame:
    """``bm25`` over a stored index: only the buckets of the queries' terms are read."""
    spark = queries.sparkSession
    stats = spark.read.parquet(f"{path}/stats").first()
    asked = asked_terms(queries)
    wanted = asked.select("term").distinct()
    buckets = [r["b"] for r in wanted.select(bucket_of(F.col("term"), stats["buckets"]).alias("b")).distinct().collect()]
    posts = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), "term", "left_semi")
    return scored(asked, posts.select("term", "id", "dl", "tf"), stats["n"], stats["avgdl"], queries.schema["qid"].dataType, top_k)


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))


def scored(asked: DataFrame, posts: DataFrame, n: int, avgdl: float, kind, top_k: int) -> DataFrame:
    """Ranked documents by blocks. The terms of all queries and their document frequencies come to the driver; they are bounded
    by the queries."""
    pairs = [(r["qid"], r["term"]) for r in asked.collect()]
    names, terms = list(dict.fromkeys(q for q, _ in pairs)), list(dict.fromkeys(t for _, t in pairs))
    place, column = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(terms)}
    df = {r["term"]: r["df"] for r in posts.groupBy("term").agg(F.count("*").alias("df")).collect()} if terms else {}
    matrix = np.zeros((len(names), len(terms)))
    for q, t in pairs:
        if t in df:
            matrix[place[q], column[t]] = max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1))
    numbers = posts.sparkSession.createDataFrame(list(column.items()) or [("", 0)], "term string, feature int")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1))))
    rows = by_document(posts.join(F.broadcast(numbers), "term").withColumn("weight", weight))
    return ranked(top_by_blocks(rows, entries(max(len(terms), 1)), names, matrix if terms else np.zeros((0, 1)), kind, top_k, positive=True), top_k)


def term_counts(terms: list[str]):
    """Arrow function over documents (id, tokens): id, length, and of the terms that the document has their numbers and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(first, BLOCK_DOCS)
                tokens = part.column(1)
                length = np.diff(tokens.offsets.to_numpy())
                code = pc.fill_null(pc.index_in(tokens.flatten(), known), -1).to_numpy()
                row, some = np.repeat(np.arange(len(length)), length), code >= 0
                pair, tf = np.unique(row[some] * max(len(terms), 1) + code[some], return_counts=True)
                cut = pa.array(np.searchsorted(pair, np.arange(len(length) + 1) * max(len(terms), 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (pair % max(len(terms), 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int32()), *lists], ["id", "length", "term", "tf"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, top_k: int = 30, *, id_col: str = "doc_id", text_col: str = "text", max_queries: int = 1000) -> DataFrame:
    """queries: qid, query. Returns qid, id, score, rank; ties go to the smaller id. One pass over the texts and no shuffle of
    them: it writes each document's length and how often it has the queries' terms. Of that small table come the document
    frequencies; then documents are multiplied block by block with the queries, and each task hands on its best top_k of each
    query. ``max_queries``: as many at a time; more take further passes."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    small_batches(docs.sparkSession)
    given = queries.select("qid", F.array_distinct(tokenize(F.coalesce("query", F.lit("")))).alias("terms")).collect()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))
    kind, out = queries.schema["qid"].dataType, None
    for first in range(0, max(len(given), 1), max_queries):
        part = [(r["qid"], r["terms"]) for r in given[first : first + max_queries] if r["terms"]]
        terms = sorted({t for _, own in part for t in own})
        found = _search(rows, part, terms, kind, top_k)
        out = found if out is None else out.unionByName(found)
    return ranked(out, top_k)


def _search(rows: DataFrame, part: list[tuple], terms: list[str], kind, top_k: int) -> DataFrame:
    spec = f"id {rows.schema['id'].dataType.simpleString()}, length int, term array<int>, tf array<int>"
    counted = written(rows.mapInArrow(term_counts(terms), spec), "counted")
    one = counted.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    n, df = one["n"], np.zeros(len(terms), np.int64)
    for r in counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    average = one["total"] / n if one["total"] else 1.0
    idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5) + 1))
    column = {t: i for i, t in enumerate(terms)}
    matrix = np.zeros((len(part), len(terms)))
    for i, (_, own) in enumerate(part):
        for t in own:
            matrix[i, column[t]] = idf[column[t]]
    size = max(64, min(BLOCK_DOCS, 1_000_000 // max(len(terms), 1)))

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                few = batch.slice(first, size)
                length, own = few.column(1).to_numpy(), np.diff(few.column(2).offsets.to_numpy())
                tf = np.zeros((len(length), len(terms)))
                tf[np.repeat(np.arange(len(length)), own), few.column(2).flatten().to_numpy()] = few.column(3).flatten().to_numpy()
                yield few.column(0).to_pylist(), tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[:, None] / average))

    found = counted.filter(F.size("term") > 0)
    return top_by_blocks(found, weighted, [q for q, _ in part], matrix, kind, top_k, positive=True)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, df."""
    return docs.select(F.explode(F.array_distinct(tokenize(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def ranked(scored: DataFrame, top_k: int, order=None) -> DataFrame:
    """The best rows of each qid; Spark keeps top_k a task before it shuffles."""
    order = order or [F.desc("score"), F.col("id")]
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= top_k)

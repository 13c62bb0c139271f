"""A stored BM25 index of postings by impact, searched with block maxima and an early stop.

Documents are dealt by a hash of their id to shards, and within a shard to blocks of about ``block_docs`` documents. A row of the index
holds a shard's postings of one term: for each block that has the term, their number and greatest weight, and the ids and weights
themselves, block by block. A weight is the part of a term's score that does not depend on the corpus's size; how many documents have a
term stands in a table of terms.

A query's score in a block is at most the sum of its terms' greatest weights there, each times the term's idf. A task takes a shard's
blocks in falling order of this bound, scores them whole, and stops at the first block whose bound is below the query's top_k-th score
so far; postings of later blocks are not looked at. Answers are those of ``lexical.bm25``: same scores, ties to the smaller id."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokenize
from .blocks import Best
from .lexical import K1, B, asked_terms, corpus_stats, ranked

#: What rounding of sums may add to a bound.
SLACK = 1e-5


def build(docs: DataFrame, path: str, *, shard_docs: int = 4096, block_docs: int = 64, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores the index under a path of any file system. A stored index is never built over; a corpus without documents is an error.
    Texts are shuffled once, to their shards; a task makes a shard's postings when it has read the shard's documents, of which there
    are about ``shard_docs``, whatever the terms."""
    spark = docs.sparkSession
    stats = corpus_stats(docs, text_col).first()
    if not stats["n"]:
        raise ValueError("empty corpus")
    shards, blocks, average = max(1, math.ceil(stats["n"] / shard_docs)), max(1, shard_docs // block_docs), float(stats["avgdl"] or 1)
    h = F.xxhash64("id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    rows = rows.select(F.pmod(h, F.lit(shards)).alias("shard"), F.pmod(F.shiftright(h, 20), F.lit(blocks)).cast("int").alias("block"), "id", "text")
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "id").select("shard", "block", "id", tokenize(F.col("text")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for first, stop in zip(cut, cut[1:]):
                if first < stop:
                    if held and held[0].column(0)[0].as_py() != shard[first]:
                        yield from inverted(held, average)
                        held = []
                    held.append(batch.slice(first, stop - first))
        if held:
            yield from inverted(held, average)

    kind = docs.schema[id_col].dataType.simpleString()
    index = dealt.mapInArrow(run, f"shard long, term string, block array<int>, n array<int>, top array<double>, ids array<{kind}>, weights array<double>")
    index.write.mode("errorifexists").parquet(f"{path}/impacts")
    counts = spark.read.parquet(f"{path}/impacts").groupBy("term").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("df"))
    counts.sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{path}/terms")
    about = spark.createDataFrame([(int(stats["n"]), blocks)], "n long, blocks int")
    about.write.mode("errorifexists").parquet(f"{path}/stats")


def inverted(batches: list[pa.RecordBatch], average: float) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard's documents (shard, block, id, tokens), which come in order of their ids; by term."""
    column = lambda c: pa.concat_arrays([b.column(c) for b in batches])
    tokens, ids, block = column(3), column(2), column(1).to_numpy()
    coded = tokens.flatten().dictionary_encode()
    names, length = coded.dictionary, np.diff(tokens.offsets.to_numpy())
    if not len(names):
        return
    pair, tf = np.unique(np.repeat(np.arange(len(length)), length) * len(names) + coded.indices.to_numpy(), return_counts=True)
    doc, term = pair // len(names), pair % len(names)
    place = np.argsort(np.array(names.to_pylist(), object), kind="stable")  # terms in order of their names
    rank = np.empty(len(names), np.int64)
    rank[place] = np.arange(len(names))
    order = np.lexsort((doc, block[doc], rank[term]))
    doc, tf, term = doc[order], tf[order], rank[term][order]
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
    new = np.ones(len(doc), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[doc][1:] != block[doc][:-1])
    start = np.flatnonzero(new)
    of = term[start]
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
    cells = np.searchsorted(of, np.arange(len(names) + 1))
    posts = np.searchsorted(term, np.arange(len(names) + 1))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(names), batches[0].column(0)[0].as_py()), pa.int64()), names.take(pa.array(place)).cast(pa.string()),
            lists(cells, pa.array(block[doc[start]], pa.int32())), lists(cells, pa.array(np.diff(np.append(start, len(doc))), pa.int32())), lists(cells, pa.array(np.maximum.reduceat(weight, start))),
            lists(posts, ids.take(pa.array(doc))), lists(posts, pa.array(weight)),
        ],
        ["shard", "term", "block", "n", "top", "ids", "weights"],
    )


class Shard:
    """A shard's postings of some terms: block numbers, places of the blocks' postings, greatest weights, ids and weights."""

    def __init__(self, blocks: int):
        self.blocks, self.terms, self.read = blocks, {}, 0

    def put(self, term: int, block: np.ndarray, n: np.ndarray, top: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> None:
        self.terms[term] = block, np.concatenate([[0], np.cumsum(n)]), top, ids, weights

    def search(self, best: Best, query: int, wanted: list[tuple[int, float]]) -> None:
        """Adds the shard's documents that may be among the best ones of the query; wanted: terms with their idf."""
        own = [(self.terms[t], idf) for t, idf in wanted if t in self.terms and idf > 0]
        if not own:
            return
        bound = np.zeros(self.blocks)
        for (block, _, top, _, _), idf in own:
            bound[block] += idf * top
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        done, step = 0, 4
        while done < len(order):
            least = best.scores[query][-1] if len(best.scores[query]) >= best.top_k else 0.0
            some = order[done : done + step]
            some = some[bound[some] >= least - SLACK]
            if not len(some):
                break
            self._score(best, query, own, some)
            done, step = done + step, step * 2

    def _score(self, best: Best, query: int, own: list, some: np.ndarray) -> None:
        chosen = np.zeros(self.blocks, bool)
        chosen[some] = True
        ids, scores = [], []
        for (block, start, _, every, weights), idf in own:
            for k in np.flatnonzero(chosen[block]).tolist():
                ids.append(every[start[k] : start[k + 1]])
                scores.append(idf * weights[start[k] : start[k + 1]])
        found, place = np.unique(np.concatenate(ids), return_inverse=True)
        self.read += len(place)
        best.add(query, found, np.round(np.bincount(place, weights=np.concatenate(scores), minlength=len(found)), 6))


def search(queries: DataFrame, path: str, top_k: int = 30, max_queries: int = 5000) -> DataFrame:
    """qid, id, score, rank. queries: qid, query; up to ``max_queries`` go to all tasks at once, more take further passes. Only rows of
    the queries' terms are read; a task hands on top_k documents a query."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    spark, kind = queries.sparkSession, queries.schema["qid"].dataType
    about = spark.read.parquet(f"{path}/stats").first()
    pairs = [(r["qid"], r["term"]) for r in asked_terms(queries).collect()]
    every, out = list(dict.fromkeys(q for q, _ in pairs)), None
    for first in range(0, max(len(every), 1), max_queries):
        found = _search(spark, path, [p for p in pairs if p[0] in set(every[first : first + max_queries])], about["n"], about["blocks"], kind, top_k)
        out = found if out is None else out.unionByName(found)
    return ranked(out, top_k)


def _search(spark, path: str, pairs: list[tuple], n: int, blocks: int, kind, top_k: int) -> DataFrame:
    names, terms = list(dict.fromkeys(q for q, _ in pairs)), list(dict.fromkeys(t for _, t in pairs))
    number = {t: i for i, t in enumerate(terms)}
    asked = F.broadcast(spark.createDataFrame(list(number.items()) or [("", 0)], "term string, number int"))
    counts = spark.read.parquet(f"{path}/terms").join(asked, "term").select("number", "df").collect()
    idf = {r["number"]: max(0.0, math.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1)) for r in counts}
    wanted: list[list[tuple[int, float]]] = [[] for _ in names]
    place = {q: i for i, q in enumerate(names)}
    for q, t in pairs:
        if number[t] in idf:
            wanted[place[q]].append((number[t], idf[number[t]]))
    index = spark.read.parquet(f"{path}/impacts")
    id_kind = to_arrow_type(index.schema["ids"].dataType.elementType)
    q_kind = to_arrow_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c) for c in ("block", "n", "top", "ids", "weights")]
            starts = [c.offsets.to_numpy() for c in columns]
            values = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
            for i, (shard, term) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("number").to_pylist())):
                yield shard, term, *(v[s[i] - s[0] : s[i + 1] - s[0]] for v, s in zip(values, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), top_k, True)
        for _, own in groupby(rows(batches), key=lambda r: r[0]):
            shard = Shard(blocks)
            for _, term, *held in own:
                shard.put(term, *held)
            for q, has in enumerate(wanted):
                shard.search(best, q, has)
        size = [len(x) for x in best.ids]
        qid = [name for name, k in zip(names, size) for _ in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(qid, q_kind), pa.array([i for x in best.ids for i in x], id_kind), pa.array(np.concatenate(best.scores) if names else [], pa.float64())], ["qid", "id", "score"])

    id_name = index.schema["ids"].dataType.elementType.simpleString()
    dealt = index.join(asked, "term").select("shard", "number", "block", "n", "top", "ids", "weights").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, f"qid {kind.simpleString()}, id {id_name}, score double")

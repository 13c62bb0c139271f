"""Top-k search by multiplying blocks of documents with all queries, in one pass over the documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Documents of a block, and queries multiplied with it at once.
BLOCK_DOCS, BLOCK_QUERIES = 2048, 512


class Best:
    """The best ``top_k`` documents of each query so far, by score (rounded to 6 digits) and then by id."""

    def __init__(self, queries: int, top_k: int, positive: bool):
        self.top_k, self.positive = top_k, positive
        self.ids: list[list] = [[] for _ in range(queries)]
        self.scores: list[np.ndarray] = [np.zeros(0)] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.positive:
            some = scores > 0
            ids, scores = ids[some], scores[some]
        if len(scores) > self.top_k:  # those that the k-th best score does not shut out, ties included
            some = scores >= np.partition(scores, -self.top_k)[-self.top_k]
            ids, scores = ids[some], scores[some]
        if not len(scores):
            return
        every, score = self.ids[query] + ids.tolist(), np.concatenate([self.scores[query], scores])
        order = sorted(range(len(every)), key=lambda i: (-score[i], every[i]))[: self.top_k]
        self.ids[query], self.scores[query] = [every[i] for i in order], score[order]


def top_by_blocks(rows: DataFrame, read: Callable[[Iterator], Iterator[tuple[list, np.ndarray]]], names: list, matrix: np.ndarray, kind, top_k: int, positive: bool = False) -> DataFrame:
    """qid, id, score: each task's best documents of each query. ``read`` makes (ids, documents x features) blocks of a task's
    batches; ``matrix``: queries x features, sent to all tasks. A task hands on top_k rows a query at most."""
    id_kind = to_arrow_type(rows.schema["id"].dataType)
    q_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), top_k, positive)
        for ids, block in read(batches):
            ids = np.array(ids, object)
            for first in range(0, len(names), BLOCK_QUERIES):
                scores = np.round(matrix[first : first + BLOCK_QUERIES] @ block.T, 6)
                for q, row in enumerate(scores):
                    best.add(first + q, ids, row)
        size = [len(x) for x in best.ids]
        qid = [name for name, n in zip(names, size) for _ in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(qid, q_kind), pa.array([i for x in best.ids for i in x], id_kind), pa.array(np.concatenate(best.scores) if names else [], pa.float64())], ["qid", "id", "score"])

    return rows.mapInArrow(run, f"qid {kind.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double")


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of rows (id, vector); null vectors are left out."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(first, BLOCK_DOCS)
            part = part.filter(part.column(1).is_valid())
            if part.num_rows:
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield part.column(0).to_pylist(), flat.reshape(part.num_rows, -1)


def entries(width: int):
    """Blocks of rows (id, feature, weight) that come sorted by id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[tuple[list, np.ndarray]]:
            """All complete documents held; the last one may go on in the next batch."""
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = table.column(0).to_pylist()
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            feature, weight = table.column(1).to_numpy(), table.column(2).to_numpy()
            keep = len(cut) - 1 if last else len(cut) - 2
            for first in range(0, keep, BLOCK_DOCS):
                some = cut[first : min(first + BLOCK_DOCS, keep) + 1]
                block = np.zeros((len(some) - 1, width))
                a, b = some[0], some[-1]
                block[np.repeat(np.arange(len(some) - 1), np.diff(some)), feature[a:b]] = weight[a:b]
                yield [ids[i] for i in some[:-1]], block
            if not last:
                held.extend(table.slice(cut[keep]).to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > 100_000:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    return read


def by_document(rows: DataFrame) -> DataFrame:
    """Rows (id, feature, weight) with each document's together, in order."""
    return rows.select("id", F.col("feature").cast("int"), F.col("weight").cast("double")).repartition("id").sortWithinPartitions("id")

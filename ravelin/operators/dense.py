"""Dense retrieval: embedders, normalisation and exact inner-product search."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.shared import small_batches
from .blocks import top_by_blocks, vectors
from .lexical import ranked


class Embedder(Protocol):
    """What turns texts into vectors. ``embed`` takes a batch whole or fails."""

    embedder_id: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class EmbeddingError(RuntimeError):
    pass


def with_retries(call: Callable, attempts: int = 3, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after a failure it is tried again, each time after twice the pause, and the last failure is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(backoff * 2**k)


def embed(docs: DataFrame, make: Callable[[], Embedder], *, id_col: str = "doc_id", text_col: str = "text", batch: int = 32, attempts: int = 3, backoff: float = 0.5) -> DataFrame:
    """id, vector under an embedder that each task makes once. Batches are tried up to ``attempts`` times; one that fails, or whose
    vectors have another shape, fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part in batches:
            for first in range(0, part.num_rows, batch):
                few = part.slice(first, batch)
                texts = [t or "" for t in few.column(1).to_pylist()]
                found = np.asarray(with_retries(lambda texts=texts: model.embed(texts), attempts, backoff), np.float32)
                if found.shape != (len(texts), model.dim):
                    raise EmbeddingError(f"{model.embedder_id}: vectors of shape {found.shape}, not {(len(texts), model.dim)}")
                yield pa.RecordBatch.from_arrays([few.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, model.dim, dtype=np.int32)), pa.array(found.ravel()))], ["id", "vector"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, vector array<float>")


def pad(ids: list[list[int]], most: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids cut to ``most`` and padded with 0 to the longest, their mask, and type ids (all 0)."""
    width = max((min(len(x), most) for x in ids), default=0)
    out = np.zeros((len(ids), width), np.int64)
    mask = np.zeros_like(out)
    for i, x in enumerate(ids):
        out[i, : min(len(x), most)] = x[:most]
        mask[i, : min(len(x), most)] = 1
    return out, mask, np.zeros_like(out)


def pool(states: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Unit vectors of token states (texts x tokens x dim): the mean under the mask, or the first token's."""
    if how == "cls":
        out = states[:, 0]
    else:
        weight = mask[:, :, None].astype(states.dtype)
        out = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class OnnxModel:
    """A model file with its tokenizer file, both given by path; nothing is downloaded. ``embed`` gives sentence vectors,
    ``scores`` the relevance of passages to a query (for cross-encoders)."""

    def __init__(self, model: str, tokenizer: str, dim: int = 384, how: str = "mean"):
        import onnxruntime
        from tokenizers import Tokenizer

        self.session, self.tokenizer = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer)
        self.embedder_id, self.dim, self.how = f"onnx-{hashlib.sha256(open(model, 'rb').read()).hexdigest()[:12]}", dim, how

    def _run(self, encoded) -> tuple[np.ndarray, np.ndarray]:
        ids, mask, kinds = pad([e.ids for e in encoded])
        for i, e in enumerate(encoded):
            kinds[i, : min(len(e.type_ids), kinds.shape[1])] = e.type_ids[: kinds.shape[1]]
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds}
        return self.session.run(None, {i.name: given[i.name] for i in self.session.get_inputs()})[0], mask

    def embed(self, texts: list[str]) -> np.ndarray:
        return pool(*self._run(self.tokenizer.encode_batch(texts)), self.how)

    def scores(self, query: str, passages: list[str]) -> np.ndarray:
        return self._run(self.tokenizer.encode_batch([(query, p) for p in passages]))[0].reshape(len(passages), -1)[:, 0]


@lru_cache(1 << 16)
def token_place(token: str) -> tuple[bytes, bool]:
    """Bytes 0-3 of the token's md5, and whether byte 4 is even."""
    digest = hashlib.md5(token.encode()).digest()
    return digest[:4], digest[4] % 2 == 0


def token_places(tokens: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its bucket (md5 bytes 0-3, little endian, modulo dim) and sign (+ for an even byte 4)."""
    places = [token_place(t) for t in tokens]
    return np.frombuffer(b"".join(p for p, _ in places), "<u4").astype(np.int64) % dim, np.where([even for _, even in places], 1.0, -1.0)


def hashed(dim: int):
    """Blocks of rows (id, tokens): the rows, their vectors of length 1 or 0, and whether a row has one. A batch's distinct tokens are
    hashed once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                tokens = batch.column(1)
                count = np.diff(tokens.offsets.to_numpy()) if len(tokens) else np.zeros(0, np.int64)
                coded = tokens.flatten().dictionary_encode()
                bucket, sign = token_places(coded.dictionary.to_pylist(), dim)
                code = coded.indices.to_numpy()
                row = np.repeat(np.arange(len(count)), count)
                dense = np.bincount(row * dim + bucket[code], sign[code], len(count) * dim).reshape(-1, dim) if len(code) else np.zeros((len(count), dim))
                norm = np.sqrt((dense * dense).sum(axis=1))
                some = norm > 0
                dense[some] /= norm[some][:, None]
                yield batch, dense, some

    return read


def hashing_vectors(docs: DataFrame, dim: int = 384, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, vector: unit vectors of hashed tokens, null without any. Tokens are made by Spark; a batch's distinct tokens are hashed
    once, and nothing is shuffled."""
    if dim <= 0:
        raise ValueError("dim must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dense, some in hashed(dim)(batches):
            offsets = np.concatenate([[0], np.cumsum(np.where(some, dim, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(dense[some].ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "vector"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _tokens(docs, id_col, text_col).mapInArrow(run, f"id {kind}, vector array<double>")


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))


def hashing_embed(docs: DataFrame, dim: int = 384, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as rows (id, bucket, weight) of what is not 0."""
    rows = hashing_vectors(docs, dim, id_col=id_col, text_col=text_col)
    return rows.select("id", F.posexplode("vector").alias("bucket", "weight")).filter("weight <> 0")


def normalise(vector: Column) -> Column:
    """The unit vector; the zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def checked(rows: DataFrame, dim: int) -> DataFrame:
    """The rows; a vector of another length is an error."""
    good = F.col("vector").isNull() | (F.size("vector") == dim)
    return rows.withColumn("vector", F.when(good, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"vectors must have {dim} values, not "), F.size("vector").cast("string")))))


def dense_topk(queries: DataFrame, docs: DataFrame, top_k: int = 10, max_queries: int = 20_000) -> DataFrame:
    """Exact inner-product search. queries: qid, vector; docs: id, vector; null vectors take no part, vectors of unlike length are
    an error. Up to ``max_queries`` queries go to all tasks at once (more take further passes); each task multiplies blocks of
    its documents with them and keeps the best top_k a query, so the shuffle holds at most top_k rows a query and task."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    asked = [(r["qid"], r["vector"]) for r in queries.filter("vector is not null").select("qid", "vector").collect()]
    if len({len(v) for _, v in asked}) > 1:
        raise ValueError("query vectors must have one length")
    dim = len(asked[0][1]) if asked else 0
    rows = checked(docs.select("id", "vector"), dim) if asked else docs.select("id", "vector").limit(0)
    return _best(queries, asked, rows, vectors, dim, top_k, max_queries)


def hashed_topk(queries: DataFrame, docs: DataFrame, top_k: int = 10, dim: int = 384, max_queries: int = 20_000, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dense_topk`` over the ``hashing_vectors`` of these texts, which are multiplied where they are made: they do not go back to Spark
    in between. queries: qid, vector."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    asked = [(r["qid"], r["vector"]) for r in queries.filter("vector is not null").select("qid", "vector").collect()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
        for batch, block, some in hashed(dim)(batches):
            yield batch.column(0).filter(pa.array(some)).to_pylist(), block[some]

    return _best(queries, asked, _tokens(docs, id_col, text_col), read, dim, top_k, max_queries)


def _best(queries: DataFrame, asked: list[tuple], rows: DataFrame, read, dim: int, top_k: int, max_queries: int) -> DataFrame:
    out = None
    for first in range(0, max(len(asked), 1), max_queries):
        part = asked[first : first + max_queries]
        found = top_by_blocks(rows, read, [q for q, _ in part], np.array([v for _, v in part], np.float64).reshape(len(part), dim), queries.schema["qid"].dataType, top_k)
        out = found if out is None else out.unionByName(found)
    return ranked(out, top_k)

"""Document fingerprints of Lempel-Ziv phrases.

A text's bytes are parsed into phrases, each the shortest piece that is not in the dictionary yet, which it then joins (the 1978
scheme). The set of phrases is hashed and its ``SIZE`` smallest hashes (48 bits each) are the fingerprint: a minimum-hash signature
that is the whole set for short texts. Two texts are alike as far as their sets overlap: the Jaccard likeness, estimated from the
smallest hashes of the union, high where one text's dictionary would compress the other.

The dictionary starts anew at the first multiple of ``PIECE`` bytes at which it has ``DICTIONARY`` phrases or more, so the memory
of a parse has a bound whatever a text's length; the phrases before it stay in the set.

Results: null texts are empty, an empty text has the empty fingerprint and a likeness of 1 to empty texts, 0 to others; equal texts
have equal fingerprints; repeated rows have a row each; other columns are not read."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._memory import frugal, small_batches
from ._text import BYTE_BASE, U8, mix, powers

SIZE = 128
PIECE, DICTIONARY = 1 << 20, 500_000
#: A hash is written as eight characters, in an alphabet whose order is that of the hashes.
WIDTH = 8
ALPHABET = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_write, _read = str.maketrans(_STANDARD, ALPHABET), str.maketrans(ALPHABET, _STANDARD)
#: Bytes of phrases hashed at once.
HASHED_AT_ONCE = 1 << 17


def parse(data: bytes, dictionary: set[bytes]) -> bytes:
    """Adds the phrases of these bytes to the dictionary; returns the last bytes, which are no new phrase."""
    add, start = dictionary.add, 0
    for end in range(1, len(data) + 1):
        phrase = data[start:end]
        if phrase not in dictionary:
            add(phrase)
            start = end
    return data[start:]


def smallest(phrases: list[bytes]) -> np.ndarray:
    """The ``SIZE`` smallest hashes of these phrases, ascending."""
    found, k = [np.empty(0, U8)], 0
    length = np.fromiter(map(len, phrases), np.int64, len(phrases))
    end = np.cumsum(length)
    while k < len(phrases):
        low = end[k] - length[k]
        stop = max(k + 1, int(np.searchsorted(end, low + HASHED_AT_ONCE, side="right")))
        raw = np.frombuffer(b"".join(phrases[k:stop]), np.uint8)
        up, down = powers(BYTE_BASE, len(raw))
        run = np.zeros(len(raw) + 1, U8)
        np.cumsum((raw.astype(U8) + U8(1)) * up, out=run[1:])
        e = end[k:stop] - low
        s = e - length[k:stop]
        own = mix((run[e] - run[s]) * down[s] + length[k:stop].astype(U8)) >> U8(16)
        found.append(np.partition(own, SIZE)[:SIZE] if len(own) > SIZE else own)
        k = stop
    return np.unique(np.concatenate(found))[:SIZE]


class Parse:
    """A parse that takes a text's bytes in parts, however cut, and can be copied on the way."""

    def __init__(self):
        self.dictionary: set[bytes] = set()
        self.rest, self.taken, self.least = b"", 0, np.empty(0, U8)

    def copy(self) -> Parse:
        other = Parse()
        other.dictionary, other.rest, other.taken, other.least = self.dictionary.copy(), self.rest, self.taken, self.least
        return other

    def feed(self, data: bytes) -> Parse:
        at = 0
        while at < len(data):
            stop = at + PIECE - self.taken % PIECE
            piece = data[at:stop]
            self.rest = parse(self.rest + piece, self.dictionary)
            self.taken += len(piece)
            at = stop
            if self.taken % PIECE == 0 and len(self.dictionary) >= DICTIONARY:
                self.least = np.unique(np.concatenate([self.least, smallest(list(self.dictionary))]))[:SIZE]
                self.dictionary = set()
                self.rest = parse(self.rest, self.dictionary)
        return self

    def hashes(self) -> np.ndarray:
        phrases = list(self.dictionary)
        if self.rest and self.rest not in self.dictionary:  # after a new start the last bytes may be a phrase of the old dictionary
            phrases.append(self.rest)
        own = smallest(phrases)
        return np.unique(np.concatenate([self.least, own]))[:SIZE] if len(self.least) else own


def fingerprint(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode().translate(_write)


def hashes_of(written: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(written.translate(_read)), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(">u8").ravel().astype(U8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the union's smallest hashes that both sets have."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    place = np.flatnonzero(new)
    stop = place[SIZE] if len(place) > SIZE else len(both)  # each hash that both have stands twice in the sorted row
    return float((stop - min(len(place), SIZE)) / min(len(place), SIZE))


def likeness_column(left: Column, right: Column) -> Column:
    """The same of two columns with fingerprints, as a native expression."""
    a, b = (F.regexp_extract_all(c, F.lit(f"(.{{{WIDTH}}})"), F.lit(1)) for c in (left, right))
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SIZE)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars (code points) and fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = [fingerprint(Parse().feed(t.encode()).hashes()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(made, pa.string())], ["id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, n_chars long, fingerprint string")
    return rows.withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, *, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """Rows (id, text, tail) in partitions that are ranges of descending (id, hash of the text), null ids last. Each partition ends
    with the first row of the next one, the last with the very first, as a row with ``tail``, so that every row's next one follows
    it. The ranges come from a sort of ids and hashes alone; the driver gets their first rows' keys, one a partition; rows with
    texts are shuffled once."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = F.struct(F.col("id"), F.col("h"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.select("id", "h").repartitionByRange(parts, F.desc_nulls_last("id"), F.desc("h"))
    heads = sorted((r[0], r[1]["id"], r[1]["h"]) for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("head")).collect())
    if not heads:
        return rows.select("id", "text", F.lit(False).alias("tail"))
    kind = docs.schema[id_col].dataType
    array = F.array(*(F.struct(F.lit(i).cast(kind).alias("id"), F.lit(h).cast("long").alias("h")) for _, i, h in heads))
    step = max(1, round(len(heads) ** 0.5))
    coarse = F.array(*(F.struct(F.lit(i).cast(kind).alias("id"), F.lit(h).cast("long").alias("h")) for _, i, h in heads[::step]))
    own = F.struct(F.col("id"), F.col("h"))
    rows = rows.withColumn("c", F.size(F.filter(coarse, lambda x: x >= own)) - 1)
    rows = rows.withColumn("bucket", F.col("c") * step + F.size(F.filter(F.slice(array, F.col("c") * step + 1, step), lambda x: x >= own)) - 1)
    first = F.element_at(array, F.col("bucket") + 1) == own
    before = F.pmod(F.col("bucket") - 1, F.lit(len(heads)))
    goes = lambda bucket, tail: F.struct(bucket.alias("bucket"), F.lit(tail).alias("tail"))
    rows = rows.select("id", "h", "text", F.explode(F.when(first, F.array(goes(F.col("bucket"), False), goes(before, True))).otherwise(F.array(goes(F.col("bucket"), False)))).alias("to"))
    rows = rows.select("id", "h", "text", "to.tail", "to.bucket").repartitionById(len(heads), F.col("bucket").cast("int"))
    return rows.sortWithinPartitions("tail", F.desc_nulls_last("id"), F.desc("h")).select("id", "text", "tail")


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each row, in the order of ``in_order``, against the next one and against an edit of itself: its last floor(n_chars / 2) code
    points replaced by the first as many of the next text. Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The parse of the half that a text shares with its edit is done once."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held, ended = None, False
        for batch in batches:
            out = []
            for name, text, tail in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ended:
                    break
                ended, half = tail, len(text) // 2
                kept = text[: len(text) - half].encode()
                own = Parse().feed(kept)
                edit = own.copy() if not tail else None
                found = own.feed(text[len(text) - half :].encode()).hashes()
                if held:
                    before, n, start, more, other, hashes = held
                    end = text[:more].encode()
                    edited = other.feed(end).hashes()
                    out.append((before, n, hashlib.sha256(start + end).hexdigest(), fingerprint(hashes), fingerprint(edited), likeness(hashes, edited), likeness(hashes, found)))
                held = name, len(text), kept, half, edit, found
            if out:
                columns = list(zip(*out))
                kinds = [batch.schema.types[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in columns[0]], kinds[0]), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:]))], names)

    rows = in_order(docs, id_col=id_col, text_col=text_col, parts=parts)
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(frugal(run), schema).withColumnRenamed("id", id_col)

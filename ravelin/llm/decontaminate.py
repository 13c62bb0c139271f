"""Benchmark decontamination: a distributed positional inverted index of the training texts, searched for benchmark windows.

``build_index`` stores the postings of all tokens of all texts, whatever will be asked. It is partitioned by document: each row
is a *shard*, the sorted postings lists (term, places) of some whole texts, packed. Texts stand one after the other in a
shard with a gap between them, so no match crosses texts. ``search`` takes all windows of the benchmark through each shard at
once: from the list of a window's rarest term there, adjusted by the term's offset in the window, the places are intersected
with the lists of its other terms, rarest first, each addressed by place. What remains are exact phrases. Proximity matches
hold all words of a window, in any order, within ``slop`` words more than it has.

The benchmark is sent to all tasks as word hashes; if it has more than ``part_bytes`` of text, it is searched in parts over the
same index, so what is sent at once stays bounded, and the parts' results are joined by the row's place in the index. Terms are
64-bit hashes, of which a shard keeps 40 bits or more.

Results: null or wordless texts and items match nothing; items with a null id are left out, as no result could name them; an
item of fewer words than a window is one window; repeated rows, and rows that share an id, are searched each for itself; equal
item ids count once; with no usable item nothing is hit; extra columns are left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._memory import frugal
from ._store import Scratch
from ._text import U8, Words, utf8

#: Words of a shard, places left free between its texts, bits of a place, and candidate places looked at together.
SHARD_WORDS, GAP, PLACE_BITS, CANDIDATES = 900_000, 64, 20, 500_000
#: Lower-cases A-Z and turns every byte outside words into a space: words are letters, digits and bytes from 0x80.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPACE = np.arange(256) == 32
INDEX = "docs array<{kind}>, shard long, bits int, counts binary, terms binary, cuts binary, places binary"
FOUND = "id {kind}, shard long, at int, n_words long, n_hit long, spans array<long>, items array<string>, near_items array<string>"


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many each text has."""
    words = Words([t.translate(WORD_BYTES) if t else None for t in texts], SPACE)
    return words.hashes(), words.counts()


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def index_texts(kind: pa.DataType):
    """Arrow function: texts -> shards of postings."""

    def shard(number: int, docs: list, hashes: list, counts: list) -> pa.RecordBatch:
        code, count = np.concatenate(hashes), np.concatenate(counts)
        base = np.cumsum(count + GAP) - (count + GAP)
        place = np.arange(len(code)) + np.repeat(base - (np.cumsum(count) - count), count)
        bits = max(PLACE_BITS, int(base[-1] + count[-1] + 1).bit_length())
        posting = np.sort((code >> U8(bits)) << U8(bits) | place.astype(U8))
        term = posting >> U8(bits)
        cut = np.flatnonzero(np.diff(term, prepend=~term[:1]))
        place = (posting & U8((1 << bits) - 1)).astype(np.int64)
        packed = (pack(count.astype(np.int32)), pack(term[cut]), pack(np.append(cut, len(term)).astype(np.int32)), pack(np.diff(place, prepend=0).astype(np.int32)))
        arrays = [pa.array([docs], pa.list_(kind)), pa.array([number]), pa.array([bits], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)]
        return pa.RecordBatch.from_arrays(arrays, ["docs", "shard", "bits", "counts", "terms", "cuts", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        docs, hashes, counts, held = [], [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            first = size = 0
            for i, text in enumerate(texts):
                size += len(text or b"")
                if size < 300_000 and i + 1 < len(texts):
                    continue
                code, count = word_hashes(texts[first : i + 1])
                docs += ids[first : i + 1]
                hashes.append(code)
                counts.append(count)
                held += len(code) + GAP * len(count)
                first, size = i + 1, 0
                if held > SHARD_WORDS:
                    yield shard(number, docs, hashes, counts)
                    number += 1
                    docs, hashes, counts, held = [], [], [], 0
        if docs:
            yield shard(number, docs, hashes, counts)

    return run


class Shard:
    """The postings of some texts. ``at``: the number of the term whose list has a place (-1: none), made of the lists."""

    def __init__(self, bits: int, counts: bytes, terms: bytes, cuts: bytes, places: bytes):
        self.bits = bits
        self.counts = unpack(counts, np.int32).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.counts + GAP)])
        self.terms, self.cuts = unpack(terms, U8), unpack(cuts, np.int32).astype(np.int64)
        self.places = np.cumsum(unpack(places, np.int32), dtype=np.int64)
        self.at = np.full(self.base[-1] + GAP, -1, np.int32)
        self.at[self.places] = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.cuts))

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The number of each hash's list, or -2."""
        if not len(self.terms):
            return np.full(len(codes), -2)
        short = codes >> U8(self.bits)
        at = np.minimum(np.searchsorted(self.terms, short), len(self.terms) - 1)
        return np.where(self.terms[at] == short, at, -2)

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1

    def seeds(self, number: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and places of the lists of these numbers, some rows at a time."""
        total = np.cumsum(length)
        first = 0
        while first < len(number):
            stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CANDIDATES, side="right")))
            size = length[first:stop]
            row = np.repeat(np.arange(first, stop), size)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            yield row, self.places[self.cuts[number[row]] + offset]
            first = stop

    def phrases(self, number: np.ndarray, size: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and the places where they begin. number, length: of each window's words, their lists and the lists' lengths."""
        order = np.argsort(length, axis=1, kind="stable")
        rows = np.arange(len(number))
        for row, place in self.seeds(number[rows, order[:, 0]], length[rows, order[:, 0]]):
            place = place - order[row, 0]
            row, place = row[place >= 0], place[place >= 0]
            for j in range(1, number.shape[1]):
                k = order[row, j]
                fits = (k >= size[row]) | (self.at[np.minimum(place + k, len(self.at) - 1)] == number[row, k])
                row, place = row[fits], place[fits]
            yield row, place

    def near(self, number: np.ndarray, size: np.ndarray, length: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows, and places of their rarest word around which all their words stand within ``slop`` more than their size."""
        order = np.argsort(length, axis=1, kind="stable")
        rows = np.arange(len(number))
        postings = np.repeat(np.arange(len(self.terms)), np.diff(self.cuts)) << self.bits | self.places
        for row, place in self.seeds(number[rows, order[:, 0]], length[rows, order[:, 0]]):
            for j in range(1, number.shape[1]):
                k = order[row, j]
                list_, span = number[row, k], size[row] + slop
                after = np.searchsorted(postings, list_ << self.bits | np.maximum(place - span + 1, 0))
                fits = (k >= size[row]) | (postings[np.minimum(after, len(postings) - 1)] < (list_ << self.bits | place + span))
                fits &= (k >= size[row]) | (after < len(postings))
                row, place = row[fits], place[fits]
            span = size[row] + slop
            ok = np.zeros(len(row), bool)
            for low in range(int(span.max()) if len(row) else 0):  # a stretch that starts low words before the place
                fits = (low < span) & ~ok
                for j in range(number.shape[1]):
                    one = np.flatnonzero(fits & (j < size[row]))
                    list_, start = number[row[one], j], np.maximum(place[one] - low, 0)
                    after = np.minimum(np.searchsorted(postings, list_ << self.bits | start), len(postings) - 1)
                    found = postings[after]
                    fits[one] &= (found >= (list_ << self.bits | start)) & (found < (list_ << self.bits | place[one] - low + span[one]))
                ok |= fits
            yield row[ok], place[ok]


class Windows:
    """The windows of a benchmark: of each its first word in ``codes``, its size and its item in ``names`` (sorted, distinct)."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int):
        items = [(name, code) for name, code in items if len(code)]
        self.size, self.names = size, sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        count = np.array([len(code) for _, code in items], np.int64)
        self.codes = np.concatenate([code for _, code in items]) if items else np.zeros(0, U8)
        windows = np.maximum(count - size + 1, 1)
        first = np.cumsum(count) - count
        self.start = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        self.sizes = np.repeat(np.minimum(count, size), windows)
        self.item = np.repeat(np.array([place[name] for name, _ in items], np.int64), windows)

    def through(self, shard: Shard, slop: int) -> tuple[np.ndarray, ...]:
        """Places, sizes and items of exact phrases; texts and items of proximity matches."""
        number = shard.numbers(self.codes)
        length = np.where(number >= 0, np.diff(shard.cuts)[np.maximum(number, 0)] if len(shard.terms) else 0, 0)
        word = self.start[:, None] + np.arange(self.size)
        inside = np.arange(self.size) < self.sizes[:, None]
        word = np.where(inside, word, 0)
        lengths = np.where(inside, length[word] if len(length) else 0, np.iinfo(np.int64).max)
        able = np.flatnonzero((lengths > 0).all(axis=1))
        number, lengths, sizes, item = number[word[able]] if len(number) else word[able], lengths[able], self.sizes[able], self.item[able]
        none = [np.zeros(0, np.int64)]
        exact = list(shard.phrases(number, sizes, lengths))
        row, place = (np.concatenate([x[i] for x in exact] or none) for i in range(2))
        close = list(shard.near(number, sizes, lengths, slop)) if slop else []
        beside, around = (np.concatenate([x[i] for x in close] or none) for i in range(2))
        return place, sizes[row], item[row], shard.text_of(around), item[beside]


def lists(texts: int, text: np.ndarray, value: np.ndarray, values: pa.Array) -> pa.ListArray:
    """For each text the values of its pairs (text, value), in order, each once."""
    pair = np.unique(text * max(len(values), 1) + value)
    text, value = pair // max(len(values), 1), pair % max(len(values), 1)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(texts + 1)).astype(np.int32)), values.take(pa.array(value)))


def search_shards(windows: Windows, slop: int, kind: pa.DataType):
    """Arrow function: shards -> per text its number of words, hit places and matched items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(windows.names, pa.string())
        for batch in batches:
            for docs, number, *packed in (row for part in range(batch.num_rows) for row in zip(*(batch.column(i).slice(part, 1).to_pylist() for i in range(7)))):
                shard = Shard(*packed)
                n = len(docs)
                place, size, item, beside, close = windows.through(shard, slop)
                marks = np.bincount(place, minlength=shard.base[-1] + 1) - np.bincount(place + size, minlength=shard.base[-1] + 1)
                covered = np.cumsum(marks) > 0
                total = np.concatenate([[0], np.cumsum(covered)])
                low, high = shard.base[:-1], shard.base[:-1] + shard.counts
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8)))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(edge, np.append(low, shard.base[-1])).astype(np.int32)), pa.array(edge - shard.base[shard.text_of(edge - np.arange(len(edge)) % 2)]))
                found = shard.text_of(place)
                step = max(len(names), 1)
                only = ~np.isin(beside * step + close, found * step + item)
                arrays = [pa.array(docs, kind), pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(shard.counts), pa.array(total[high] - total[low]), spans, lists(n, found, item, names), lists(n, beside[only], close[only], names)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "shard", "at", "n_words", "n_hit", "spans", "items", "near_items"])

    return run


def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: the spans of a text from several parts as merged ranges, and how many words they cover."""
    for batch in batches:
        hits, joined = [], []
        for spans in batch.column("spans").to_pylist():
            out: list[int] = []
            for a, b in sorted(zip(spans[0::2], spans[1::2])):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            joined.append(out)
            hits.append(sum(out[1::2]) - sum(out[0::2]))
        columns = {c: batch.column(c) for c in ("id", "shard", "at", "n_words", "items", "near_items")} | {"n_hit": pa.array(hits, pa.int64()), "spans": pa.array(joined, pa.list_(pa.int64()))}
        names = ["id", "shard", "at", "n_words", "n_hit", "spans", "items", "near_items"]
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, a row a shard; write it before it is searched."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(index_texts(to_arrow_type(kind))), INDEX.format(kind=kind.simpleString()))


def search(index: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slop: int = 2, part_bytes: int = 4_000_000) -> DataFrame:
    """Per text of a stored index: id, n_words, n_hit, spans, items (ids as sorted strings) and near_items."""
    kind = index.schema["docs"].dataType.elementType
    asked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("text is not null and item is not null")
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    out = None
    for part in range(parts):
        items = [(r["item"], word_hashes([r["text"].encode()])[0]) for r in asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toLocalIterator()]
        found = index.mapInArrow(frugal(search_shards(Windows(items, size), slop, to_arrow_type(kind))), FOUND.format(kind=kind.simpleString()))
        out = found if out is None else out.unionByName(found)
    if parts > 1:
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        out = out.groupBy("shard", "at").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), every("items"), every("near_items"))
        out = out.withColumn("near_items", F.array_except("near_items", "items")).mapInArrow(join_parts, FOUND.format(kind=kind.simpleString()))
    return out.select("id", "n_words", "n_hit", "spans", "items", "near_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slop: int = 2, part_bytes: int = 4_000_000) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (starts and ends of hit runs, in words), items
    and near_items (ids as sorted strings). The index is stored in the shared folder."""
    index = Scratch(docs.sparkSession, "benchmark").write(build_index(docs, id_col=id_col, text_col=text_col), "index")
    out = search(index, benchmark, item_col=item_col, item_text_col=item_text_col, size=size, slop=slop, part_bytes=part_bytes)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", "items", "near_items")

"""Substring dedup: suffix automata of reference shards; documents streamed past them for matching statistics.

A window is ``min_words`` consecutive words of one text. A word goes if a window over it also starts in a document with a
smaller id. Whole-corpus automata would outgrow any broadcast, so the reference is cut into shards by content:

1. Each window is filed under its *anchor*, the least hash of the 8-word sequences in it; equal windows have equal
   anchors, wherever they stand. Anchors found in one document only are dropped.
2. A *passage* is the run of windows of a text with one anchor. Equal passages collapse to one with its first document.
3. A shard holds the passages of some anchors. Its generalised suffix automaton carries in every state the first document
   of its strings. A passage streamed past it gives, word by word, the longest match; where it spans a window, the
   state of that length tells the first document with that window.
4. The passages of a hot anchor (more than a shard holds) go through the same steps again, as texts of their own, with
   anchors of longer sequences, at last of whole windows, of which no anchor has more than one passage. So equal windows
   still meet in one place, each passage goes only where its own windows are, and the work grows with the passages.
5. Each document takes the spans whose first document is before it.

Results: null texts have no words; null ids neither lose words nor make others lose them; rows that repeat an id with another
text are judged each by its own text, and no row loses words to a row of its own id; equal rows keep alike; texts shorter than
a window lose nothing; extra columns are left alone."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._memory import frugal, frugal_group
from ._store import Scratch
from ._text import U8, Words, chunks, mix, running, sequence, space_table, utf8

#: Words of the sequences that anchors are taken from, one level after the other; the last level's are whole windows.
ANCHOR_WORDS = (8, 24)
SPOT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
#: Entries of a block and of a task's buffer; distinct passages of one shard.
BLOCK_SPOTS, FLUSH_SPOTS, SHARD_PASSAGES = 250_000, 250_000, 600


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, anchor and first and last window start (in words of the text) of every passage."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none.astype(U8), none, none
    run, first = running(words.hashes()), words.first
    k = min(gram, window)
    grams = sequence(run, np.arange(len(words) - k + 1), k)
    width = window - k + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(words) - window + 1)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    if not len(text):
        return none, none.astype(U8), none, none
    enough = counts >= window
    begins = np.repeat(first[:-1][enough], (counts - window + 1)[enough])
    ends = np.cumsum((counts - window + 1)[enough])
    at = begins + np.arange(len(text)) - np.repeat(ends - (counts - window + 1)[enough], (counts - window + 1)[enough])
    place = least[at]
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(at)) - 1
    return text[new], grams[place[new]], at[new] - begins[new], at[last] - begins[new]


def file_spots(window: int, gram: int, blocks: int):
    """Arrow function: all passages' places, packed by anchor block."""

    def table(parts):
        spots = np.concatenate(parts)
        block = (mix(spots["h"]) % U8(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        spots, block = spots[order], block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array([spots[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(spots)])], pa.binary())], ["block", "data"])

    def run(batches):
        spaces, parts, held = space_table(), [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            for a, b in chunks(texts, 400_000):
                text, h, lo, hi = anchors(Words(texts[a:b], spaces), window, gram)
                part = np.empty(len(text), SPOT)
                part["doc"], part["h"], part["lo"], part["hi"] = ids[a + text], h, lo, hi
                if len(part):
                    parts.append(part)
                    held += len(part)
                if held > FLUSH_SPOTS:
                    yield table(parts)
                    parts, held = [], 0
        if parts:
            yield table(parts)

    return run


def shared_spots(batches):
    """Arrow function over packed blocks: the places whose anchor is in two documents or more. An anchor's places leave as
    soon as that is known, so a hot anchor is not gathered."""
    parts, held, limit = [], 0, 4 * BLOCK_SPOTS
    shared = np.zeros(0, U8)

    def settle():
        nonlocal parts, held, limit, shared
        spots = np.sort(np.concatenate(parts), order=["h", "doc"])
        cut = np.flatnonzero(np.diff(spots["h"], prepend=~spots["h"][:1]))
        last = np.append(cut[1:], len(spots)) - 1
        several = spots["doc"][cut] != spots["doc"][last]
        if len(shared):
            several |= shared[np.minimum(np.searchsorted(shared, spots["h"][cut]), len(shared) - 1)] == spots["h"][cut]
        keep = np.repeat(several, last - cut + 1)
        shared = np.union1d(shared, spots["h"][cut[several]])
        out, rest = spots[keep], spots[~keep]
        parts, held, limit = [rest], len(rest), max(limit, 2 * len(rest))
        for k in range(0, len(out), 100_000):
            part = out[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc"]), pa.array(part["h"].view(np.int64) if part["h"].flags.c_contiguous else np.ascontiguousarray(part["h"]).view(np.int64)), pa.array(part["lo"].astype(np.int32)), pa.array(part["hi"].astype(np.int32))], ["doc", "h", "lo", "hi"])

    for batch in batches:
        for data in batch.column(1).to_pylist():
            parts.append(np.frombuffer(data, SPOT))
            held += len(parts[-1])
            if held > limit:
                yield from settle()
    if held:
        yield from settle()


def cut_passages(window: int):
    """Arrow function: the words of each shared passage."""

    def run(batches):
        kinds = {"doc": pa.int64(), "label": pa.int64(), "h": pa.int64(), "lo": pa.int32(), "key": pa.binary(), "words": pa.binary()}
        out: dict[str, list] = {name: [] for name in kinds}

        def table():
            batch = pa.RecordBatch.from_arrays([pa.array(v, kinds[name]) for name, v in out.items()], list(out))
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            docs, labels, texts, spots = batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3)
            for i, (doc, label, text) in enumerate(zip(docs, labels, texts)):
                split = (text or b"").split()
                for place in spots[i].as_py():
                    passage = b" ".join(split[place["lo"] : place["hi"] + window])
                    for name, value in zip(out, (doc, label, place["h"], place["lo"], hashlib.md5(passage).digest(), passage)):
                        out[name].append(value)
                if len(out["doc"]) > 10_000:
                    yield table()
        if out["doc"]:
            yield table()

    return run


class Automaton:
    """The suffix automaton of several word sequences. ``first`` of a state is the least label of the sequences that its
    strings occur in (after ``close``)."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [np.inf]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(np.inf)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for p's longest string followed by c, where q has longer ones too."""
        move, link, length = self.next, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        copy = self._state(length[p] + 1, link[q], dict(move[q]))
        link[q] = copy
        while p >= 0 and move[p].get(c) == q:
            move[p][c] = copy
            p = link[p]
        return copy

    def add(self, symbols, label: int) -> None:
        move, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            q = move[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new, p = self._state(length[last] + 1, 0, {}), last
                while p >= 0 and c not in move[p]:
                    move[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, c, move[p][c])
                last = new
            if label < self.first[last]:
                self.first[last] = label

    def close(self) -> None:
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.first[v] < self.first[up]:
                self.first[up] = self.first[v]

    def owners(self, symbols, window: int):
        """For each window of the symbols that the automaton knows: its start and its first label."""
        move, link, length, first = self.next, self.link, self.length, self.first
        v = matched = 0
        for i, c in enumerate(symbols):
            while v and c not in move[v]:
                v = link[v]
                matched = length[v]
            if c in move[v]:
                v = move[v][c]
                matched += 1
            if matched >= window:
                while length[link[v]] >= window:
                    v = link[v]
                    matched = length[v]
                yield i - window + 1, int(first[v])


def match_shard(window: int):
    """Function over one shard: spans of each passage that begin in a document before the passage's own first one."""

    def run(table):
        symbols: dict[bytes, int] = {}
        heads, words = table.column("first").to_pylist(), table.column("words").to_pylist()
        coded = [[symbols.setdefault(w, len(symbols)) for w in x.split(b" ")] for x in words]
        automaton = Automaton()
        for head, code in zip(heads, coded):
            automaton.add(code, head)
        automaton.close()
        rows, start, end, owner = [], [], [], []
        for i, (own, code) in enumerate(zip(heads, coded)):
            at = None
            for begin, head in automaton.owners(code, window):
                if head >= own:
                    at = None
                elif at is not None and head == owner[-1] and begin <= end[-1]:
                    end[-1] = begin + window
                    at = begin
                else:
                    rows.append(i)
                    start.append(begin)
                    end.append(begin + window)
                    owner.append(head)
                    at = begin
        taken = table.select(["h", "key"]).take(pa.array(rows, pa.int64()))
        return pa.table({"h": taken.column("h"), "key": taken.column("key"), "start": pa.array(start, pa.int32()), "stop": pa.array(end, pa.int32()), "owner": pa.array(owner, pa.int64())})

    return run


def merge_owned(batches):
    """Arrow function: each passage's spans, of which those of one owner are joined and those that spans of earlier owners
    cover are left out."""
    for batch in batches:
        hs, keys, start, stop, owners = [], [], [], [], []
        for h, key, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            covered: list[list[int]] = []
            for owner, a, b in sorted((s["owner"], s["a"], s["b"]) for s in spans):
                if any(x <= a and b <= y for x, y in covered):
                    continue
                if owners and hs[-1] == h and keys[-1] == key and owners[-1] == owner and start[-1] <= a <= stop[-1]:
                    stop[-1] = max(stop[-1], b)
                else:
                    hs.append(h)
                    keys.append(key)
                    start.append(a)
                    stop.append(b)
                    owners.append(owner)
                near = [c for c in covered if c[0] <= b and a <= c[1]]
                covered = [c for c in covered if c not in near] + [[min([a, *(c[0] for c in near)]), max([b, *(c[1] for c in near)])]]
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(keys, pa.binary()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(owners, pa.int64())], ["h", "key", "start", "stop", "owner"])


def merge_spans(batches):
    """Arrow function: each document's spans as merged ranges, packed as int32 pairs."""
    for batch in batches:
        packed = []
        for spans in batch.column(1).to_pylist():
            out: list[int] = []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            packed.append(np.array(out, np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["s", "spans"])


def strip(batches):
    """Arrow function: id, text, merged spans, carried row -> id, n_words, n_removed, kept_sha256, text without the removed
    words, carried row."""
    for batch in batches:
        counts, removed, digests, left = [], [], [], []
        for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            words = (text or b"").split()
            cut = np.frombuffer(spans, np.int32).reshape(-1, 2) if spans else ()
            kept, at = [], 0
            for a, b in cut:
                kept += words[at:a]
                at = b
            kept += words[at:]
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            left.append(None if text is None else _without(text, cut) if len(cut) else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(left, pa.binary()).cast(pa.string()), batch.column(3)], ["id", "n_words", "n_removed", "kept_sha256", "kept_text", "row"])


def _without(text: bytes, cut) -> bytes:
    """The text without some words and the space before each."""
    words = Words([text], space_table())
    parts, at = [], 0
    for a, b in cut:
        parts.append(text[at : words.start[a] if a else 0])
        at = words.end[min(b, len(words)) - 1]
    parts.append(text[at:])
    return b"".join(p.rstrip(b" \t\n\v\f\r") if i < len(cut) else p for i, p in enumerate(parts))


def repeats(texts: DataFrame, scratch: Scratch, window: int, grams: tuple[int, ...]) -> DataFrame:
    """Spans (doc, label, a, b, owner) of texts (doc, label, text) whose windows all start in a text of the label ``owner``,
    which is before the text's own."""
    gram, level = grams[0], f"{len(grams)}"
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, round(size / (140 if len(grams) > 1 else 7) / BLOCK_SPOTS))  # bytes of text for a passage, about
    filed = texts.select("doc", "text").mapInArrow(frugal(file_spots(window, gram, blocks)), "block long, data binary").repartition(blocks, "block")
    spots = scratch.write(filed.mapInArrow(frugal(shared_spots), "doc long, h long, lo int, hi int"), f"spots-{level}")
    places = scratch.write(spots.distinct().groupBy("doc").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("places")), f"places-{level}")
    cut = texts.join(places.hint("merge"), "doc").select("doc", "label", "text", "places").mapInArrow(frugal(cut_passages(window)), "doc long, label long, h long, lo int, key binary, words binary")
    passages = scratch.write(cut, f"passages-{level}")
    distinct = scratch.write(passages.groupBy("h", "key", "words").agg(F.min("label").alias("first")), f"distinct-{level}")
    many = scratch.write(distinct.groupBy("h").count().filter(F.col("count") > SHARD_PASSAGES).select("h"), f"many-{level}")
    deeper = len(grams) > 1 and not many.isEmpty()
    cold = distinct.join(many, "h", "left_anti") if deeper else distinct
    shards = max(1, round(distinct.count() / SHARD_PASSAGES))
    found = cold.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInArrow(frugal_group(match_shard(window)), "h long, key binary, start int, stop int, owner long")
    found = scratch.write(found, f"found-{level}")
    if deeper:
        hot = distinct.join(many, "h").select(F.xxhash64("h", "key").alias("doc"), F.col("first").alias("label"), F.col("words").alias("text"), "h", "key")
        hot = scratch.write(hot, f"hot-{level}")
        inner = repeats(hot.select("doc", "label", "text"), scratch, window, grams[1:])
        inner = inner.join(hot.select("doc", "h", "key"), "doc").groupBy("h", "key").agg(F.collect_list(F.struct("a", "b", "owner")).alias("spans"))
        inner = inner.mapInArrow(frugal(merge_owned), "h long, key binary, start int, stop int, owner long")
        found = found.unionByName(scratch.write(inner, f"inner-{level}"))
    # A passage is a repeat as a whole in all documents but its first.
    whole = distinct.select("h", "key", F.lit(0).alias("start"), F.size(F.split(F.col("words").cast("string"), " ")).alias("stop"), F.col("first").alias("owner"))
    hits = passages.select("doc", "label", "h", "lo", "key").join(found.unionByName(whole), ["h", "key"]).filter("owner < label")
    out = hits.select("doc", "label", (F.col("lo") + F.col("start")).alias("a"), (F.col("lo") + F.col("stop")).alias("b"), "owner").distinct()
    out = scratch.write(out, f"repeats-{level}")
    scratch.drop(*(f"{name}-{level}" for name in ("spots", "places", "passages", "distinct", "many", "found", "hot", "inner")))
    return out


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Per row: the id, n_words, n_removed, kept_sha256 (kept words joined by one space) and kept_text (the text without the
    removed words); with ``carry`` also ``row``, a struct of these columns of docs. Places and spans, which grow with the texts,
    are joined to these by a shuffle at every size."""
    scratch = Scratch(docs.sparkSession, "substring")
    row = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    texts = docs.select(F.col(id_col).cast("long").alias("label"), F.col(text_col).alias("text"), row.alias("row"))
    texts = texts.withColumn("doc", F.xxhash64("label", "text"))
    levels = tuple(g for g in ANCHOR_WORDS if g < min_words) + (min_words,)
    found = repeats(texts.filter("label is not null and text is not null").select("doc", "label", "text"), scratch, min_words, levels)
    spans = found.groupBy(F.struct("doc", "label").alias("s")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = scratch.write(spans.mapInArrow(frugal(merge_spans), "s struct<doc:long,label:long>, spans binary"), "spans")
    scratch.drop(*(f"repeats-{k + 1}" for k in range(len(levels))))
    out = texts.join(spans.select("s.doc", "s.label", "spans").hint("merge"), ["doc", "label"], "left").select("label", "text", "spans", "row")
    schema = T.StructType.fromDDL("id long, n_words long, n_removed long, kept_sha256 string, kept_text string").add("row", out.schema["row"].dataType)
    out = out.mapInArrow(frugal(strip), schema).withColumnRenamed("id", id_col)
    return out if carry else out.drop("row")

"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at ASCII white space, which this kind of tokenizer drops and never encodes across, so that counts add up.
Where a text has only characters on which the tokenizer's normalizer and splitter are known to act letter by letter
(printable ASCII and the letters of Latin-1), it is split further into the tokenizer's own pieces. Each new word or piece is
encoded by the library, in batches balanced by bytes; known ones are counted from a table of bounded size. Words with other
characters, and texts with an added special token, go to the library as they are.

The pieces are those of one kind of tokenizer, which the file must name (``KNOWN_KIND``); with any other file the library encodes
whole texts, in batches balanced by bytes.

Results: null texts count as empty (0 bytes, 0 tokens); repeated rows are counted alike; extra columns are left alone."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import frugal

#: Entries of the table of known pieces, and bytes of one encoding batch.
KNOWN, BATCH_BYTES = 400_000, 1_000_000
#: The tokenizer's splitter for lower-case text of plain characters.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SPACES = re.compile(r"[\t-\r ]+")
#: What the file says of such a tokenizer: the normalizer's steps and the splitter's.
KNOWN_KIND = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)


def kind_of(path: str) -> tuple:
    """The normalizer's and the splitter's steps, as a tokenizer's file gives them."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    steps = lambda part, name: [] if part is None else part[name] if part["type"] == "Sequence" else [part]
    return steps(told["normalizer"], "normalizers"), steps(told["pre_tokenizer"], "pretokenizers")


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.plain = kind_of(path) == KNOWN_KIND

    def encode(self, pieces: list[str]) -> None:
        """Adds the lengths of new pieces, batch by batch of about equal bytes."""
        batch, size = [], 0
        for piece in pieces:
            batch.append(piece)
            size += len(piece)
            if size > BATCH_BYTES:
                self._add(batch)
                batch, size = [], 0
        self._add(batch)

    def _add(self, batch: list[str]) -> None:
        self.known.update(zip(batch, map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))))

    def pieces(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return PIECE.findall(text.lower())
        out = []
        for word in SPACES.split(text):
            if not word:
                continue
            if PLAIN.fullmatch(word) and not any(s in word for s in self.special):
                out += PIECE.findall(word.lower())
            else:
                out.append(word)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.plain:
            return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = set().union(*split)
        self.encode(sorted(new))
        return [sum(map(self.known.__getitem__, p)) for p in split]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit. ``path``: the tokenizer's file, on every executor."""

    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            group, size = [], 0
            for text in texts:
                group.append(text)
                size += len(text)
                if size > BATCH_BYTES:
                    counts += counter.counts(group)
                    group, size = [], 0
            counts += counter.counts(group) if group else []
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n > limit)], ["id", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = rows.select(F.struct("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b")).alias("id"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    out = sized.mapInArrow(frugal(run), f"id struct<id:{kind},b:long>, n_tokens long, over_limit boolean")
    return out.select(F.col("id.id").alias(id_col), F.col("id.b").alias("n_bytes"), "n_tokens", "over_limit")

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets; the spans of the turns to be learned, sorted, are
intersected with the token spans by binary search. The template's marks are added to the tokenizer as special tokens, so no
token reaches over a mark, and marks inside texts are escaped, reversibly: every mark in a text gets an escape character
after its first character, and escape characters are doubled.

Rows of a conversation are sorted within a partition and streamed; a conversation longer than ``part_chars`` comes out in
parts, cut between turns, so no conversation has to fit in memory. Results: null texts and roles are empty; rows with a null
conversation id form one conversation; ties of (turn) are ordered by role and text; repeated rows are turns of their own."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import frugal

ESCAPE = "\x1b"
SCHEMA = "conv_id {kind}, part int, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


@dataclass(frozen=True)
class Template:
    """Marks before the role, between role and text, and after the text; ``learned``: the roles under the loss mask."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    done: str = "<|done|>"
    learned: frozenset = frozenset({"assistant"})
    others: tuple[str, ...] = ("</s>", "[INST]", "[/INST]")
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        controls = (self.turn, self.says, self.done, *self.others)
        for a in controls:
            for b in controls:
                if a != b and a in b or any(b.startswith(a[i:]) for i in range(1, len(a))) or len(a) < 2:
                    raise ValueError(f"marks must not overlap: {a} {b}")
        object.__setattr__(self, "controls", controls)

    def escape(self, text: str) -> str:
        pattern = "|".join(map(re.escape, (ESCAPE, *self.controls)))
        return re.sub(pattern, lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + "." + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(ESCAPE + "(.)", lambda m: ESCAPE if m[1] == ESCAPE else "", text, flags=re.S)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the sorted spans of learned texts."""
        out, at, spans = [], 0, []
        for role, text in turns:
            head, body = self.turn + self.escape(role) + self.says, self.escape(text)
            if role in self.learned and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.done]
            at += len(head) + len(body) + len(self.done)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        turns = []
        for piece in formatted.split(self.turn)[1:]:
            role, _, rest = piece.partition(self.says)
            turns.append((self.unescape(role), self.unescape(rest.removesuffix(self.done))))
        return turns


def loss_mask(spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens that share a character with a span."""
    if not spans:
        return np.zeros(len(start), bool)
    low, high = np.array(spans).T
    at = np.searchsorted(high, start, side="right")
    return (at < len(spans)) & (low[np.minimum(at, len(spans) - 1)] < end) & (end > start)


def load(path: str, template: Template):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (template.turn, template.says, template.done)])
    return tokenizer


def format_chats(conversations: DataFrame, path: str, *, template: Template = Template(), part_chars: int = 1_000_000, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation and part: formatted text, token ids, offsets in characters and loss mask."""

    def encode(tokenizer, held):
        texts, spans = zip(*(template.render(turns) for _, _, turns in held))
        found = tokenizer.encode_batch(list(texts), add_special_tokens=False)
        ids, starts, stops, masks = [], [], [], []
        for e, s in zip(found, spans):
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            ids.append(e.ids)
            starts.append(offsets[:, 0].astype(np.int32))
            stops.append(offsets[:, 1].astype(np.int32))
            masks.append(loss_mask(s, offsets[:, 0], offsets[:, 1]))
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], kind), pa.array([h[1] for h in held], pa.int32()), pa.array([len(h[2]) for h in held], pa.int64()), pa.array(texts), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], ["conv_id", "part", "n_turns", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])

    def run(batches):
        tokenizer = load(path, template)
        held, size = [], 0
        last, part, turns, chars = (), 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (conv,) != last or chars > part_chars:
                    if turns:
                        held.append((last[0], part, turns))
                        size += chars
                        if size > part_chars:
                            yield encode(tokenizer, held)
                            held, size = [], 0
                    part = part + 1 if (conv,) == last else 0
                    last, turns, chars = (conv,), [], 0
                turns.append((role or "", text or ""))
                chars += len(turns[-1][1]) + 32
        if turns:
            held.append((last[0], part, turns))
        if held:
            yield encode(tokenizer, held)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(conversations.schema[id_col].dataType)
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(frugal(run), SCHEMA.format(kind=conversations.schema[id_col].dataType.simpleString()))


def digest(formatted: DataFrame, *, template: Template = Template()) -> DataFrame:
    """Read back from the output of ``format_chats``, part by part as it comes: turns and learned text of each
    conversation, as counts and digests."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(formatted.schema["conv_id"].dataType)

    def run(batches):
        last, state, done = (), None, []

        def table():
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2].hexdigest() for d in done], pa.string()), pa.array([d[3] for d in done], pa.int64()), pa.array([d[4].hexdigest() for d in done], pa.string()), pa.array([d[5] for d in done], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "token_starts", "token_ends", "loss_mask")]
            for conv, text, starts, stops, mask in zip(*columns):
                if (conv,) != last:
                    if state:
                        done.append(state)
                    last, state = (conv,), [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                runs: list[list[int]] = []
                for a, b, m in zip(starts, stops, mask):
                    if m:
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                for a, b in runs:
                    learned = template.unescape(text[a:b])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            if len(done) > 2000:
                yield table()
                done = []
        if state:
            done.append(state)
        if done:
            yield table()

    return formatted.mapInArrow(frugal(run), f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

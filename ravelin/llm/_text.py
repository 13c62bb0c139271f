"""Words, 64-bit word hashes and hashes of word sequences, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U8 = np.uint64
#: Odd multipliers of the two polynomial hashes, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of text handled at once (a longer text is handled alone), and bytes of words hashed at once.
CHUNK_BYTES, HASH_BYTES = 2_000_000, 1 << 17

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def space_table() -> np.ndarray:
    """True for the bytes that part words: space and \\x09-\\x0D."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, HASH_BYTES)

        def run(b: int) -> np.ndarray:
            steps = np.full(size, b, U8)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        have = run(base), run(pow(base, -1, 1 << 64))
        if size <= CHUNK_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U8(33))
    h = h * U8(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U8(33))
    h = h * U8(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U8(33))


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one text."""
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class Words:
    """The words of some texts. ``first[d]:first[d + 1]`` are the words of text d; ``start``/``end`` are byte places in
    ``joined`` and ``base[d]`` is where text d starts in it."""

    def __init__(self, texts: list[bytes | None], spaces: np.ndarray):
        texts = [t or b"" for t in texts]
        self.joined = b" ".join(texts) + b" "
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])
        raw = np.frombuffer(self.joined, np.uint8)
        gap = np.ones(len(raw) + 1, bool)
        gap[1:] = spaces[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self.raw = raw

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self), U8)
        k = 0
        while k < len(out):
            stop = max(k + 1, int(np.searchsorted(self.start, self.start[k] + HASH_BYTES)))
            low = self.start[k]
            start, end = self.start[k:stop] - low, self.end[k:stop] - low
            up, down = powers(BYTE_BASE, int(end[-1]))
            run = np.zeros(end[-1] + 1, U8)
            np.cumsum((self.raw[low : low + end[-1]].astype(U8) + U8(1)) * up, out=run[1:])
            out[k:stop] = mix((run[end] - run[start]) * down[start] + (end - start).astype(U8))
            k = stop
        return out


def running(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``sequence`` takes the hash of any run of words."""
    up, _ = powers(WORD_BASE, max(1, len(hashes)))
    run = np.zeros(len(hashes) + 1, U8)
    np.cumsum(hashes * up[: len(hashes)], out=run[1:])
    return run


def sequence(run: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """The hash of the words start..start+length-1; runs of different lengths differ."""
    _, down = powers(WORD_BASE, len(run))
    length = np.asarray(length)
    return mix((run[start + length] - run[start]) * down[start] + length.astype(U8) * U8(0x2545F4914F6CDD1D))

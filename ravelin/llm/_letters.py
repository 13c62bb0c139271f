"""Texts as arrays of lower-case letters with one space between words."""

from __future__ import annotations

import numpy as np

SPACE = 32


def letter_table() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(texts: list[str | None], table: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' letters one after the other, each text after ``pad`` spaces and before one; and where each begins.
    Letters beyond the basic plane become one symbol, U+FFFF."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = table[np.minimum(code, 0xFFFF)]
    symbol[code > 0xFFFF] = 0
    for i in np.flatnonzero(code > 0xFFFF):
        if chr(code[i]).isalpha():
            symbol[i] = 0xFFFF
    sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    stop = np.cumsum(sizes + 1) - 1  # the line feed after each text
    keep = symbol > 0
    keep[1:] |= keep[:-1]  # the first gap after a letter
    keep[0] = symbol[0] > 0
    keep[stop] = False
    symbol = np.where(symbol > 0, symbol, SPACE)
    count = np.diff(np.concatenate([[0], np.cumsum(keep)[stop]]))
    symbol = symbol[keep]
    out = np.full(len(symbol) + (pad + 1) * len(texts), SPACE, np.uint16)
    begin = np.cumsum(count + pad + 1) - (count + pad + 1)
    shift = np.repeat(begin + pad - (np.cumsum(count) - count), count)
    out[np.arange(len(symbol)) + shift] = symbol
    return out, begin

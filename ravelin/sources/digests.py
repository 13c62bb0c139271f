"""SHA-256 over bytes that no one task sees whole: the state after one part goes to the task that takes the next."""

from __future__ import annotations

import ctypes
import ctypes.util

#: OpenSSL's SHA256_CTX: 28 words of 32 bits (chaining value, length, pending block, its length and the digest's), without pointers.
STATE_BYTES = 112

_library: list = []


def library() -> ctypes.CDLL:
    """The OpenSSL that hashlib is linked with, or the system's; hashlib itself hands out no state."""
    if not _library:
        import _hashlib

        for name in (_hashlib.__file__, ctypes.util.find_library("crypto")):
            try:
                found = ctypes.CDLL(name)
                for function, kinds in (("SHA256_Init", [ctypes.c_void_p]), ("SHA256_Update", [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]), ("SHA256_Final", [ctypes.c_char_p, ctypes.c_void_p])):
                    getattr(found, function).argtypes = kinds
            except (OSError, AttributeError, TypeError):
                continue
            _library.append(found)
            break
        else:
            raise RuntimeError("no OpenSSL with SHA256_Update: a digest cannot be carried from task to task")
    return _library[0]


class Sha256:
    """Like ``hashlib.sha256``, from a ``state`` that another one had."""

    def __init__(self, state: bytes | None = None):
        self._held = ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None and not library().SHA256_Init(self._held):
            raise RuntimeError("SHA256_Init failed")

    def update(self, data: bytes) -> None:
        if not library().SHA256_Update(self._held, data, len(data)):
            raise RuntimeError("SHA256_Update failed")

    @property
    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        copy, out = ctypes.create_string_buffer(self.state, STATE_BYTES), ctypes.create_string_buffer(32)
        if not library().SHA256_Final(out, copy):
            raise RuntimeError("SHA256_Final failed")
        return out.raw.hex()

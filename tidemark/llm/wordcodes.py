"""Words of texts as 64-bit codes, computed on whole Arrow buffers with numpy."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

CHUNK = 1 << 20
LONG_WORD = 1 << 16


def _byte_table(kind: str) -> np.ndarray:
    """Byte to lower-case byte, 0 for bytes between words."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    if kind == "alnum":  # digits, letters, all beyond ASCII
        out[[i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)]] = 0
    elif kind == "blank":  # all but blanks
        out[[32, 9, 10, 11, 12, 13]] = 0
        out[0] = 128  # a null byte is part of a word; a lone 128 occurs in no UTF-8 text as a first byte
    else:
        raise ValueError(kind)
    return out


TABLES = {k: _byte_table(k) for k in ("alnum", "blank")}
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    steps = np.full(CHUNK + LONG_WORD + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts, in order: text number, code, and their bytes' place."""

    data: np.ndarray  # lower-cased bytes, 0 between words
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray  # for each text its first word; one more at the end

    def raw(self, a: int, b: int) -> bytes:
        """Bytes of words a to b (exclusive), joined by blanks."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each text's offsets; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def split(column: pa.Array, kind: str) -> Words:
    raw, offsets = text_buffers(column)
    data = TABLES[kind][raw]
    word = data != 0
    n = len(data)
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    close = word.copy()
    close[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # neighbouring texts touch in the buffer
    begin[edges] = word[edges]
    close[edges - 1] = word[edges - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(close) + 1
    return Words(data, start, end, _codes(data, start, end), np.searchsorted(start, offsets, "left"))


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    cache = worker_cache()
    if "powers" not in cache:
        cache["powers"] = _powers(_BASE), _powers(_INVERSE)
    up, down = cache["powers"]
    length = end - start
    code = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK, "left")))
        a, b = int(start[i]), int(min(end[j - 1], start[i] + CHUNK + LONG_WORD))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[data[a:b]] * up[: b - a], out=total[1:])
        s, e = start[i:j] - a, np.minimum(end[i:j], b) - a
        code[i:j] = (total[e] - total[s]) * down[s]
        i = j
    for k in np.flatnonzero(length > LONG_WORD):
        code[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(code ^ (length.astype(np.uint64) << np.uint64(40)))

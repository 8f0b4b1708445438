"""Letter trigrams of any script: hashed counts, and the likelihood of texts in blocks of languages.

A text is its lower-case code points, with one gap between words; marks that belong to letters count as
letters.  P(c | a, b) is backed off to P(c | b), P(c) and a uniform one, from counts in hashed tables; an
entry that collides is at most as frequent as its context.  The hypothesis that a text is in none of the
languages draws letters one by one, from the pool of all languages and, in part, from all of Unicode.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .common import worker_cache

BITS = (18, 16, 12)  # of the tables of trigrams, bigrams and letters
START = (0, 1 << BITS[0], (1 << BITS[0]) + (1 << BITS[1]))  # of each table, if they stand in a row
SIZE = START[2] + (1 << BITS[2])
WEIGHT = np.float32(5.0)  # pseudo counts that a shorter context counts for
UNIFORM = np.float32(1 / 4096)  # of a letter that no text of a language has
STRANGE = 0.1  # share of letters that the pool does not know
PIECE = 1 << 13  # trigrams that are looked up at once
ASSIGNED = 0x40000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _classes() -> np.ndarray:
    """For each code point 2 for letters, 1 for marks of letters, 0 for others."""
    cache = worker_cache()
    if "letter_classes" not in cache:
        out = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(ASSIGNED)], np.uint8)
        out[0xFE00:0xFE10] = out[0x20D0:0x2100] = 0  # variants and frames of symbols
        cache["letter_classes"] = out
    return cache["letter_classes"]


def codes(text: str) -> tuple[np.ndarray, int]:
    """Code points with a gap (0) at each end, runs of gaps as one, and how many letters there are."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[np.minimum(points, ASSIGNED - 1)]
    out = np.where(kind > 0, points, 0).astype(np.uint64)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] > 0) | (out[:-1] > 0)
    return out[keep], int(np.count_nonzero(kind == 2))


def _hash(bits: int, *parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p, m in zip(parts, _MIX, strict=False):
        h += (p + np.uint64(1)) * m
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    """Places in the tables of all trigrams, bigrams and letters of a text; a place occurs as often as they do."""
    c = codes(text)[0]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    return np.concatenate([
        _hash(BITS[0], c[:-2], c[1:-1], c[2:]) + START[0], _hash(BITS[1], c[:-1], c[1:]) + START[1], _hash(BITS[2], c) + START[2],
    ])


class Block:
    """Tables of some languages; a row is a place, a column a language."""

    def __init__(self, languages: list[tuple[np.ndarray, np.ndarray]]):
        self.size = len(languages)
        self.tables = np.zeros((SIZE, self.size), np.float32)
        for i, (place, n) in enumerate(languages):
            self.tables[place, i] = n
        letters = self.tables[START[2] :]
        # a uniform part for letters that do not occur
        self.single = (letters + WEIGHT * UNIFORM) / (letters.sum(axis=0, keepdims=True) + WEIGHT)

    def score(self, c: np.ndarray) -> np.ndarray:
        """The log probability of a sequence of codes in each language."""
        out = np.zeros(self.size)
        for i in range(0, max(0, len(c) - 2), PIECE):
            x, y, z = c[i : i + PIECE], c[i + 1 : i + 1 + PIECE], c[i + 2 : i + 2 + PIECE]
            x, y = x[: len(z)], y[: len(z)]
            one, ones = _hash(BITS[2], z), self.tables[_hash(BITS[2], y) + START[2]]
            two, twos = self.tables[_hash(BITS[1], y, z) + START[1]], self.tables[_hash(BITS[1], x, y) + START[1]]
            three = self.tables[_hash(BITS[0], x, y, z)]
            p = (np.minimum(two, ones) + WEIGHT * self.single[one]) / (ones + WEIGHT)
            p = (np.minimum(three, twos) + WEIGHT * p) / (twos + WEIGHT)
            out += np.log(p).sum(axis=0, dtype=np.float64)
        return out


def letters(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The letter counts among a language's counts."""
    out = np.zeros(1 << BITS[2])
    out[place[place >= START[2]] - START[2]] = n[place >= START[2]]
    return out


def pool(singles: list[np.ndarray]) -> np.ndarray:
    """Log probabilities of letters in no language, from the letter counts of each."""
    shares = [s / s.sum() for s in singles if s.sum()]
    known = np.mean(shares, axis=0) if shares else np.zeros(1 << BITS[2])
    return np.log((1 - STRANGE) * known + STRANGE * float(UNIFORM))


def score_none(c: np.ndarray, pooled: np.ndarray) -> float:
    return float(pooled[_hash(BITS[2], c[2:])].sum()) if len(c) > 2 else 0.0

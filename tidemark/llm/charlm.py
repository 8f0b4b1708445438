"""Character trigrams over a small alphabet: counting in numpy, and smoothed log probabilities."""

from __future__ import annotations

import numpy as np

# Letters of the alphabet in natural order; 0 is the gap between words, the last code any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäåæçèéêëìíîïñòóôöøùúûüýœ"
SIZE = 64
GAP, OTHER = 0, SIZE - 1
GRAMS = SIZE**3
SMOOTHING = 0.1


def _table() -> np.ndarray:
    out = np.zeros(0x250, np.uint32)
    for cp in range(0x250):
        c = chr(cp)
        low = c.lower()
        out[cp] = LETTERS.index(low) + 1 if len(low) == 1 and low in LETTERS else OTHER if c.isalpha() else GAP
    return out


CODES = _table()


def codes(text: str) -> np.ndarray:
    """The text's codes, with a gap at each end; runs of gaps are one gap."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    out = CODES[np.minimum(points, 0x24F)]
    out[points >= 0x250] = OTHER
    gap = out == GAP
    keep = np.ones(len(out), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return out[keep]


def grams(text: str) -> np.ndarray:
    c = codes(text)
    return (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:] if len(c) > 2 else np.zeros(0, np.uint32)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) for each trigram, backed off to P(c | b) by a few pseudo counts."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    two = three.sum(axis=0)
    lower = (two + SMOOTHING) / (two.sum(axis=1, keepdims=True) + SMOOTHING * SIZE)
    weight = 5.0
    p = (three + weight * lower[None]) / (three.sum(axis=2, keepdims=True) + weight)
    return np.log(p).astype(np.float32).reshape(-1)

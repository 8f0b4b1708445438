"""Both tokenizers' view of atoms: stretches of a text that begin at a blank after a sign that is no blank.

Neither vocabulary has a piece that holds a blank behind something else, so no token of either crosses
the start of an atom, and the ids of a text are those of its atoms in a row.  Each different atom is
encoded once and looked up.  An atom is named by its text without the blank it begins with; the blank
before the whole text, which both encodings have, is that of its first atom.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

CACHED_ATOMS = 300_000
CACHED_IDS = 2_000_000
LEARNED = 20_000  # atoms encoded in one call
BLANK = "▁"  # the second vocabulary's sign for a blank
# A blank behind another blank or at the start of a text begins no atom.
_ATOM = re.compile(r"(?<=\S) ")
_ODD = r"(^|[\s\x0B\x1C-\x1F\x{85}\p{Z}]) "


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """The two tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = byte_level()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t in names]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.length_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.length_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.blank = self.b.piece_to_id(BLANK)

    def encode(self, atoms: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By both tokenizers: the ids of all atoms in a row, and how many each has."""
        made = self.a.encode([f" {x}" for x in atoms], is_pretokenized=True, add_special_tokens=False)
        first = np.array(made.ids, np.int64), np.bincount(np.array(made.word_ids, np.int64), minlength=len(atoms))
        second = [x or [self.blank] for x in self.b.encode(atoms, num_threads=1)]
        return [first, (np.array([i for x in second for i in x], np.int64), np.array(list(map(len, second)), np.int64))]


def group_sizes(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where both end, and the tokens of each up to there since the last such place."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    count = lambda ends: np.diff(np.searchsorted(ends, common, "right"), prepend=0)
    return common, count(ends_a), count(ends_b)


def group_texts(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[str]:
    """Each group as decimal ids."""
    ids_a, ids_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for m, n in zip(sizes_a.tolist(), sizes_b.tolist(), strict=True):
        if m == 1 and n == 1:
            out.append(f"{ids_a[i]}|{ids_b[j]}")
        else:
            out.append(",".join(ids_a[i : i + m]) + "|" + ",".join(ids_b[j : j + n]))
        i, j = i + m, j + n
    return out


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)


FIELDS = ("a", "b", "sizes_a", "sizes_b")


class Atoms:
    """Atoms met by a worker: their ids, the tokens of both in each of their groups, and the groups as text.

    Atoms have numbers; numbers hold until the next look-up.  An atom whose bytes do not come back is broken.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        cache = worker_cache()
        name = f"atoms {path_a} {path_b}"
        if name not in cache:
            cache[name] = Pair(path_a, path_b)
        self.pair: Pair = cache[name]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.broken = np.zeros(0, bool)
        self.values = {f: np.zeros(0, np.uint32) for f in FIELDS}
        self.first = {f: np.zeros(1, np.int64) for f in FIELDS}

    def look_up(self, names: list[str]) -> np.ndarray:
        """Numbers of different atoms."""
        if len(self.number) > CACHED_ATOMS or len(self.values["a"]) > CACHED_IDS:
            self.clear()
        new = [x for x in names if x not in self.number]
        for at in range(0, len(new), LEARNED):
            self._learn(new[at : at + LEARNED])
        return np.array([self.number[x] for x in names], np.int64)

    def count(self, field: str, code: np.ndarray) -> np.ndarray:
        return self.first[field][code + 1] - self.first[field][code]

    def gather(self, field: str, code: np.ndarray) -> np.ndarray:
        """The field's values of a row of atoms."""
        return self.values[field][ragged(self.first[field][code], self.count(field, code))]

    def _learn(self, names: list[str]) -> None:
        pair = self.pair
        data = [f" {x}".encode() for x in names]
        ids = pair.encode(names)
        tables, lengths = (pair.bytes_a, pair.bytes_b), (pair.length_a, pair.length_b)
        size = np.array(list(map(len, data)), np.int64)
        broken = np.zeros(len(names), bool)
        if any(b"".join(map(t.__getitem__, flat.tolist())) != b"".join(data) for t, (flat, _) in zip(tables, ids, strict=True)):
            for t, (flat, n) in zip(tables, ids, strict=True):
                ends = np.cumsum(n).tolist()
                broken |= [b"".join(map(t.__getitem__, flat[e - k : e].tolist())) != d for e, k, d in zip(ends, n.tolist(), data, strict=True)]
            ids = [(flat[np.repeat(~broken, n)], np.where(broken, 0, n)) for flat, n in ids]
        common, sizes_a, sizes_b = group_sizes(*(np.cumsum(length[flat]) for length, (flat, _) in zip(lengths, ids, strict=True)))
        groups = np.diff(np.searchsorted(common, np.cumsum(np.where(broken, 0, size)), "right"), prepend=0)
        texts, ends = group_texts(ids[0][0], ids[1][0], sizes_a, sizes_b), np.cumsum(groups).tolist()
        self.text += [texts[e - 1] if k == 1 else ";".join(texts[e - k : e]) for e, k in zip(ends, groups.tolist(), strict=True)]
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names)), strict=True))
        self.broken = np.concatenate([self.broken, broken])
        for f, values, n in zip(FIELDS, (ids[0][0], ids[1][0], sizes_a, sizes_b), (ids[0][1], ids[1][1], groups, groups), strict=True):
            self.values[f] = np.concatenate([self.values[f], values.astype(np.uint32)])
            self.first[f] = np.concatenate([self.first[f], self.first[f][-1] + np.cumsum(n)])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Names of the atoms of texts, all in a row, and how many each text has; null and empty texts have none."""
    count = np.zeros(len(texts), np.int64)
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    odd = pc.and_(some, pc.fill_null(pc.match_substring_regex(texts, _ODD), False))
    plain = pc.and_(some, pc.invert(odd)).to_numpy(zero_copy_only=False)
    odd = odd.to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts.take(pa.array(np.flatnonzero(plain))), " ")
    count[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    cut = [_ATOM.split(t) for t in texts.take(pa.array(np.flatnonzero(odd))).to_pylist()]
    count[odd] = [len(x) for x in cut]
    flat = pc.list_flatten(lists)
    if cut:  # bring the pieces in the order of the texts
        flat = pa.concat_arrays([flat, pa.array([x for part in cut for x in part], flat.type)])
        owner = np.concatenate([np.repeat(np.flatnonzero(plain), count[plain]), np.repeat(np.flatnonzero(odd), count[odd])])
        flat = flat.take(pa.array(np.argsort(owner, kind="stable")))
    return flat, count

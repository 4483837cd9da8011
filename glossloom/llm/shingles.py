"""Word hashes, shingle sets and minwise sketches of whole texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

#: Words whose hashes a worker keeps.
CACHED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHED:
            self.clear()
        self[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of a text's words (A-Z lower-cased, cut at the six ASCII white-space characters)."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, np.uint64(min(k, len(words))))
    for i in range(min(k, len(words))):
        h = mix(h * _MIX + words[i : i + n] * _TURN)
    return np.unique(h)


def sketch(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """(sets, seeds) least hashes, 32 bits each; all sets must have elements."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), len(seeds)), np.uint32)
    for j, s in enumerate(seeds):
        h = (flat ^ s) * (s | np.uint64(1))
        out[:, j] = np.minimum.reduceat((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(32), at)
    return out


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by key, each whole; a group may lie across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.iloc[a:b]
            if held and held[-1][key].iat[0] != part[key].iat[0]:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


class Sets:
    """Disjoint sets of the numbers 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

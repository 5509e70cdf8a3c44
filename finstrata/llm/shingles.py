"""Word shingles as 64-bit hashes, in NumPy, for the operators that compare texts by them."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word, kept for the words of a task; at ``most`` entries it starts afresh."""

    def __init__(self, most: int = 700_000):
        import xxhash

        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; none if there are fewer."""
    if len(words) < k:
        return words[:0]
    n = len(words) - k + 1
    total = words[:n].copy()
    for i in range(1, k):
        total = total * MIX + words[i : i + n]
    return mixed(total)


def long_windows(words: np.ndarray, k: int) -> np.ndarray:
    """Like windows(), in time that doesn't grow with k: hashes of runs of 2, 4, 8 ... words are combined."""
    if len(words) < k:
        return words[:0]
    runs, size, step = words, 1, MIX  # runs: hashes of the runs of ``size`` words
    total, done = None, 0  # total: hashes of the runs of the first ``done`` of k words
    while size <= k:
        if k & size:
            more = runs[done:]
            n = len(more) if total is None else min(len(total), len(more))
            total = more if total is None else total[:n] * step + more[:n]
            done += size
        if len(runs) > size:
            runs = mixed(runs[:-size] * step + runs[size:])
        size, step = 2 * size, np.uint64((int(step) * int(MIX) | 1) % 2**64)
    return mixed(total[: len(words) - k + 1])


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The set of the k-word shingles, sorted; a text of fewer words is one shingle, an empty one has none."""
    return np.unique(windows(words, min(k, len(words)))) if len(words) else words

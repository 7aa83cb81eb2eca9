"""Word shingles as 64-bit hashes (worker side)."""
from __future__ import annotations

import numpy as np

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; emptied when it holds 200,000 words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(found: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, an empty one has none."""
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = mixed(acc + h[i:len(h) - k + 1 + i])
    return np.unique(acc)

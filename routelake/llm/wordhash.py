"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .parcels import SALT

#: Bytes hashed at a time, so that they stay in a processor's cache.
CHUNK = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CHUNK), _powers(pow(_BASE, -1, 1 << 64), CHUNK)


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class Words:
    """Hashes of all words of the texts in a row, where they stand in buf, and where each text's words start.

    Words are runs without space, tab or the characters to carriage return; with lower, A-Z count as a-z.
    """

    def __init__(self, texts: list[bytes], lower: bool = True) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(lens) - 1
        self.starts = self.ends - lens + 1
        edge = np.diff(np.concatenate([[1], _SPACE[self.buf].view(np.int8)]))
        self.first, self.last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.hash = self._hash()
        self.bounds = np.searchsorted(self.first, np.concatenate([self.starts, [len(self.buf)]]))

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.first), np.uint64)
        at = 0
        while at < len(self.first):
            lo = int(self.first[at])
            upto = max(at + 1, int(np.searchsorted(self.last, lo + CHUNK - 1, side="right")))
            hi = int(self.last[upto - 1])
            if hi - lo < CHUNK:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.buf[lo:hi].astype(np.uint64) + np.uint64(1)) * _UP[: hi - lo], dtype=np.uint64)])
                a, b = self.first[at:upto] - lo, self.last[at:upto] - lo
                out[at:upto] = (sums[b] - sums[a]) * _DOWN[a]
            else:  # a word longer than a chunk
                import hashlib

                out[at] = int.from_bytes(hashlib.blake2b(self.buf[lo:hi].tobytes(), digest_size=8).digest(), "little")
            at = upto
        return finish(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, as far as there are k."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * (SALT[j % len(SALT)] + np.uint64(2 * (j // len(SALT))))
    return finish(out)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct k-word shingles; with fewer words, of all its words in a row."""
    every = grams(words.hash, k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(grams(words.hash[a:b], b - a) ^ SALT[b - a])
        else:
            out.append(np.zeros(0, np.uint64))
    return out

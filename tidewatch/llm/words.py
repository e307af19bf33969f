"""Vectorised words and shingles of text batches (numpy inside Spark tasks).

A word is a maximal run of bytes other than space and \\x09-\\x0D, compared after lower-casing A-Z.  Words and shingles
are handled as 64-bit hashes: the sum of a mixed value of every byte and its place in the word, mixed again.  (A polynomial modulo
2**64 would not do: words built from the Thue-Morse sequence collide under every odd base.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20  # bytes worked on at a time; longer texts are cut between words
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_byte_values = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a polynomial's base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and where they start."""
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate(([True], _space[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    size = end - start
    first = np.cumsum(size) - size  # of each word among the bytes of all words
    place = np.arange(size.sum()) - np.repeat(first, size)
    values = mix(_byte_values[_lower[raw[~gap[1:-1]]]] + place.astype(np.uint64) * _U(_BASE))
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64)), start


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; None is an empty text."""
    batch: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, start = _hash_piece(b" ".join(batch))
        bounds = np.cumsum([0] + [len(b) + 1 for b in batch])
        cut = np.searchsorted(start, bounds)
        for a, b in zip(cut[:-1], cut[1:]):
            yield hashes[a:b]

    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if size + len(data) > PIECE and batch:
            yield from flush()
            batch, size = [], 0
        if len(data) > PIECE:
            yield np.concatenate([_hash_piece(p)[0] for p in pieces(data)])
        else:
            batch.append(data)
            size += len(data) + 1
    if batch:
        yield from flush()


def pieces(data: bytes) -> Iterator[bytes]:
    """Cut a long text between words into pieces of about ``PIECE`` bytes (a longer word stays whole)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _space[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; with fewer words the whole sequence is one; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, _U(size), dtype=np.uint64)
    for k in range(size):
        total = mix(total * _U(_BASE) + words[k : len(words) - size + 1 + k])
    return np.unique(total)

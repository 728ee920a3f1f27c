"""Hashed word shingles of texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8
#: Bytes of text hashed together.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, A-Z as a-z, 0 for white space; and which bytes are white space."""
    value = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    value[space] = 0
    return value, space


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(b: np.ndarray, value: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of some bytes that end in white space; equal words have equal hashes."""
    power, inverse = _powers(max(21, len(b).bit_length()))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space[b]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[b] * power[: len(b)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def shingle_sets(texts: list[str | None], words: int, seed: int = 1) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``words`` words.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. A text with fewer words has its whole
    sequence as its one shingle; one without words has none.
    """
    value, space = _tables(seed)
    weights = np.random.default_rng(seed + 1).integers(1, 1 << 63, words + 1, dtype=np.uint64) * _U(2) + _U(1)
    for raw in _chunks(texts):
        b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        word, starts = word_hashes(b, value, space)
        run = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for j in range(words):
            run += word[j : j + len(run)] * weights[j]
        run = mix(run)
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])).tolist()
        for first, last in zip(bounds, bounds[1:], strict=False):
            if last - first >= words:
                yield np.unique(run[first : last - words + 1])
            elif last > first:
                short = (word[first:last] * weights[: last - first]).sum(keepdims=True, dtype=np.uint64)
                yield mix(short + weights[words:] * _U(last - first))
            else:
                yield np.empty(0, np.uint64)

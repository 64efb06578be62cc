"""Word shingle sets as sorted 64-bit hashes, computed over the bytes of many texts at once.

Words are runs of anything but blanks and the characters 9 to 13, with A-Z lowered. A text of at least `size` words has
the set of its distinct shingles of that many words; one of fewer words has its whole sequence as the only element; one
without words has the empty set.
"""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _words(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash: a polynomial over its bytes, from prefix sums."""
    solid = ~_BLANK[held]
    edges = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[_LOWER[held]] * _powers(_BASE, len(held)), dtype=np.uint64)])
    back = _powers(_BACK, len(held) + 1)
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _sets_of(raw: list[bytes], size: int) -> list[np.ndarray]:
    held = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, words = _words(held)
    first = np.searchsorted(starts, begins)
    whole = words.copy()
    for k in range(1, size):
        left = max(0, len(words) - k)
        whole[:left] = whole[:left] * _BASE + words[k:]
    whole = mix(whole)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in words[a:b]:
                x = x * _BASE + w
            out.append(mix(np.array([x ^ np.uint64(0x5DEECE66D)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    out: list[np.ndarray] = []
    raw: list[bytes] = []
    held = 0
    with np.errstate(over="ignore"):
        for t in texts:
            raw.append(t.encode())
            held += len(raw[-1])
            if held > _CHUNK:
                out += _sets_of(raw, size)
                raw, held = [], 0
        return out + (_sets_of(raw, size) if raw else [])


def names_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of the set."""
    held = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(held[:8], "little", signed=True), int.from_bytes(held[8:], "little", signed=True)

"""Word shingles of whole texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

# A text is lower-cased in A-Z, cut at blanks, and every run of SIZE words is one shingle.
SIZE = 5
GROUP_BYTES = 1 << 20  # texts hashed at once; bounds the arrays alive, but for a longer single text
_rng = np.random.default_rng(20240229)  # fixed: hashes must agree between tasks and runs
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_PLACES = _rng.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        made = np.full(max(n, 1 << 20), base, np.uint64)
        made[0] = 1
        held = np.cumprod(made, dtype=np.uint64)
        if n <= 1 << 22:
            _powers[base] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; a text of fewer words is one shingle, an empty one none."""
    sets, group, size = [], [], 0
    for text in texts:
        data = (text or "").encode()
        if group and size + len(data) > GROUP_BYTES:
            sets += _sets(group)
            group, size = [], 0
        group.append(data)
        size += len(data)
    return sets + _sets(group) if group else sets


def _sets(data: list[bytes]) -> list[np.ndarray]:
    buffer = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    firsts = np.cumsum([0] + [len(d) + 1 for d in data])
    blank = _BLANK[buffer]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    starts, ends = (edge == -1).nonzero()[0], (edge == 1).nonzero()[0]
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * _power(_BASE, len(buffer)), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _power(_INVERSE, len(buffer))[starts]
    words = mixed(words ^ (ends - starts).astype(np.uint64))
    first_word = np.searchsorted(starts, firsts)
    runs = np.zeros(max(len(words) - SIZE + 1, 0), np.uint64)
    for i, place in enumerate(_PLACES):
        runs += words[i : i + len(runs)] * place
    runs = mixed(runs)
    sets = []
    for a, b in zip(first_word, first_word[1:]):
        if b - a >= SIZE:
            sets.append(np.unique(runs[a : b - SIZE + 1]))
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mixed(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()

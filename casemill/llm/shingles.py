"""Hashed word shingles of many texts at once.

Words are the runs of bytes outside 0x20 and 0x09-0x0D after A-Z are lower-cased.  A shingle is hashed to 64 bits from its
words' hashes, so equal shingles always agree and different ones practically never do.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BYTE[0x20] = 0
_PLACE = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's number of words."""
    lines = [b" ".join(t.lower().split()) for t in texts]
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    data = np.frombuffer(b" ".join(x for x in lines if x) + b" ", np.uint8)
    if not counts.any():
        return np.zeros(0, np.uint64), counts
    ends = np.flatnonzero(data == 0x20)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts + 1
    power = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    value = _BYTE[data] * power[np.arange(len(data)) - np.repeat(starts, sizes)]
    return mix(np.add.reduceat(value, starts) ^ (sizes.astype(np.uint64) << np.uint64(48))), counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; of fewer words, the whole sequence as one; none for no words."""
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : len(words) - width + 1 + j] * _PLACE[j] if len(rolled) else rolled
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            found = np.sort(rolled[at : at + n - width + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif n:
            out.append(mix(np.array([(words[at : at + n] * _PLACE[:n]).sum()], np.uint64) ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out

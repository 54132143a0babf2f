"""Words of many texts at once, as places in their UTF-8 bytes, with 64-bit hashes.

Whole texts are read, in pieces of bounded size that are cut between words, so that memory follows the piece and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from casemill.llm.shingles import _BASE, _BYTE, mix

PIECE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of letters, digits and everything beyond ASCII.
TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM[_low : _high + 1] = True


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings (null: empty) and the place where each text begins, with the end at last."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def cuts(data: np.ndarray, inside: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Pieces of about `size` bytes that no word crosses, but for words longer than that, which get a piece as long as they are."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        if end < n:
            gap = np.flatnonzero(~inside[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                while end < n and inside[data[end]]:
                    step = np.flatnonzero(~inside[data[end : end + size]])
                    end = end + int(step[0]) if len(step) else min(end + size, n)
        yield at, end
        at = end


def words(data: np.ndarray, places: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, size, text) of the words, maximal runs of the bytes in `inside` within one text, a piece at a time."""
    for a, b in cuts(data, inside):
        own = np.concatenate(([False], inside[data[a:b]], [False]))
        first = np.zeros(b - a + 1, bool)
        low, high = np.searchsorted(places, (a, b))
        first[places[low:high] - a] = True
        start = np.flatnonzero(own[1:-1] & (first[:-1] | ~own[:-2])) + a
        first[-1] = True
        end = np.flatnonzero(own[1:-1] & (first[1:] | ~own[2:])) + a + 1
        if len(start):
            yield start, end - start, np.searchsorted(places, start, side="right") - 1


def within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of the words, one word after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(int(size.max()), _BASE + np.uint64(2 * salt), np.uint64))
    ends = np.cumsum(size)
    at = within(start, size)
    value = _BYTE[data[at]] * power[at - np.repeat(start, size)]
    return mix(np.add.reduceat(value, ends - size) ^ (size.astype(np.uint64) << np.uint64(48)))

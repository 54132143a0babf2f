"""Column-wise construction of the Burrows-Wheeler transform and common-prefix array of a collection of strings.

Round j inserts the suffix of length j of every string that is long enough, one symbol a string: where it goes follows from the
symbol before the suffix of the round before and that symbol's rank.  A new suffix shares with its neighbours one symbol more
than their tails share, which is a range minimum over the common prefixes of the round before.  Transform and prefixes lie in
two sequential files that each round reads once and writes once; memory holds one round of the block at hand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Files:
    """The two sequential files of a block, in a folder that the caller names; swapped after each round and removed at the end."""

    def __init__(self, fs, stem: str):
        self.fs, self.stem, self.turn = fs, stem, 0

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.turn ^= 1
        for kind, data in (("bwt", bwt), ("lcp", lcp)):
            with self.fs.open_output_stream(f"{self.stem}.{kind}{self.turn}", compression=None) as out:
                out.write(memoryview(data))

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for kind in ("bwt", "lcp"):
            with self.fs.open_input_file(f"{self.stem}.{kind}{self.turn}") as data:
                found.append(np.frombuffer(data.read(), np.uint8))
        return found[0], found[1]

    def remove(self) -> None:
        from casemill.llm.shared import drop

        for kind in ("bwt", "lcp"):
            for turn in (0, 1):
                drop(self.fs, f"{self.stem}.{kind}{turn}")


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]) for each pair; every range has a member."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp(high - low + 1)[1] - 1
    table, k = values, 0
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        now = np.flatnonzero(level == k)
        out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k) + 1])
    return out


def build(strings: list[bytes], most: int, files: Files) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, lcp) of all suffixes in order: whose suffix, how long, and min(most, prefix shared with the one before).

    Ends of strings are distinct and ordered by string, so equal suffixes stand in the order of their strings.  At most 255
    different byte values may occur (UTF-8 has fewer); most is at most 255.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    if len(used) > 255 or most > 255:
        raise ValueError("a symbol must be left for the end, and prefixes must fit a byte")
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    ends = np.cumsum(sizes)
    data = code[data] if m else data

    def symbol(which: np.ndarray, j: int) -> np.ndarray:
        """The (j + 1)th symbol from the right, 0 where the string has no more."""
        there = sizes[which] > j
        out = np.zeros(len(which), np.uint8)
        out[there] = data[ends[which[there]] - 1 - j]
        return out

    active = np.arange(m)
    at = np.arange(m)
    files.write(symbol(active, 0), np.zeros(m, np.uint8))
    for j in range(1, int(sizes.max(initial=0)) + 1):
        bwt, lcp = files.read()
        keep = sizes[active] >= j
        active, at = active[keep], at[keep]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        done = int(np.searchsorted(bwt[order[: m + 1]], 1)) if len(bwt) else 0  # exhausted strings: none has more than one end
        r, c = rank[at], bwt[at]
        before, after = order[r - 1], order[np.minimum(r + 1, len(bwt) - 1)]
        has_before = (r > 0) & (bwt[before] == c)
        has_after = (r + 1 < len(bwt)) & (bwt[after] == c)
        mine, next_ = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
        x = np.flatnonzero(has_before)
        mine[x] = np.minimum(_range_min(lcp, before[x] + 1, at[x]), most - 1) + 1
        x = np.flatnonzero(has_after)
        next_[x] = np.minimum(_range_min(lcp, at[x] + 1, after[x]), most - 1) + 1
        to = m + r - done
        old = np.ones(len(bwt) + len(at), bool)
        old[to] = False
        new_bwt, new_lcp = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        new_bwt[old], new_lcp[old] = bwt, lcp
        new_bwt[to] = symbol(active, j)
        new_lcp[to[has_after] + 1] = next_[has_after]
        new_lcp[to] = mine
        files.write(new_bwt, new_lcp)
        at = to
    bwt, lcp = files.read()
    files.remove()
    # from each string's empty suffix, one symbol longer at each step
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt)) + m - int((bwt == 0).sum())
    string, length = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    active = at = np.arange(m)
    for j in range(int(sizes.max(initial=0)) + 1):
        keep = sizes[active] >= j
        active, at = active[keep], at[keep]
        string[at], length[at] = active, j
        going = sizes[active] > j
        active, at = active[going], rank[at[going]]
    return string, length, lcp


def repeated(strings: list[bytes], doc: np.ndarray, start: np.ndarray, width: int, files: Files, *, build: Callable = build) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every `width`-byte substring that also begins at a smaller (doc, start + offset) of another string."""
    string, length, lcp = build(strings, width, files)
    joined = lcp >= width
    run = np.cumsum(~joined)
    in_run = joined.copy()
    in_run[:-1] |= joined[1:]
    x = np.flatnonzero(in_run)
    s, r = string[x], run[x]
    sizes = np.array([len(t) for t in strings], np.int64)
    offset = sizes[s] - length[x]
    d, p = doc[s], start[s] + offset
    o = np.lexsort((p, d, r))
    s, r, offset, d, p = s[o], r[o], offset[o], d[o], p[o]
    lead = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    first = np.repeat(lead, np.diff(np.append(lead, len(r))))
    late = (d > d[first]) | (p > p[first])
    return s[late], offset[late]

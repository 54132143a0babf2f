"""Hierarchical multi-length packing.

Documents are tokenised, cut at full context windows, and what is left of each is routed to the smallest tier that holds it.
Tiers are packed from the longest down: a window takes one document of its own tier, its gap is filled best-fit with whole
documents of shorter tiers, and the last few places with the head of the shortest one.  What remains when a packing window
runs dry is cut at its binary digits, so every sequence has a length that is a power of two and nothing is padded.  Finished
sequences are dealt to step groups of near-equal attention cost.

The work is one map over the input partitions: no shuffle, no key, and memory bounded by one packing window (or by the
longest document).  A task that runs again rewrites all of its own sequences, so sequences never mix two attempts.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import mapped, slices
from casemill.llm.spans import within

TIERS = (256, 512, 1024, 2048)
#: Words whose ids a task remembers, some 170 bytes each; beyond that it starts anew.
CACHE_WORDS = 400_000
#: Bytes of text that are lists of words at a time.
SLICE_BYTES = 1 << 20
#: Words of letters below U+0250, but for the one whose lower case is longer; marks that may stand behind them.
LATIN = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+$"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What the usual tokenizer does before its merges.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words whose ids are put one after the other at a time.
GATHERED = 1 << 18
WINDOW_TOKENS = 1 << 22
WINDOW_DOCS = 8192
GROUP_SEQUENCES = 32

Piece = tuple[int, int, int]  # document's index in the window, start, length


def plan_window(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences over documents of the given token counts; each token lies in exactly one piece."""
    context = tiers[-1]
    sequences: list[list[Piece]] = []
    pool: list[tuple[int, int, int]] = []  # length, document, start; ascending
    for doc, n in enumerate(lengths):
        cut = n - n % context
        sequences.extend([(doc, at, context)] for at in range(0, cut, context))
        if n > cut:
            pool.append((n - cut, doc, cut))
    pool.sort()
    for tier in reversed(range(len(tiers))):
        window, lower = tiers[tier], tiers[tier - 1] if tier else 0
        while pool and pool[-1][0] > lower:
            n, doc, start = pool.pop()
            row, gap = [(doc, start, n)], window - n
            while gap and pool:
                fits = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if fits >= 0:
                    n, doc, start = pool.pop(fits)
                    row.append((doc, start, n))
                    gap -= n
                else:
                    n, doc, start = pool.pop(0)
                    row.append((doc, start, gap))
                    insort(pool, (n - gap, doc, start + gap))
                    gap = 0
            sequences.extend([row] if not gap else _binary(row, window - gap))
    return sequences


def _binary(row: list[Piece], total: int) -> Iterator[list[Piece]]:
    """The row cut into sequences whose lengths are the binary digits of total, longest first."""
    row = row[::-1]
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, out = 1 << bit, []
        while room:
            doc, start, n = row.pop()
            take = min(n, room)
            out.append((doc, start, take))
            if take < n:
                row.append((doc, start + take, n - take))
            room -= take
        yield out


def balance(sequences: list[list[Piece]], size: int = GROUP_SEQUENCES) -> list[int]:
    """A step group for each sequence; groups get near-equal attention cost by dealing in snake order."""
    groups = max(1, -(-len(sequences) // size))
    cost = [sum(n * n for _, _, n in row) for row in sequences]
    out = [0] * len(sequences)
    for rank, i in enumerate(sorted(range(len(sequences)), key=lambda i: -cost[i])):
        turn = rank % (2 * groups)
        out[i] = turn if turn < groups else 2 * groups - 1 - turn
    return out


def _strings(column) -> list[str]:
    """The values of an Arrow column of strings without nulls; to_pylist takes ten times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes, remembered by word.

    Only for tokenizers whose pre-tokenizer never crosses a space or a line feed and drops them; then a text's ids are those of
    its pieces between them, one after the other.  Word ends must be marked by "</w>"; where they are not, words are encoded one by one.
    A task has one core, so the tokenizer's own threads are left off: they cost CPU time and memory and gain nothing.
    """

    _made: dict[str, "WordTokenizer"] = {}

    def __init__(self, text: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = self.letters = Tokenizer.from_str(text)
        spec = json.loads(text)
        if (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER):
            # lower-cased Latin letters stay as they are and each word is one pre-token, so neither need be looked for; the model is shared
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, text: str) -> "WordTokenizer":
        if text not in cls._made:
            cls._made[text] = cls(text)
        return cls._made[text]

    def __call__(self, texts) -> list[bytes]:
        """The ids of each text of a list or an Arrow column (null: none).

        Nearly all words are Latin letters with marks behind.  Such letters are one pre-token whatever stands around them, so they
        are remembered lower-cased, and the marks by themselves.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        core = pc.utf8_rtrim(coded.dictionary, characters=MARKS)
        latin = pc.match_substring_regex(core, LATIN)
        words, keys = _strings(coded.dictionary), _strings(pc.if_else(latin, pc.utf8_lower(core), coded.dictionary))
        tails = [word[len(key) :] for word, key in zip(words, keys, strict=True)]
        new = set(keys).difference(self.ids)
        plain = new.intersection(_strings(pc.utf8_lower(core.filter(latin))))
        self._learn(list(plain), (new - plain).union(set(tails).difference(self.ids)))
        get = self.ids.__getitem__
        known = list(map(bytes.__add__, map(get, keys), map(get, tails)))
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(known), "<u4")
        code, out = coded.indices.to_numpy(), []
        for at in range(0, len(code), GATHERED):
            some = code[at : at + GATHERED]
            out.append(flat[within(start[some], size[some])].tobytes())
        data, ends = b"".join(out), 4 * np.concatenate(([0], np.cumsum(size[code])))[split.offsets.to_numpy()]
        if len(self.ids) > CACHE_WORDS:
            self.forget()
        return [data[a:b] for a, b in pairwise(ends.tolist())]

    def forget(self) -> None:
        self.ids = {"": b""}

    def _learn(self, plain: list[str], alone: set[str]) -> None:
        """Adds the ids of new words: plain ones many in one call, told apart by the tokens that end a word, the others each by itself."""
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            ids = np.array(self.letters.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                alone.update(some)
                continue
            data = ids.tobytes()
            self.ids.update(zip(some, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        rest = list(alone)
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.ids.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found, strict=True))


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    *,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    window_tokens: int = WINDOW_TOKENS,
    window_docs: int = WINDOW_DOCS,
    with_ids: bool = False,
) -> DataFrame:
    """Packs every document (doc_id, text) and returns one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, tier (the shortest that holds the
    sequence), step_group, and with_ids adds ids array<int>.  tokenizer_json is the tokenizer's file as a string; it travels with the task.  Null or empty
    text is the end id alone; a null doc_id is kept; repeated rows are packed one by one; an empty table gives no rows; other
    columns of docs are ignored.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"
    schema += ", ids array<int>" if with_ids else ""
    end = int(end_id).to_bytes(4, "little")

    def emit(window: list[tuple[int | None, bytes]], base: int, group: int):
        import pyarrow as pa

        sequences = plan_window([len(ids) >> 2 for _, ids in window], tiers)
        rows = []
        for k, (row, step) in enumerate(zip(sequences, balance(sequences), strict=True)):
            at, total = 0, sum(n for _, _, n in row)
            tier = tiers[bisect_left(tiers, total)]
            for doc, start, n in row:
                doc_id, ids = window[doc]
                part = memoryview(ids)[4 * start : 4 * (start + n)]
                rows.append((doc_id, start, n, zlib.crc32(part), len(ids) >> 2, base + k, at, total, tier, group + step))
                if with_ids:
                    rows[-1] += (np.frombuffer(part, "<u4").astype("i4"),)
                at += n
        kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        names = [part.split()[0] for part in schema.split(", ")]
        columns = list(zip(*rows, strict=True))
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], k) for c, k in zip(columns, kinds, strict=True)], names)
        return len(sequences)

    def run(batches: Iterable):
        from pyspark import TaskContext

        tokenize = WordTokenizer.of(tokenizer_json)
        base = TaskContext.get().partitionId() << 40
        done, group, window, tokens = 0, 0, [], 0
        for batch in batches:
            for some in slices(batch, rows=128, size=SLICE_BYTES):
                for doc_id, ids in zip(some.column(0).to_pylist(), tokenize(some.column(1)), strict=True):
                    window.append((doc_id, ids + end))
                    tokens += len(ids) // 4 + 1
                if tokens >= window_tokens or len(window) >= window_docs:
                    made = yield from emit(window, base + done, base + group)
                    done, group, window, tokens = done + made, group + made // GROUP_SEQUENCES + 1, [], 0
        if window:
            yield from emit(window, base + done, base + group)
        tokenize.forget()

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)

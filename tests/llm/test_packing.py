"""Packing against the tokenizer itself."""

import os
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casemill.llm.packing import WordTokenizer, balance, pack_documents, plan_window

JSON = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=60))
def test_every_token_lies_in_one_piece_and_nothing_is_padded(lengths):
    rows = plan_window(lengths)
    seen = [np.zeros(n, int) for n in lengths]
    for row in rows:
        total = sum(n for *_, n in row)
        assert 0 < total <= 2048 and total & (total - 1) == 0
        for doc, start, n in row:
            seen[doc][start : start + n] += 1
    assert all((s == 1).all() for s in seen)
    assert len(balance(rows)) == len(rows)


def test_step_groups_cost_alike():
    rows = plan_window([int(x) for x in np.random.default_rng(1).integers(10, 3000, 3000)])
    cost = np.bincount(balance(rows), weights=[sum(n * n for *_, n in row) for row in rows])
    assert cost.max() < 1.2 * cost.mean()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAé.,' \n\tßİ1<|endoftext|>Σ́"), max_size=40), max_size=5))
def test_words_give_the_ids_of_texts(texts):
    tokenizer = Tokenizer.from_str(JSON)
    assert WordTokenizer.of(JSON)(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aÀÅɏİß́ \n.!\"#$%&()*+-/:;<=>?@[\\]^_`{|}~'s7"), max_size=30)), max_size=5))
def test_marks_behind_words_give_the_ids_of_texts(texts):
    tokenizer = Tokenizer.from_str(JSON)
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert WordTokenizer.of(JSON)(pa.array(texts, pa.string())) == want


def test_letters_are_remembered_once():
    """Not with each mark behind them and each case; what a task holds and encodes follows from that."""
    tokenizer = WordTokenizer(JSON)
    tokenizer(["Word word, WORD... word!? 7 word,"])
    assert set(tokenizer.ids) == {"", "word", ",", "...", "!?", "7"}
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_pieces_of_many_windows_and_partitions(docs_of):
    """Every document's ids are covered once and in order, sequences are gapless from 0, and are full or of a power of two, over windows that flush and tasks."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, rng.integers(0, 1500 if i % 40 == 0 else 120))), "s", "en") for i in range(400)]
    out = pack_documents(docs_of(rows).repartition(3), JSON, window_docs=50, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_str(JSON)
    for i, text, *_ in rows:
        own = out[out.doc_id == i].sort_values("start")
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert [x for piece in own.ids for x in piece] == ids and own.start.tolist() == [0, *own.length.cumsum()[:-1]] and set(own.doc_tokens) == {len(ids)}
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own.ids] == own.ids_crc32.tolist()
    assert out.sequence_id.nunique() > 100 and (out.sequence_id.to_numpy() >> 40).max() >= 1
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        total = own.length.sum()
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and set(own.sequence_length) == {total} and total & (total - 1) == 0 and total <= 2048
        assert own.tier.nunique() == 1 and own.tier.iloc[0] in (256, 512, 1024, 2048) and own.tier.iloc[0] >= total


def test_odd_rows(odd):
    rows = pack_documents(odd, JSON, with_ids=True).collect()
    tokenizer = Tokenizer.from_str(JSON)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    for doc in (1, 2, 8):
        assert [(r["start"], r["length"], r["ids"]) for r in rows if r["doc_id"] == doc] == [(0, 1, [1])]
    want = len(tokenizer.encode("no id here at all, but six words", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == want
    fives = [r for r in rows if r["doc_id"] == 5]
    assert sum(r["length"] for r in fives) == 2 * fives[0]["doc_tokens"]


def test_empty(none):
    assert pack_documents(none, JSON).collect() == []

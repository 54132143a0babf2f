"""Byte-pair counts and chunks against another library's tokenizer of the same vocabulary."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casemill.functions.encoding import RUN, BytePairs
from casemill.functions.text import sentences
from casemill.operators import calls, chunking, embed, predict
from casemill.plans import services

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = ["", None, " ", "a" * 50_000, " " * 3 * RUN + "x", "x" + "\n" * RUN, "é" * 20_000, "<|endoftext|> is text", "\U0001f600 ́‍", "q\x1c\x1d\x85  z", "I'll go, they've gone.\r\n\tNow!", "same", "same"]


@pytest.fixture(scope="module")
def other():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def test_counts_of_whole_texts(spark, other):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").unionByName(spark.read.parquet(DOCS).select("doc_id", "text")).collect()
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = texts.select("text", services.byte_pairs().count(F.col("text")).alias("n")).collect()
    assert len(got) == len(rows) > len(ODD)
    assert [r["n"] for r in got] == [len(other.encode(r["text"] or "", add_special_tokens=False).ids) for r in got]


def packed(other, sents, size, overlap):
    """Chunks of one section by the other tokenizer, sentence by sentence."""
    n = lambda s: len(other.encode(s, add_special_tokens=False).ids)
    out, now = [], []
    for s in sents:
        if n(s) > size:
            out += [" ".join(now)] if now else []
            ids = other.encode(s, add_special_tokens=False).ids
            out += [ids[a : a + size] for a in range(0, len(ids), size - overlap)]
            now = []
        elif sum(map(n, now)) + n(s) > size:
            out.append(" ".join(now))
            while now and sum(map(n, now)) > overlap:
                now = now[1:]
            now = [*now, s]
        else:
            now = [*now, s]
    out += [" ".join(now)] if now else []
    return [(c, n(c)) if isinstance(c, str) else (None, len(c)) for c in out]


@pytest.mark.parametrize(("size", "overlap"), [(60, 15), (12, 4)])
def test_chunks(spark, other, size, overlap):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").limit(30).unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "One two. Three. " + "long " * 100)], "doc_id long, text string")).collect()
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    made = {}
    for r in chunking.chunks(docs, size, overlap, encoder=services.byte_pairs()).orderBy("id", "chunk_index").collect():
        made.setdefault(r["id"], []).append((r["text"], r["token_count"]))
    parted = docs.select("doc_id", F.transform(chunking.section_list(F.col("text"))["body"], sentences).alias("s")).collect()
    for doc, parts in parted:
        want = [c for sents in parts for c in packed(other, sents, size, overlap)]
        got = made.get(doc, [])
        assert [n for _, n in got] == [n for _, n in want]
        assert all(w is None or t == w for (t, _), (w, _) in zip(got, want, strict=True))
    assert -1 not in made and -2 not in made and max(n for _, n in made[-3]) == size


def test_cut_sentences_keep_their_text(spark):
    docs = spark.createDataFrame([(1, "word " * 50)], "doc_id int, text string")
    got = [r["text"] for r in chunking.chunks(docs, 10, 0, encoder=services.byte_pairs()).orderBy("chunk_index").collect()]
    assert "".join(got) == ("word " * 50).strip() and len(got) == 5


def test_vocabularies_differ():
    more = BytePairs.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "Дом у реки"
    assert len(more.ids(text)) < len(services.byte_pairs().ids(text)) and more.text(more.ids(text)) == text


class Refusing:
    """Refuses every first call of a worker's batch, and writes down what it answered."""

    dims = 2

    def __init__(self, folder):
        self.folder = folder

    def _answer(self, texts, of):
        import hashlib
        import os
        import uuid

        mark = f"{self.folder}/{hashlib.md5(repr(texts).encode()).hexdigest()}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise predict.RateLimited("later")
        with open(f"{self.folder}/paid-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [of(t) for t in texts]

    def embed(self, texts):
        return self._answer(texts, lambda t: [float(len(t)), 1.0])

    def complete(self, prompts):
        return self._answer(prompts, str.upper)


def test_embed_and_generate_repeat_refused_calls_and_use_a_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i % 6}" * (i % 3 + 1)) for i in range(30)], "id int, prompt string")
    want = {r["id"]: [float(len(r["prompt"])), 1.0] for r in rows.collect()}
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir(), (tmp_path / "c").mkdir()
    got = embed.embed(rows, Refusing(f"{tmp_path}/a"), "id", "prompt", 4, back_off=calls.BackOff(first=0.01))
    assert {r["id"]: r["embedding"] for r in got.collect()} == want
    for _ in range(2):
        got = embed.embed(rows, Refusing(f"{tmp_path}/b"), "id", "prompt", 4, ledger=f"file://{tmp_path}/vectors", back_off=calls.BackOff(first=0.01))
        assert {r["id"]: r["embedding"] for r in got.collect()} == want
    said = predict.generate(rows, Refusing(f"{tmp_path}/c"), ledger=f"file://{tmp_path}/answers")
    assert {r["id"]: r["answer"] for r in said.collect()} == {r["id"]: r["prompt"].upper() for r in rows.collect()}
    for name in "bc":
        paid = [t for f in (tmp_path / name).glob("paid-*") for t in f.read_text().split("\n")]
        assert sorted(paid) == sorted({r["prompt"] for r in rows.collect()})

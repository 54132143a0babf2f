"""The pipeline's stages against brute force."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from casemill.llm import mixing

TOKENIZER = Tokenizer.from_str(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())


def stored(docs_of, tmp_path, rows):
    docs = docs_of(rows)
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return docs.sparkSession.read.parquet(str(tmp_path / "documents.parquet"))


def text(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_rows_of_null_and_repeated_ids(spark, docs_of, tmp_path):
    rng = random.Random(9)
    shared, a, b, c, d = text(rng, 40), *(text(rng, 30) for _ in range(4))
    rows = [(1, f"{a} {shared}", "s", "en"), (None, f"{b} {shared} {c}", "s", "en"), (2, d, "s", "en"), (2, text(rng, 30), "s", "en"), (2, text(rng, 30), "s", "en"), (2, d, "s", "en"), (None, d, "s", "en"), (3, None, "s", "en")]
    docs = stored(docs_of, tmp_path, rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in unique), key=key) == sorted({r[:2] for r in rows} - {(None, d)}, key=key)
    # the space before the shared passage belongs to it, and that behind it was not seen before
    cut = [(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()]
    want = [(i, t) for i, t, *_ in rows if i == 1 or i == 3 or t != d and i] + [(None, f"{b} {c}"), (None, ""), (2, d), (2, "")]
    assert sorted(cut, key=key) == sorted(want, key=key)


def brute_cut(rows, width=100):
    """Texts by id without the bytes of strings that start earlier too."""
    seen, out = set(), {}
    for i, t in sorted((r[:2] for r in rows), key=lambda r: r[0]):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if (w := data[p : p + width]) in seen:
                covered[p : p + width] = b"\1" * width
            seen.add(w)
        out[i] = bytes(b for b, c in zip(data, covered) if not c).decode() if any(covered) else t
    return out


def ids_of(t):
    return [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]


def test_stages_against_brute_force(spark, docs_of, tmp_path):
    rng = random.Random(10)
    shared = [text(rng, 30) for _ in range(3)]
    rows = []
    for i in range(200):
        t = " ".join([text(rng, rng.randrange(20, 90)), *rng.sample(shared, rng.randrange(0, 2)), text(rng, rng.randrange(20, 90))])
        rows.append((i, t + " vile scum slur" * (i % 6 == 0), f"s{i % 4}", "en"))
    rows += [(300 + i, rows[i + 1][1], "s1", "en") for i in range(0, 40, 6)] + [(400, None, "s1", None), (401, "", None, "en"), (402, text(rng, 3000), "s2", "en")]
    docs = stored(docs_of, tmp_path, rows)
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    want = brute_cut(rows)
    assert {i: t for i, (t, _) in cut.items()} == want and sum(want[i] != t for i, t, *_ in rows) > 50
    assert all(n == len(t or "") for t, n in cut.values())

    pieces = corpus_pipeline.pack(spark, docs, str(tmp_path)).toPandas()
    for i, t, *_ in rows:
        own, ids, at = pieces[pieces.doc_id == i].sort_values("start"), ids_of(t), 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == own.sequence_length.iloc[0] <= own.tier.iloc[0]

    # the whole: what brute force leaves after the first three stages, in the shares that the mix takes
    left = [r for r in rows if r[0] < 200 and r[0] % 6 or r[0] >= 400]
    left = [(i, t, *rest) for (i, _, *rest), t in zip(left, brute_cut(left).values())]
    expected = Counter()
    for r in mixing.mix_sources(docs_of(left)).collect():
        t = next(t for i, t, *_ in left if i == r["doc_id"]) or ""
        whole, part = divmod(r["taken"], max(1, r["size"]))
        expected[r["doc_id"], zlib.crc32(np.array(ids_of(t), "<u4").tobytes())] += whole
        if part:
            expected[r["doc_id"], zlib.crc32(np.array(ids_of("".join(re.findall(r"\s*\S+", t)[:part])), "<u4").tobytes())] += 1
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    found = Counter(run[run.length == run.doc_tokens].groupby(["doc_id", "ids_crc32"]).size().to_dict())
    assert found and all(n <= expected[k] for k, n in found.items())
    lengths = Counter()
    for p in run[run.start == 0].itertuples():
        lengths[p.doc_id] += 1
    assert lengths == Counter(i for (i, _), n in expected.items() for _ in range(n))


def test_every_stage_takes_odd_rows_and_none(spark, docs_of, odd, none, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, further columns that clash; and an empty table."""
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 0)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for frame, rows in ((odd, 10), (none, 0)):
            out = stage(spark, frame, str(tmp_path))
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            n = out.count()
            assert n == 0 if not rows else n > 0, name
            if name in ("toxicity", "repeats"):
                assert n == rows

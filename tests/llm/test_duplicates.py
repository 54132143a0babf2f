"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext

from casemill.llm import bcr, minhash, repeats, shared
from casemill.llm.shingles import shingle_sets


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def brute_components(rows, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label, sets


def test_near_duplicates(docs_of):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60)))) for i in range(60)]
    for chain in range(6):  # each copy is made of the one before
        text = words(rng, 120)
        for k in range(12):
            text = list(text)
            for _ in range(2):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append((100 + chain * 20 + k, " ".join(text)))
    base = words(rng, 80)
    for k in range(40):  # a crowd around the border
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = f"m{rng.randrange(10**6)}"
        rows.append((400 + k, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, " \t")]
    rng.shuffle(rows)
    want, sets = brute_components(rows)
    frame = docs_of([(i, t, "s", "en") for i, t in rows])
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, exact=True).collect()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == want[i]) for i, r in got.items())


def test_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert minhash.near_duplicates(none).collect() == []


def test_sketches_estimate_and_fill():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 64, 400, np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 64, 100, np.uint64)))
    many = [minhash.sketches([np.unique(minhash.mix(x + np.uint64(k))) for x in (a, b)]) for k in range(20)]
    assert abs(np.mean([(s[0] == s[1]).mean() for s in many]) - 0.6) < 0.03
    one = minhash.sketches([a[:1], a[:1], a[1:2]])
    assert (one[0] == one[1]).all() and (one[0] != one[2]).mean() > 0.9
    assert [len(s) for s in shingle_sets([b"", b"A b c d e", b"a b C d e f", b"x"])] == [0, 1, 2, 1]


def brute_repeats(rows, width):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - width + 1):
            w = data[p : p + width]
            if w in seen:
                covered[p : p + width] = b"\1" * width
            else:
                seen[w] = (i, p)
        out[i] = (len(data), sum(covered), sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered)))
    return out


def test_repeats(docs_of):
    rng = random.Random(9)
    source = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcdefghé\0") for _ in range(rng.randrange(0, 60)))
        for _ in range(rng.randrange(0, 5)):
            a = rng.randrange(300)
            text += source[a : a + rng.randrange(5, 120)] + rng.choice(["", "x", "yz"])
        rows.append((i, text))
    rows += [(70, "z" * 200), (71, "z" * 90), (72, None), (73, ""), (74, "ab" * 80)]
    for hot in (2048, 2):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs_of([(i, t, "s", "en") for i, t in rows]), width=20, gram=8, hot=hot).collect()}
        assert got == brute_repeats(rows, 20)


def test_repeats_at_production_width(docs_of):
    """Windows of 100 bytes and grams of 20, over several scan tasks: every column against brute force, the kept bytes too."""
    rng = random.Random(11)
    shared = [" ".join(words(rng, 40)) for _ in range(4)]
    rows = []
    for i in range(90):
        parts = [" ".join(words(rng, rng.randrange(3, 30))) for _ in range(3)]
        if i % 3:
            whole = shared[i % 4]
            a = rng.randrange(0, 80)
            parts.insert(1, whole[a : a + rng.randrange(90, 200)])
        rows.append((i, " ".join(parts) + "é" * (i % 5)))
    rows += [(100 + k, rows[7][1]) for k in range(12)] + [(200, rows[3][1][:150] + "!" + rows[3][1][150:]), (201, "q" * 350), (202, None)]
    out = {r["doc_id"]: r for r in repeats.remove_repeats(docs_of([(i, t, "s", "en") for i, t in rows]).repartition(4)).collect()}
    want, seen = brute_repeats(rows, 100), set()
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"]) for i, r in out.items()} == want and sum(n > 0 for _, n, _ in want.values()) > 40
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        assert out[i]["kept_sha256"] == hashlib.sha256(bytes(b for b, c in zip(data, covered) if not c)).hexdigest()


def test_repeats_of_one_line_in_many_texts(docs_of, tmp_path):
    """10,000 texts round one line: every text but the first loses just the line, and its windows meet once a block of a task, not once a text."""
    rng = random.Random(13)
    line = "x" + " ".join(words(rng, 30))[:108] + "x"
    rows = [(i, f"{rng.getrandbits(480):0120x}{line}{rng.getrandbits(480):0120x}", "s", "en") for i in range(10_000)]
    docs = docs_of(rows).repartition(4)
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs, hot=64).collect()}
    before, after, want = set(), set(), {}
    for i, text, *_ in rows:
        left, right = text[119::-1], text[120 + len(line) :]
        ends = [max(k for k in range(120) if not k or ends[:k] in seen) for ends, seen in ((left, before), (right, after))]
        want[i] = (len(line) + sum(ends), 1) if i else (0, 0)
        before |= {left[:k] for k in range(1, 20)}
        after |= {right[:k] for k in range(1, 20)}
    assert out == want

    folder = f"file://{tmp_path}/texts"
    found = shared.written(repeats.scan_runs(docs, folder, 100, 20).repartition(1).sortWithinPartitions("key", "content", "doc", "start"), "runs")
    found = shared.written(shared.mapped(found, repeats._match, "kind int, key long, doc long, start long, n long, at long"), "matches")
    left = repeats._left(found, 64)
    pieces = shared.written(repeats.strings_and_windows(left, folder, 4, 100), "pieces")
    most = lambda rows, *by: rows.groupBy(*by).count().agg({"count": "max"}).first()[0]
    assert most(left.filter("not hot"), "key") <= 64 and most(left.filter("hot"), "key") > 5_000
    assert most(pieces.filter("kind = 1"), "high", "low") <= 8 and pieces.filter("kind = 0").agg({"n": "sum"}).first()[0] > 5_000


def test_components_work_out_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long").mapInArrow(run, "a long, b long")
    assert {r["node"]: r["comp"] for r in minhash.components(edges).collect()} == {i: 0 if i < 10 else 10 for i in range(21)}
    assert seen.value == 19


def test_a_scan_task_holds_one_block(docs_of, tmp_path, monkeypatch):
    """Its runs leave as each block is done, and hashing takes a small part of the memory that a block's worth at a time would take."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=50_000)) for _ in range(80)]
    read = []

    def batches():
        for i in range(0, len(texts), 8):
            read.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + 8), pa.int64()), pa.array(texts[i : i + 8])], ["doc_id", "text"])

    monkeypatch.setattr(repeats, "mapped", lambda df, run, schema: run)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    rows = repeats.scan_runs(docs_of([]), f"file://{tmp_path}", 100, 20)(batches())
    tracemalloc.start()
    try:
        rows_out = next(rows).num_rows
        seen = len(read)
        rows_out += sum(b.num_rows for b in rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen <= 3 and rows_out > 80_000 and peak < 60 << 20, (seen, rows_out, peak >> 20)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["part-00000003.arrow", "part-00000003.npy"]
    with pa.ipc.open_file(str(tmp_path / "part-00000003.arrow")) as file:
        assert file.read_all().column(1).to_pylist() == texts


def test_repeats_odd_rows(odd, none):
    rows = repeats.remove_repeats(odd, with_text=True).collect()
    assert len(rows) == 10
    assert [(r["n_removed"] == r["n_bytes"], r["kept_text"]) for r in rows if r["doc_id"] == 6] == [(True, "")]
    assert [r["n_removed"] for r in rows if r["doc_id"] == 5] == [0, 0]
    assert [r["kept_text"] for r in rows if r["doc_id"] == 1] == [None]
    assert repeats.remove_repeats(none).collect() == []


def test_suffix_order(tmp_path):
    rng = random.Random(1)
    files = lambda: bcr.Files(fs.LocalFileSystem(), str(tmp_path / "x"))
    for k in range(60):
        strings = [bytes(rng.choice(b"ab" if k % 2 else b"abcde") for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 9))]
        string, length, lcp = bcr.build(strings, 8, files())
        order = sorted((s[at:], i, len(s) - at) for i, s in enumerate(strings) for at in range(len(s) + 1))
        assert [(i, n) for _, i, n in order] == list(zip(string.tolist(), length.tolist()))
        common = lambda a, b: next((j for j in range(min(len(a), len(b), 8)) if a[j] != b[j]), min(len(a), len(b), 8))
        assert lcp.tolist() == [0] + [common(order[j - 1][0], order[j][0]) for j in range(1, len(order))]
    assert list(tmp_path.iterdir()) == []

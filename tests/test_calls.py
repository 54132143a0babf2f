"""Provider calls that fail, come back out of order and are counted."""

import pytest

from casemill.operators import calls, embed, predict


def provider(folder, broken: str | None = None):
    """Answers in reverse order; each batch is refused at first, `broken` fails for good until its file is gone; paid texts are written down."""

    def call(texts):
        import hashlib
        import os
        import uuid

        mark = f"{folder}/seen-{hashlib.md5(''.join(texts).encode()).hexdigest()}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise predict.RateLimited("later")
        if broken in texts and os.path.exists(f"{folder}/broken"):
            raise RuntimeError("out of order")
        with open(f"{folder}/paid-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [(i, f"<{t}>") for i, t in enumerate(texts)][::-1]

    return call


def paid(folder):
    return sorted(t for f in folder.glob("paid-*") for t in f.read_text().split("\n"))


def test_every_prompt_is_paid_for_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 7 else f"p{i % 40}", "x", "y") for i in range(100)], "id int, prompt string, answer string, call string")
    ledger, quick = f"file://{tmp_path}/ledger", calls.BackOff(first=0.01)
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="out of order"):
        calls.answered(rows, provider(tmp_path, "p13"), ledger, batch=4, back_off=quick)
    before = paid(tmp_path)
    assert "p13" not in before
    (tmp_path / "broken").unlink()
    for _ in range(2):
        out = {r["id"]: (r["answer"], r["call"]) for r in calls.answered(rows, provider(tmp_path, "p13"), ledger, batch=4, back_off=quick).collect()}
        assert out == {i: (None if i == 7 else f"<p{i % 40}>", "y") for i in range(100)}
    assert paid(tmp_path) == sorted(f"p{i}" for i in range(40))
    more = rows.limit(0).unionByName(spark.createDataFrame([(200, "new", "", ""), (201, "p3", "", "")], rows.schema))
    assert {r["answer"] for r in calls.answered(more, provider(tmp_path), ledger, back_off=quick).collect()} == {"<new>", "<p3>"}
    assert len(paid(tmp_path)) == 41 and calls.answered(rows.limit(0), provider(tmp_path), ledger).collect() == []


def test_vectors_equal_those_of_the_plain_call(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a b{i % 5}") for i in range(20)], "id int, t string")
    model = embed.HashedWords(8)
    got = calls.answered(rows, calls.indexed(model.embed), f"file://{tmp_path}/v", column="t", kind="array<double>", batch=3)
    assert {r["id"]: r["answer"] for r in got.collect()} == {r["id"]: r["embedding"] for r in embed.embed(rows, model, "id", "t").collect()}


def test_order_and_attempts():
    assert calls.in_order([(1, "b"), (0, "a")], 2) == ["a", "b"]
    for wrong in ([(0, "a")], [(0, "a"), (0, "b")], [(0, "a"), (2, "b")]):
        with pytest.raises(ValueError, match="2 texts"):
            calls.in_order(wrong, 2)
    tried = []

    def refuse(texts):
        tried.append(texts)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        calls.BackOff(tries=3, first=0.0)(refuse, ["a"])
    assert len(tried) == 3

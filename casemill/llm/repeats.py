"""Removal of repeated byte strings over a whole corpus, by equal runs of windows, and a suffix order of what they leave undecided.

A byte is removed when a `width`-byte string that covers it also starts earlier: in a document of smaller id, or earlier in the
same one.  Only places where that can be so come to the suffix order:

1. Each text is cut into runs of neighbouring windows of `width` bytes that share their least `gram`-byte hash.  A window's run is
   a function of its content, so equal windows lie in runs of one key, wherever they are.
2. Runs of equal content (a polynomial hash of the gram and BLAKE2b of the whole run, 64 bits each) are settled at once: all but
   the first are repeats.  Blocks of a task settle their own first, so a
   passage that a third of all documents share reaches the shuffle once a block, not once a document.
3. What is left of a key with several different contents (the ends of copies, where texts part) goes to one block.  Each is cut to
   what it can share with another, the Burrows-Wheeler transform and the common prefixes of these short strings are built column
   by column, and wherever `width` bytes are shared all but the first window are repeats.  Of equal strings the first and the second
   are ordered; the others, compared byte by byte, fare as the second.
4. A key with very many contents (a line that very many documents have in surroundings of their own) is split into its windows.  They are
   settled by 128 bits of BLAKE2b: each block of a task keeps the first of its equal windows, the least of these is a combined minimum, and
   what is joined with it is one row a window and block.

Texts are not shuffled.  Each scan task leaves its rows as a file in the shared folder, later tasks open that file, and an
address is the file's number and the row.  A task that runs again writes the same file again, as a scan gives it the same rows;
docs should therefore be a scan or a written table.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import bcr
from casemill.llm.shared import blocks, filesystem, groups, mapped, put_whole, scratch, whole, written
from casemill.llm.shingles import mix

WIDTH, GRAM = 100, 20
#: Bytes hashed at a time, which take some hundred times as much; a longer text is cut, with an overlap.
SPAN = 1 << 18
#: Bytes of text whose equal runs are settled within a task.
BLOCK_BYTES = 24 << 20
#: Symbols of one suffix-order block.
ORDER_SYMBOLS = 1 << 20
#: Different contents of one key beyond which the key is split by window, and windows whose equal ones are settled within a task.
HOT_CONTENTS, WINDOWS = 2048, 1 << 19
LAST = np.int64((1 << 63) - 1)
COUNT = 0xFFFF
_BITS = 21
_bases: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, and a random value for each byte."""
    if not _bases:
        base = 0x5851F42D4C957F2D
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(2 * SPAN, b, np.uint64)
            p[0] = 1
            _bases.append(np.cumprod(p))
        _bases.append(np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64))
    return _bases


def _digest(data, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def runs(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, content) of all runs of texts of at most 2 * SPAN bytes in all; texts of under width bytes have none.

    windows also carries where in the run its key begins, 16 bits up.
    """
    power, inverse, value = _powers()
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, span = len(data), width - gram + 1
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * power[:n], out=total[1:])
    hashes = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    places = np.arange(len(hashes), dtype=np.uint64)
    rank = (hashes & ~np.uint64((1 << _BITS) - 1)) | places
    padded = np.full(-(-len(rank) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(rank)] = rank
    table = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    least = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[:windows]
    ends = np.cumsum(sizes)
    inside = np.flatnonzero(ends[text] - np.arange(windows) >= width)
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.concatenate(([True], (least[inside[1:]] != least[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)))
    head = np.flatnonzero(new)
    start = inside[head]
    count = np.diff(np.append(head, len(inside)))
    whole = memoryview(data)
    content = np.frombuffer(b"".join(_digest(whole[a:b], 8) for a, b in zip(start.tolist(), (start + count + width - 1).tolist(), strict=True)), np.int64)
    of = text[start]
    return of, start - (ends - sizes)[of], count | (least[start] - start) << 16, hashes[least[start]].view(np.int64), content


def _text_runs(texts: list[bytes], width: int, gram: int):
    """runs() of texts of any size, in parts."""
    batch, size, first = [], 0, 0
    for k, text in enumerate(texts):
        if len(text) > SPAN:
            if batch:
                yield first, 0, runs(batch, width, gram)
            for at in range(0, len(text) - width + 1, SPAN):
                yield k, at, runs([text[at : at + SPAN + width - 1]], width, gram)
            batch, size, first = [], 0, k + 1
            continue
        if size + len(text) > SPAN:
            yield first, 0, runs(batch, width, gram)
            batch, size, first = [], 0, k
        batch.append(text)
        size += len(text)
    if batch:
        yield first, 0, runs(batch, width, gram)


def _settle(doc: np.ndarray, start: np.ndarray, key: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which rows repeat one of the same content that comes earlier; contents are equal if both 64-bit hashes are."""
    o = np.lexsort((start, doc, content, key))
    k, c = key[o], content[o]
    lead = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))) if len(o) else np.zeros(0, np.int64)
    first = o[np.repeat(lead, np.diff(np.append(lead, len(o))))]
    late = np.zeros(len(doc), bool)
    late[o] = (doc[o] > doc[first]) | (start[o] > start[first])
    return late


def scan_runs(docs: DataFrame, folder: str, width: int, gram: int) -> DataFrame:
    """key, content, doc, start, n, at of runs that no run of the same block settles; leaves texts and settled runs as files."""
    columns = ["key", "content", "doc", "start", "n", "at"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        settled: list[np.ndarray] = []
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

        def flush(ids: list, texts: list[bytes], base: int):
            """The block's runs that none of it settles; texts are dropped once they are hashed."""
            found = []
            for first, shift, (of, start, n, key, content) in _text_runs(texts, width, gram):
                found.append((of + first, start + shift, n, key, content))
            texts.clear()
            if not found:
                return
            parts = list(zip(*found, strict=True))
            del found
            of, start, n, key, content = (np.concatenate(parts.pop(0)) for _ in range(5))
            doc = np.array([LAST if i is None else i for i in ids], np.int64)[of]
            late = _settle(doc, start, key, content)
            settled.append(np.stack([of[late] + base, start[late], n[late] & COUNT], 1))
            keep = np.flatnonzero(~late)
            for k in (keep[i : i + 100_000] for i in range(0, len(keep), 100_000)):
                made = [key[k], content[k], doc[k], start[k], n[k], (of[k] + base) | (part << 32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], columns)

        row, ids, texts, size = 0, [], [], 0
        peek = next((b for b in batches if b.num_rows), None)
        if peek is None:
            return
        with whole(fs, f"{root}/part-{part:08d}.arrow") as stream, pa.ipc.new_file(stream, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            for batch in chain([peek], batches):
                for b in range(0, batch.num_rows, 512):
                    some = batch.slice(b, 512)
                    file.write_batch(pa.RecordBatch.from_arrays(some.columns, schema=schema))
                    ids += some.column(0).to_pylist()
                    new = [(t or "").encode() for t in some.column(1).to_pylist()]
                    texts += new
                    size += sum(map(len, new))
                    del new
                    if size >= BLOCK_BYTES:
                        yield from flush(ids, texts, row)
                        row, ids, texts, size = row + len(ids), [], [], 0
            yield from flush(ids, texts, row)
        put_whole(fs, f"{root}/part-{part:08d}.npy", lambda s: np.save(s, np.concatenate([*settled, np.zeros((0, 3), np.int64)])))

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, ", ".join(f"{c} long" for c in columns))


def _match(batches):
    """Of rows sorted by key, content, doc, start: repeats (kind 0), and for keys of several contents the first run of each (kind 1)."""
    import pyarrow as pa

    names = ["kind", "key", "doc", "start", "n", "at"]
    last = None  # key, content, doc and start of the content's first run, whether the key has several contents
    held: list[np.ndarray] = []  # first runs of a key that so far has one content

    def rows(kind: int, *cols):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *map(pa.array, cols)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, content, doc, start, n, at = (batch.column(k).to_numpy() for k in range(6))
        same = last is not None and last[0] == key[0]
        new_key = np.concatenate(([not same], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([not same or last[1] != content[0]], content[1:] != content[:-1]))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        d0 = np.where(lead < 0, last[2] if last else 0, doc[lead])
        s0 = np.where(lead < 0, last[3] if last else 0, start[lead])
        late = ~new & ((doc > d0) | (start > s0))
        if late.any():
            yield rows(0, key[late], doc[late], start[late], n[late] & COUNT, at[late])
        of = np.cumsum(new_key) - (0 if same else 1)
        several = np.zeros(of[-1] + 1, bool)
        several[of[new & ~new_key]] = True
        if same:
            several[0] |= last[4]
            if several[0] and held:
                yield rows(1, *np.concatenate(held, 1))
                held = []
        front = ~late & several[of]
        if front.any():
            yield rows(1, key[front], doc[front], start[front], n[front], at[front])
        if not same or of[-1] > 0:
            held = []
        if not several[-1]:
            keep = ~late & (of == of[-1])
            held.append(np.stack([key[keep], doc[keep], start[keep], n[keep], at[keep]]))
        last = (key[-1], content[-1], d0[-1], s0[-1], bool(several[-1]))


def _parts(folder: str) -> list[int]:
    from pyarrow.fs import FileSelector

    fs, root = filesystem(folder)
    return sorted(int(f.base_name[5:13]) for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".arrow"))


def _read_part(fs, root: str, part: int):
    """Batches of (first row, ids, texts) of a scan task's file."""
    import pyarrow as pa

    with fs.open_input_file(f"{root}/part-{part:08d}.arrow") as source:
        file, row = pa.ipc.open_file(source), 0
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            yield row, batch.column(0), batch.column(1)
            row += batch.num_rows


def _left(found: DataFrame, hot: int) -> DataFrame:
    """part, at, start, key, doc, n, hot of the runs that are left; those of keys with more than hot contents are hot."""
    left = found.filter("kind = 1").select(F.shiftright("at", 32).alias("part"), "at", "start", "key", "doc", "n")
    # the exchange between the counts and the join lets Spark split the rows of a hot key
    busy = left.groupBy("key").count().filter(F.col("count") > hot).repartition("count", "key").select("key", F.lit(True).alias("hot"))
    return left.join(busy, "key", "left").select("part", "at", "start", "key", "doc", "n", F.coalesce("hot", F.lit(False)).alias("hot"))


def strings_and_windows(left: DataFrame, folder: str, tasks: int, width: int) -> DataFrame:
    """kind, high, low, doc, start, n, at, bytes, in one pass over the texts: of hot runs the windows under their hash (high, low), stretches
    that repeat earlier windows of the block (kind 0) and windows that do not (kind 1); the bytes of the other runs (kind 2) under
    their key (high) with the place of the key in the bytes (low)."""
    names = ["kind", "high", "low", "doc", "start", "n", "at", "bytes"]
    left = left.repartition(tasks, "part").sortWithinPartitions("part", "at", "start")

    def table(kind: int, *columns, data=None):
        import pyarrow as pa

        n = len(columns[0])
        made = [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.ascontiguousarray(c, np.int64)) for c in columns)]
        return pa.RecordBatch.from_arrays([*made, pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())], names)

    def settled(digests: bytearray, *places: array):
        half = np.frombuffer(digests, np.int64).reshape(-1, 2)
        doc, start, at = (np.frombuffer(c, np.int64) for c in places)
        late = _settle(doc, start, half[:, 0], half[:, 1])
        k = np.flatnonzero(late)
        if len(k):
            lead = np.flatnonzero(np.concatenate(([True], (at[k][1:] != at[k][:-1]) | (start[k][1:] != start[k][:-1] + 1))))
            first = k[lead]
            yield table(0, *half[first].T, doc[first], start[first], np.diff(np.append(lead, len(k))), at[first])
        front = np.flatnonzero(~late)
        for some in np.split(front, range(100_000, len(front), 100_000)):
            yield table(1, *half[some].T, doc[some], start[some], np.ones(len(some)), at[some])

    def run(batches):
        fs, root = filesystem(folder)
        empty = lambda: (bytearray(), array("q"), array("q"), array("q"))
        for t in groups(batches, 1):
            at, start, key, doc, n, busy = (t.column(k).to_numpy() for k in range(1, 7))
            row, held = at & 0xFFFFFFFF, empty()
            for first, _, texts in _read_part(fs, root, t.column(0)[0].as_py()):
                a, b = np.searchsorted(row, [first, first + len(texts)])
                text, was, cold, strings = b"", -1, [], []
                for i in range(a, b):
                    if row[i] != was:
                        was = row[i]
                        text = (texts[int(was - first)].as_py() or "").encode()
                    s, count = int(start[i]), int(n[i]) & COUNT
                    if not busy[i]:
                        cold.append(i)
                        strings.append(text[s : s + count + width - 1])
                        continue
                    held[0].extend(b"".join(_digest(text[w : w + width], 16) for w in range(s, s + count)))
                    held[1].extend([int(doc[i])] * count)
                    held[2].extend(range(s, s + count))
                    held[3].extend([int(at[i])] * count)
                    if len(held[1]) >= WINDOWS:
                        yield from settled(*held)
                        held = empty()
                if cold:
                    yield table(2, key[cold], n[cold] >> 16, doc[cold], start[cold], np.zeros(len(cold)), at[cold], data=strings)
            if held[1]:
                yield from settled(*held)

    return mapped(left, run, "kind int, high long, low long, doc long, start long, n long, at long, bytes binary")


def _hot_repeats(windows: DataFrame) -> DataFrame:
    """at, start, n of the windows (see strings_and_windows) of which an equal one comes earlier."""
    fronts = windows.filter("kind = 1")
    first = fronts.groupBy("high", "low").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("rows")).filter("rows > 1").repartition("rows", "high", "low")
    late = fronts.join(first, ["high", "low"]).filter(F.struct("doc", "start") > F.col("first"))
    return windows.filter("kind = 0").select("at", "start", "n").union(late.select("at", "start", "n"))


def _shared(key: np.ndarray, context: list[bytes]) -> np.ndarray:
    """How far each context agrees at most with another one of its key: with a neighbour in order."""
    sizes = np.array([len(c) for c in context])
    width = max(1, int(sizes.max(initial=0)))
    padded = np.array(context, f"S{width}")
    o = np.lexsort((padded, key))
    table = padded[o].view(np.uint8).reshape(-1, width)
    equal = table[1:] == table[:-1]
    size = np.minimum(sizes[o][1:], sizes[o][:-1])
    common = np.where(equal.all(1), width, equal.argmin(1))
    common = np.where(key[o][1:] == key[o][:-1], np.minimum(common, size), 0)
    best = np.zeros(len(key), np.int64)
    best[:-1] = common
    best[1:] = np.maximum(best[1:], common)
    out = np.empty_like(best)
    out[o] = best
    return out


def _trim(key: np.ndarray, anchor: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the part of each string that can be in a shared window.

    Windows of one key hold it at one place, so a shared window reaches no further to either side than the string agrees with
    another one of its key.  A zero byte could be taken for padding; strings of a block that has one stay whole.
    """
    sizes = np.array([len(s) for s in strings])
    if any(b"\0" in s for s in strings):
        return np.zeros_like(sizes), sizes
    left = _shared(key, [s[:a][::-1] for s, a in zip(strings, anchor.tolist(), strict=True)])
    right = _shared(key, [s[a:] for s, a in zip(strings, anchor.tolist(), strict=True)])
    return anchor - left, anchor + right


def _classes(rows: list[tuple]) -> tuple[list[tuple], bool]:
    """(doc, start, at, string, followers) to order of one key's (string, doc, start, at), and whether they differ: of equal strings the
    first (all that begin at its place) and the second, which the others follow as (at, start)."""
    equal: dict[bytes, list] = {}
    for data, *where in rows:
        equal.setdefault(data, []).append(tuple(where))
    out = []
    for data, members in equal.items():
        members.sort()
        lead = sum(m[:2] == members[0][:2] for m in members)
        out.extend((*m, data, ()) for m in members[:lead])
        if lead < len(members):
            out.append((*members[lead], data, tuple((at, start) for _, start, at in members[lead + 1 :])))
    return out, len(equal) > 1


def _ordered(strings: DataFrame, folder: str, tasks: int, width: int) -> DataFrame:
    """at, start, n: repeats among strings of one key, by blocks of whole keys that are cut to what can be shared and put in suffix order."""

    def run(batches):
        import uuid

        import pyarrow as pa

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        held: list = []
        symbols = 0

        def table(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["at", "start", "n"])

        def order():
            doc, start = (np.array([r[k] for r in held]) for k in (0, 1))
            s, offset = bcr.repeated([r[3] for r in held], doc, start, width, bcr.Files(fs, f"{root}/{uuid.uuid4().hex}"))
            if not len(s):
                return
            o = np.lexsort((offset, s))
            s, offset = s[o], offset[o]
            new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (offset[1:] > offset[:-1] + 1))))
            last = np.append(new[1:], len(s)) - 1
            out = []
            for k, a, n in zip(s[new].tolist(), offset[new].tolist(), (offset[last] - offset[new] + 1).tolist(), strict=True):
                _, begin, at, _, followers = held[k]
                out.append((at, begin + a, n))
                out.extend((at, begin + a, n) for at, begin in followers)
            yield table(out)

        for t in blocks(batches, 4 * ORDER_SYMBOLS):
            key, doc, start, anchor, at = (t.column(k).to_numpy() for k in range(5))
            texts = t.column(5).to_pylist()
            begin, end = _trim(key, anchor, texts, width)
            keys: dict[int, list] = {}
            for i in np.flatnonzero(end - begin >= width).tolist():
                keys.setdefault(int(key[i]), []).append((texts[i][begin[i] : end[i]], int(doc[i]), int(start[i] + begin[i]), int(at[i])))
            alike = []
            for rows in keys.values():
                found, differ = _classes(rows)
                if not differ:
                    for r in found:
                        if r[:2] > found[0][:2]:
                            alike.extend((a, b, len(r[3]) - width + 1) for a, b in ((r[2], r[1]), *r[4]))
                    continue
                held += found
                symbols += sum(len(r[3]) for r in found)
                if symbols >= ORDER_SYMBOLS:
                    yield from order()
                    held, symbols = [], 0
            if alike:
                yield table(alike)
        if held:
            yield from order()

    return mapped(strings.repartition(tasks, "key").sortWithinPartitions("key"), run, "at long, start long, n long")


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, hot: int = HOT_CONTENTS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text), and with_text kept_text.

    Null and empty texts have no bytes; texts of under width bytes lose none; matches never cross documents.  Rows with a null
    doc_id come after all others; rows that repeat a doc_id compare by start alone, so whole copies under one id are not removed for
    each other.  kept_text drops the pieces of a character that a cut has torn.  Other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "repeats")
    texts, orders = f"{folder}/texts", f"{folder}/orders"
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs_ = scan_runs(docs, texts, width, gram).repartition("key").sortWithinPartitions("key", "content", "doc", "start")
    found = written(mapped(runs_, _match, "kind int, key long, doc long, start long, n long, at long"), "matches")
    pieces = written(strings_and_windows(_left(found, hot), texts, tasks, width), "pieces")
    strings = pieces.filter("kind = 2").select(F.col("high").alias("key"), "doc", "start", F.col("low").alias("anchor"), "at", "bytes")
    late = _ordered(strings, orders, tasks, width).union(_hot_repeats(pieces))
    parts = _parts(texts)
    every = spark.range(0).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("at"), F.col("id").alias("start"), F.col("id").alias("n"))
    if parts:
        every = spark.createDataFrame([(p,) for p in parts], "part long").select("part", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n"))
    marks = found.filter("kind = 0").select("at", "start", "n").union(late).select(F.shiftright("at", 32).alias("part"), "at", "start", "n").union(every)
    marks = marks.repartition(min(max(1, len(parts)), 20_000), "part").sortWithinPartitions("part", "at", "start")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches):
        import pyarrow as pa

        fs, root = filesystem(texts)
        for t in groups(batches, 1):
            part = t.column(0)[0].as_py()
            at, start, n = (t.column(k).to_numpy() for k in (1, 2, 3))
            real = at >= 0
            with fs.open_input_stream(f"{root}/part-{part:08d}.npy", compression=None) as s:
                import io

                own = np.load(io.BytesIO(s.read()))
            row = np.concatenate((at[real] & 0xFFFFFFFF, own[:, 0]))
            start, n = np.concatenate((start[real], own[:, 1])), np.concatenate((n[real], own[:, 2]))
            o = np.argsort(row, kind="stable")
            row, start, n = row[o], start[o], n[o]
            for first, ids, column in _read_part(fs, root, part):
                cuts = np.searchsorted(row, np.arange(first, first + len(ids) + 1))
                out = []
                for k, text in enumerate(column.to_pylist()):
                    data = (text or "").encode()
                    kept, spans, a, b = data, 0, cuts[k], cuts[k + 1]
                    if a < b:
                        edge = np.zeros(len(data) + 1, np.int32)
                        np.add.at(edge, start[a:b], 1)
                        np.add.at(edge, start[a:b] + n[a:b] + width - 1, -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        spans = int((covered[1:] & ~covered[:-1]).sum()) + int(covered[0])
                        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
                    out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()) + ((kept.decode(errors="ignore") if a < b else text,) if with_text else ()))
                kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return mapped(marks, run, schema)

"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has `bins` coordinates.  In each of the first `bins` rounds every element of a set is hashed to one bin with a value
that is larger than all values of earlier rounds; in the next `bins` rounds round i puts every element into bin i, so after
twice as many rounds no bin is empty, and most sets stop after one or two.  Bins keep their least value, two sets agree in a
bin with a probability of their similarity, and the count of agreements is concentrated as for independent draws or better.

Texts of one shingle set are one class from the start.  Class sketches are cut into bands; classes that agree in a whole band
share a bucket.  Links are confirmed on full shingle sets.  Pairs of a bucket are not listed: in two rounds every member is
held against one member of its bucket (in a few bands, then in others where the bucket still has several components), and
only what is then still apart in a shared bucket is compared sketch with sketch, in blocks of bounded size.  Classes that the
sketches leave in doubt are gathered into clusters, again cut into blocks, and confirmed there; blocks yield spanning forests.  At a
similarity of 0.75 a pair shares no band with a probability of 5e-6, and has a sketch below the bound with one under 1e-6; most
such pairs are linked through others.  With exact=True no link depends on chance: buckets are then the shingles of each set's
prefix, of which linked sets must share one, and all pairs of different components in a bucket's blocks are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import groups, mapped, slices, written
from casemill.llm.shingles import mix, shingle_sets

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Members of a bucket that are compared in one block.
BLOCK = 1024
#: Shingles of a set that count as one set where sets meet in blocks.
UNIT = 1024
#: Sketches that agree in fewer bins than this share are not confirmed: 5 standard deviations below 0.75.
ESTIMATE = 0.55
#: Bytes of text whose shingles are in memory at a time; they take some twenty times as much.
SLICE_BYTES = 1 << 20


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """(len(sets), bins) uint16 sketches; sets must not be empty.  bins is a power of two."""
    n, shift = len(sets), np.uint64(64 - bins.bit_length() + 1)
    best = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    for i in range(2 * bins):
        if not len(items):
            break
        x = mix(items + np.uint64((0xD1B54A32D192ED03 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        slot = (x >> shift).astype(np.int64) if i < bins else i - bins
        value = np.uint64(i << 56) | (mix(x) >> np.uint64(8))
        np.minimum.at(best, of * bins + slot, value)
        left = (best.reshape(n, bins) == np.iinfo(np.uint64).max).any(1)[of]
        items, of = items[left], of[left]
    return (mix(best) >> np.uint64(48)).astype(np.uint16).reshape(n, bins)


def sketch_documents(docs: DataFrame, *, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that identify the set; null for an empty set) and the sketch as one long a band."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, size=SLICE_BYTES):
                sets = shingle_sets([(t or "").encode() for t in some.column(1).to_pylist()], width)
                full = [s for s in sets if len(s)]
                bands = iter(sketches(full).view(np.int64) if full else ())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "sketch"],
                )

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def shingle_rows(docs: DataFrame, *, width: int = 5) -> DataFrame:
    """node and its sorted 64-bit shingles as bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, size=SLICE_BYTES):
                sets = shingle_sets([(t or "").encode() for t in some.column(1).to_pylist()], width)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "node long, hashes binary")


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(node, key): the least shingles of each set (node, hashes), so many that two sets of enough similarity share one of them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            found = [x[: len(x) - -(-percent * len(x) // 100) + 1] for x in found]
            if found:
                node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(found))], ["node", "key"])

    return mapped(sets.select("node", "hashes"), run, "node long, key long")


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            kept = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    return mapped(rows.select("a", "b", "of_a", "of_b"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node reachable over the edges (a, b).

    Every node takes the least label around it, then the label of its label, until nothing changes; each step is a table in the
    shared folder.  All joins are between scans, so that Spark can split the partitions of hubs.
    """
    # a union of both directions would work out the edges twice
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("edge")).select("edge.*")
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        found = labels.join(up, "comp").join(near, "node").select("node", F.least("up", "near").alias("comp"), F.col("comp").alias("was"))
        found = written(found, "labels")
        labels = found.select("node", "comp")
        if found.filter("comp <> was").isEmpty():
            return labels


def relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp) after merging the components that the edges (a, b between nodes) connect."""
    ends = edges.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
    merged = components(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return written(moved.select("node", F.coalesce("to", "comp").alias("comp")), "labels")


def hub_pairs(members: DataFrame, seed: int) -> DataFrame:
    """(a, b), a < b: each member (band, key, node, comp) with its bucket's hub, of another component; hubs are random for each bucket."""
    rank = F.struct(F.xxhash64("node", "band", F.lit(seed)), "node")
    hubs = members.groupBy("band", "key").agg(F.min(rank)["node"].alias("hub"), F.min_by("comp", rank).alias("hub_comp"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    hubs = hubs.filter("lo <> hi").select("band", "key", "hub", "hub_comp").repartition("hub")
    found = members.join(hubs, ["band", "key"]).filter("comp <> hub_comp")
    return found.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def forest(n: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) for the nodes that the pairs touch: label is the least node that they connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    touched = np.unique(np.concatenate((p, q)))
    return touched, label[touched]


def _blocked(rows: DataFrame, keys: list[str], block: int, weight=None) -> DataFrame:
    """rows with the blocks i <= j in which each meets the other rows of its key, and its own block; a key has as many blocks as its weight asks for."""
    sizes = rows.groupBy(*keys).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    sizes = sizes.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("cuts")).repartition("cuts", *keys[-1:])
    rows = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return rows.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")


def _candidates(node, comp, own, crossing: bool, sketch, estimate: float | None, band: int | None = None):
    """Index pairs of different components whose sketches share a band (the given one first) and allow a link (estimate None: all); in slabs of rows."""
    n = len(node)
    for at in range(0, n, 64):
        x = slice(at, min(n, at + 64))
        apart = (comp[x, None] != comp[None, :]) & (node[x, None] < node[None, :])
        if crossing:
            apart &= own[x, None] != own[None, :]
        p, q = np.nonzero(apart)
        p += at
        for s in range(0, len(p), 65536):
            u, v = p[s : s + 65536], q[s : s + 65536]
            if estimate is None:
                yield u, v
                continue
            equal = sketch[u] == sketch[v]
            keep = equal.any(1) if band is None else equal.argmax(1) == band
            u, v = u[keep], v[keep]
            keep = (sketch[u].view(np.uint16) == sketch[v].view(np.uint16)).mean(1) >= estimate
            if keep.any():
                yield u[keep], v[keep]


def apart_clusters(members: DataFrame, classes: DataFrame, *, block: int = BLOCK, estimate: float = ESTIMATE) -> DataFrame:
    """(a, b) edges that connect all members of different components that share a bucket and whose sketches allow a link.

    A bucket is cut into blocks and two blocks at most meet in a task; a pair is looked at in the first band that it shares.  A
    block yields a spanning forest of its pairs, at most an edge a member, never the pairs.
    """
    rows = _blocked(members, ["band", "key"], block).join(classes.select("node", "sketch"), "node")
    rows = rows.select("band", "key", "i", "j", "own", "node", "comp", "sketch").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")

    def run(batches):
        import pyarrow as pa

        for t in groups(batches, 4):
            if t.num_rows < 2:
                continue
            t = t.sort_by("node")  # labels are least nodes: buckets of one group then mostly name the same few
            own, node, comp = (t.column(k).to_numpy() for k in (4, 5, 6))
            sketch = t.column(7).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            crossing = t.column(2)[0].as_py() != t.column(3)[0].as_py()
            pairs = list(_candidates(node, comp, own, crossing, sketch, estimate, t.column(0)[0].as_py()))
            if pairs:
                u, label = forest(len(node), *map(np.concatenate, zip(*pairs, strict=True)))
                u, label = node[u[u != label]], node[label[u != label]]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(label)], ["a", "b"])

    return mapped(rows, run, "a long, b long")


def cluster_links(clusters: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, *, block: int = 512, estimate: float | None = ESTIMATE) -> DataFrame:
    """(a, b) confirmed links between different components of a cluster (node, comp, cluster); a block yields a spanning forest of its links.

    A set of many shingles counts for more than one, so that a block's sets stay near block * UNIT * 8 bytes.
    """
    rows = clusters.join(classes.select("node", "sketch", F.greatest(F.lit(1), F.ceil(F.col("n_shingles") / UNIT)).alias("w")), "node")
    cut = _blocked(rows, ["cluster"], block, F.col("w")).join(classes.select("node", "sketch"), "node").join(sets, "node")
    rows = cut.select("cluster", "i", "j", "own", "node", "comp", "sketch", "hashes").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches):
        import pyarrow as pa

        for t in groups(batches, 3):
            if t.num_rows < 2:
                continue
            own, node, comp = (t.column(k).to_numpy() for k in (3, 4, 5))
            sketch = t.column(6).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            hashes = [np.frombuffer(x, np.uint64) for x in t.column(7).to_pylist()]
            crossing = t.column(1)[0].as_py() != t.column(2)[0].as_py()
            now, found = comp.copy(), []
            for u, v in _candidates(node, comp, own, crossing, sketch, estimate):
                for x, y in zip(u.tolist(), v.tolist(), strict=True):
                    if now[x] != now[y] and linked(hashes[x], hashes[y], percent):
                        found.append((node[x], node[y]))
                        now[now == now[y]] = now[x]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return mapped(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 75, first_bands: int = 4, second_bands: int = 12, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    component_id is the least doc_id that links reach; kept marks it.  A text of no words, or null, has an empty set and its own
    doc_id.  Rows with one doc_id are one document to the links, which hold for the row of its set that has the least key.  Other
    columns are ignored; an empty table gives no rows; a null doc_id links with nothing and stays null.  exact finds candidates by
    shared shingles instead of sketches: no link can be missed, at a cost of a row for a quarter of all shingles.
    """
    sketched = written(sketch_documents(docs, width=width), "sketches")
    full = sketched.filter("set_key is not null and doc_id is not null")
    classes = written(full.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min_by("sketch", "doc_id").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "classes")
    if exact:
        every = written(shingle_rows(docs.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), width=width), "sets")
        bands = written(prefix_rows(every, percent), "prefixes").select("node", F.lit(0).alias("band"), "key")
    else:
        bands = classes.select("node", F.posexplode("sketch").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("band", "key").repartition("key")
    members = written(bands.join(shared, ["band", "key"]), "members")
    nodes = written(members.select("node").distinct(), "nodes")
    texts = docs.select("doc_id", "text").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = written(shingle_rows(texts, width=width), "sets")
    labels = nodes.select("node", F.col("node").alias("comp"))

    placed = lambda: members.join(labels, "node")
    edges = written(confirm(hub_pairs(placed().filter(F.col("band") < first_bands), 1), sets, percent), "links")
    labels = relabel(labels, edges)
    if exact:
        apart = placed().select("node", "comp", F.col("key").alias("cluster"))
        edges = cluster_links(apart, classes, sets, percent, estimate=None)
    else:
        edges = written(confirm(hub_pairs(placed().filter(F.col("band").between(first_bands, second_bands - 1)), 2), sets, percent), "links")
        labels = relabel(labels, edges)
        near = components(apart_clusters(placed(), classes)).withColumnRenamed("comp", "cluster")
        edges = cluster_links(labels.join(near, "node"), classes, sets, percent)
    labels = relabel(labels, written(edges, "links"))

    of_class = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("comp", "node").alias("comp")).repartition("comp")
    out = sketched.drop("sketch").join(of_class, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))

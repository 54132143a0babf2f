"""Ranked lexical search with block-max pruning over document ranges.

One pass over the texts counts the asked terms of every document and stores the counts; the tasks that search cut the documents, in
the order of the scan, into ranges of BLOCK and make for each the forward index (what each asked term adds to a document's score) and the greatest
such gain of each term.  What a term adds does not depend on the query, so a range's greatest score for a query is at most the sum
of its maxima over the query's terms.  A task sorts its ranges by that bound, scores the documents of the best ones from the
forward index, and stops where the bound falls below the k-th score so far.  A first pass scores only each task's best ranges and
sets a floor that holds for the whole corpus; the second finds everything at or above it, so the result is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import mapped, slices, written
from casemill.llm.spans import LOWER, TERM, buffers, hashes, within, words

#: Documents of a range.
BLOCK = 32
#: Items of a group, and distinct terms they have together: what a task holds.  More items are searched a group at a time.
ITEMS, VOCABULARY = 1024, 500_000
#: Bytes of the index that a task holds at a time, and pairs of a term and a query that are added up at once.
SPAN, PAIRS = 16 << 20, 1 << 21
#: Ranges that a query scores first; then twice as many each time.
FIRST = 4
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text):
    """The distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWERED), F.lit(WORD), F.lit(0)))


class Vocabulary:
    """The asked terms by number, found by hash and confirmed by their bytes."""

    def __init__(self, asked: list[str]):
        coded = [t.encode() for t in asked]
        self.size = np.array([len(c) for c in coded], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(coded), np.uint8)
        self.salt = 0
        while len(np.unique(h := hashes(self.data, self.start, self.size, self.salt))) < len(coded):
            self.salt += 1
        self.order = np.argsort(h)
        self.hash = h[self.order]

    def __len__(self) -> int:
        return len(self.size)

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term): which of the words are asked, and their terms."""
        h = hashes(data, start, size, self.salt)
        at = np.minimum(np.searchsorted(self.hash, h), len(self) - 1)
        word = np.flatnonzero(self.hash[at] == h)
        term = self.order[at[word]]
        same = self.size[term] == size[word]
        word, term = word[same], term[same]
        if len(word):
            differ = data[within(start[word], size[word])] != self.data[within(self.start[term], size[word])]
            same = ~np.logical_or.reduceat(differ, np.cumsum(size[word]) - size[word])
            word, term = word[same], term[same]
        return word, term


def count_terms(docs: DataFrame, asked: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document that has a term: its number of terms with repeats, and how often it has each asked one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, rows=4096):
                raw, places = buffers(some.column(1))
                data, rows = LOWER[raw], some.num_rows
                n, keys = np.zeros(rows, np.int64), []
                for start, size, text in words(data, places, TERM):
                    n += np.bincount(text, minlength=rows)
                    word, term = asked.find(data, start, size)
                    keys.append(text[word] * len(asked) + term)
                key, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
                own = np.bincount(key // len(asked), minlength=rows)
                ends = pa.array(np.concatenate(([0], np.cumsum(own))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % len(asked)).astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(mapped(rows, run, "doc_id long, n long, terms array<int>, tfs array<long>"), "counts")


def weights(counted: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """The weight of each asked term, the number of documents that have a term, and that of all terms with repeats."""
    n, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most VOCABULARY rows
        df[r["t"]] = r["count"]
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64), n, length


def ranges_of(weight: np.ndarray, n_docs: int, length: int, block: int):
    """A function of a batch of counts: its ranges, each with its terms and their greatest gains, and its documents with the gain of each of their terms."""

    def made(batch):
        import pyarrow as pa

        terms_, tfs = batch.column(2), batch.column(3)
        term, tf = terms_.flatten().to_numpy(), tfs.flatten().to_numpy()
        own = np.diff(terms_.offsets.to_numpy()).astype(np.int64)
        m = 50 + 50 * batch.column(1).to_numpy() * n_docs // length
        gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, own)))
        of = np.repeat(np.arange(len(own)) // block, own)
        order = np.lexsort((-gain, term, of))
        first = np.ones(len(order), bool)
        first[1:] = (term[order][1:] != term[order][:-1]) | (of[order][1:] != of[order][:-1])
        top = order[first]
        n = -(-len(own) // block)
        ends = np.minimum(np.arange(n + 1) * block, len(own))
        posts = np.concatenate(([0], np.cumsum(own)))
        listed = lambda at, x: pa.ListArray.from_arrays(pa.array(np.asarray(at, np.int32)), x)
        heads = np.concatenate(([0], np.cumsum(np.bincount(of[top], minlength=n))))
        columns = [
            listed(heads, pa.array(term[top])), listed(heads, pa.array(gain[top])), listed(ends, batch.column(0)), listed(ends, pa.array(own.astype(np.int32))),
            listed(posts[ends], pa.array(term)), listed(posts[ends], pa.array(gain)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["terms", "maxima", "docs", "lengths", "doc_terms", "gains"])

    return made


def build(counted: DataFrame, weight: np.ndarray, n_docs: int, length: int, block: int) -> DataFrame:
    """The index as a table of ranges; rank_documents makes them in the tasks that search, and stores none."""
    kind = "terms array<int>, maxima array<long>, docs array<long>, lengths array<int>, doc_terms array<int>, gains array<long>"
    return written(mapped(counted.filter(F.size("terms") > 0), lambda batches: map(ranges_of(weight, n_docs, length, block), batches), kind), "ranges")


@dataclass
class Asked:
    """The items of a group: their ids, and the terms of all of them one after the other."""

    ids: list
    terms: np.ndarray
    places: np.ndarray

    def by_term(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, items): the items that ask each term."""
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.places))
        order = np.argsort(self.terms, kind="stable")
        return np.searchsorted(self.terms[order], np.arange(size + 1)), item[order]


class Ranges:
    """Some ranges of the index, as flat arrays."""

    def __init__(self, table):
        flat = lambda k: table.column(k).combine_chunks().flatten()
        own = lambda k: np.diff(table.column(k).combine_chunks().offsets.to_numpy()).astype(np.int64)
        self.n = table.num_rows
        self.terms, self.maxima, self.heads = flat(0).to_numpy(), flat(1).to_numpy(), own(0)
        ids = flat(2)
        self.gone = ids.is_null().to_numpy(zero_copy_only=False)
        self.docs = ids.fill_null(2**63 - 1).to_numpy()
        self.doc = np.repeat(np.arange(len(self.docs)), flat(3).to_numpy())
        self.doc_terms, self.gains = flat(4).to_numpy(), flat(5).to_numpy()
        self.posts = np.concatenate(([0], np.cumsum(own(4))))

    def bounds(self, places: np.ndarray, items: np.ndarray, asked: int) -> np.ndarray:
        """(ranges, items): what a document of the range can score at most."""
        out = np.zeros(self.n * asked, np.int64)
        at = np.repeat(np.arange(self.n), self.heads)
        many = places[self.terms + 1] - places[self.terms]
        cut = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()) + PAIRS, PAIRS), side="right")
        low = 0
        for high in np.unique(np.append(cut, len(many))).tolist():
            own = many[low:high]
            item = items[within(places[self.terms[low:high]], own)]
            np.add.at(out, np.repeat(at[low:high], own) * asked + item, np.repeat(self.maxima[low:high], own))
            low = high
        return out.reshape(self.n, asked)

    def score(self, ranges: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a document, score) of the documents in the ranges that have a wanted term."""
        at = within(self.posts[ranges], self.posts[ranges + 1] - self.posts[ranges])
        at = at[wanted[self.doc_terms[at]]]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = self.doc[at]
        new = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
        return doc[new], np.add.reduceat(self.gains[at], new)


class Best:
    """The k best documents of a query so far: by score, then by id, null ids last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.doc, self.gone = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, gone: np.ndarray) -> None:
        score, doc, gone = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.gone, gone)))
        order = np.lexsort((gone, doc, -score))[: self.k]
        self.score, self.doc, self.gone = score[order], doc[order], gone[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def search(index: DataFrame, asked: Asked, size: int, k: int, floors: list[int] | None, made=None) -> DataFrame:
    """(query, item_id, doc_id, score): the k best of each task, or without floors the best of each task's best ranges.

    made makes ranges of each batch of the frame; without it they are ranges already.
    """

    def look(ranges: Ranges, best: list[Best], places: np.ndarray, items: np.ndarray) -> None:
        bound = ranges.bounds(places, items, len(asked.ids))
        wanted = np.zeros(size, bool)
        for i, b in enumerate(best):
            own = asked.terms[asked.places[i] : asked.places[i + 1]]
            wanted[own] = True
            order = np.argsort(-bound[:, i], kind="stable")
            # a bound of the floor itself may hide a tie with a smaller id
            order = order[bound[order, i] >= max(1, b.floor)]
            at, step = 0, FIRST
            while at < len(order) and bound[order[at], i] >= b.floor:
                doc, score = ranges.score(order[at : at + step], wanted)
                keep = score >= max(1, b.floor)
                b.add(score[keep], ranges.docs[doc[keep]], ranges.gone[doc[keep]])
                at, step = at + step, 2 * step
                if floors is None and at >= FIRST + k // BLOCK:
                    break
            wanted[own] = False

    def run(batches):
        import pyarrow as pa

        best = [Best(k, f) for f in floors or [1] * len(asked.ids)]
        places, items = asked.by_term(size)
        held, held_bytes = [], 0
        for batch in batches if made is None else map(made, batches):
            held.append(batch)
            held_bytes += batch.nbytes
            if held_bytes >= SPAN:
                look(Ranges(pa.Table.from_batches(held)), best, places, items)
                held, held_bytes = [], 0
        if held_bytes:
            look(Ranges(pa.Table.from_batches(held)), best, places, items)
        for i, b in enumerate(best):
            if len(b.doc):
                many = len(b.doc)
                yield pa.RecordBatch.from_arrays([pa.array([i] * many, pa.int32()), pa.array([asked.ids[i]] * many, pa.int64()), pa.array(b.doc, mask=b.gone), pa.array(b.score)], ["query", "item_id", "doc_id", "score"])

    return mapped(index, run, "query int, item_id long, doc_id long, score long")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block: int = BLOCK, group_items: int = ITEMS, group_terms: int = VOCABULARY,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, all if fewer score above 0.

    Terms, weights and scores are as the module says; ties go to the smaller doc_id, null ids last.  A text that is null or has no
    term takes no part, as a document or as an item; every row of repeated documents or items counts by itself; a long text is read
    whole, in pieces; other columns are ignored; an empty table on either side gives no rows.  block, group_items and group_terms change
    the work but not the result: where there are more items or terms than a task should hold, the texts are read once a group of items.
    """
    spark = docs.sparkSession
    lists = items.select(F.col(item_col).cast("long").alias("item_id"), terms(F.col(item_text_col)).alias("terms")).filter(F.size("terms") > 0)
    n, total = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    found = None
    groups = max(-(-n // group_items), -(-total // group_terms))
    for g in range(groups):
        part = lists if groups == 1 else lists.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(groups)) == g)
        rows = part.collect()  # bounded by group_items and group_terms
        if not rows:
            continue
        vocabulary = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        flat = np.array([number[t] for r in rows for t in r["terms"]], np.int64)
        asked = Asked([r["item_id"] for r in rows], flat, np.concatenate(([0], np.cumsum([len(r["terms"]) for r in rows]))))
        counted = count_terms(docs, Vocabulary(vocabulary), id_col, text_col)
        weight, n_docs, length = weights(counted, len(vocabulary))
        if not n_docs:
            break
        # made anew in each of the two searches, so that no task writes them
        counted, made = counted.filter(F.size("terms") > 0), ranges_of(weight, n_docs, length, block)
        floors = [1] * len(rows)
        seeds = ranked(search(counted, asked, len(vocabulary), k, None, made), k)
        for r in seeds.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k).collect():  # a row an item at most
            floors[r["query"]] = r["floor"]
        hits = ranked(search(counted, asked, len(vocabulary), k, floors, made), k).select("item_id", "rank", "doc_id", "score")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


RANK_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}') AS t FROM documents
), s AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
a AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM s),
i AS (
  SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}'))) AS term FROM benchmark
), p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term, n_docs),
g AS (
  SELECT r, s.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * s.n * n_docs) // length))) AS gain
  FROM p JOIN w USING (term) JOIN s USING (r), a
), scored AS (SELECT q, item_id, r, doc_id, sum(gain)::BIGINT AS score FROM i JOIN g USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 50
"""

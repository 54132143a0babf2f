"""A stored keyword index of block postings, read in part and searched with early termination.

A build counts the terms of each document in its own row, so that one row a document and term is shuffled, by bucket of the term and
slice of the document; where a bucket and slice hold much, by part of its terms too, so that no task's share grows with the
input.  The postings of a term and slice lie in blocks of BLOCK documents in the order of their ids, and each block
states its greatest count and its least length, which bound what a document in it can score.  Every batch is a segment of its own:
its files are noted by bucket, sorted by term, and statistics are counts that add up over segments, so that one more document costs
what its own terms do.  Documents, postings and counts of a batch become visible together.

A search reads the files of the asked terms' buckets alone and, in them, the row groups that may hold the terms.  Where the asked
terms have many postings, the terms that weigh most give a floor for the k-th score; terms whose bounds together stay below the
floor cannot bring in a document and only complete those that others bring in, and blocks whose bound does not reach it are skipped.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.functions import text
from casemill.operators.retrieval import EPSILON, K1, B, top
from casemill.sources.scratch import stored
from casemill.sources.snapshots import Change, Tables

#: Documents of a block of postings.
BLOCK = 128
#: Bytes of a batch for each bucket of terms and for each slice of documents, and bounds of the number of buckets.
BUCKET_BYTES, SLICE_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 8 << 20, 4 << 30, 8, 16_384
#: Bytes of a batch for each task that makes postings.
TASK_BYTES = 4 << 20
#: A plan's estimate above this is a default.
KNOWN_BYTES = 1 << 58
#: Bytes of a row group, the least that a search reads.
GROUP_BYTES = 1 << 20
#: Distinct terms of stated queries that are read by value; more are joined.
TERMS = 10_000
#: Postings of the asked terms up to which all are scored at once.
DIRECT = 2_000_000
#: Documents a query that are looked for in the ranges of blocks; more only meet the blocks in a join.
CANDIDATES = 1000
#: Scores are rounded to six digits, so a bound this much below the floor still counts.
MARGIN = 1e-5


def term_counts(tokens: Column) -> Column:
    """The distinct tokens of a row as (term, tf, len), counted in the row itself."""
    one = lambda value, then: F.get(F.transform(F.array(value), then), 0)

    def counted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return one(first, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("tf"), F.size(s).alias("len"))))

    return one(F.array_sort(tokens), lambda s: F.when(F.size(s) > 0, counted(s)))


def weight(tf: Column, length: Column, avg: float) -> Column:
    """What a term with idf 1 adds to a document's score; grows with tf and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(avg)))


class KeywordIndex:
    """The index in a folder that the cluster shares.  `lite` keeps no texts, which changes no search.

    buckets and slices: files and shares of a batch; None: by its size.  texts: a table of the same folder that has the documents' texts,
    with its columns of ids and texts; the index keeps none then, and takes them from there.
    """

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int | None = None, slices: int | None = None, lite: bool = False, id_type: str = "long", block: int = BLOCK, tables: Tables | None = None, texts: tuple[str, str, str] | None = None):
        self.spark, self.folder, self.buckets, self.slices, self.lite, self.id_type, self.block = spark, folder.rstrip("/"), buckets, slices, lite or texts is not None, id_type, block
        self.texts = None if lite else texts
        self.tables = tables or Tables(spark, self.folder)
        self.posting = f"slice int, term string, first {id_type}, last {id_type}, n long, max_tf int, min_len int, posts array<struct<id:{id_type},tf:int,len:int>>"
        self.document = f"id {id_type}, ref string, {'' if lite else 'text string, '}added timestamp"

    def is_built(self) -> bool:
        """Whether there is an index; one of no documents counts as none."""
        return self._sizes(self.tables.state())["n_docs"] > 0

    def clear(self) -> None:
        """Removes the index; that there is none is no error."""
        self.tables.clear()

    def _sizes(self, state: dict) -> dict:
        return state["notes"].get("keywords", {"n_docs": 0, "total_tokens": 0})

    def build(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ref_col: str | None = None, mode: str = "overwrite") -> KeywordIndex:
        """Indexes docs, in place of what is there; mode "append" adds them as a segment.

        A null text has no terms; ids should be new (drop those that exist with store.unseen first).  Later batches win in get().
        """
        change = self.tables.begin()
        self.add(change, docs, id_col=id_col, text_col=text_col, ref_col=ref_col, mode=mode)
        change.commit()
        return self

    def add(self, change: Change, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ref_col: str | None = None, mode: str = "append") -> None:
        """What build() does, as part of a change that others commit."""
        if mode == "overwrite":
            for name in ("postings", "histogram", "documents"):
                change.state["tables"].pop(name, None)
            change.note("keywords", {"n_docs": 0, "total_tokens": 0})
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size > KNOWN_BYTES:  # of a frame that is not read from files nothing is known
            size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        words = docs.select(F.col(id_col).cast(self.id_type).alias("id"), F.explode(term_counts(text.tokens(F.col(text_col)))).alias("w")).select("id", "w.*")
        tokens = self._add_postings(change, words, size)
        ref = F.col(ref_col) if ref_col else F.lit(None)
        kept = docs.select(F.col(id_col).cast(self.id_type).alias("id"), ref.cast("string").alias("ref"), *([] if self.lite else [F.coalesce(F.col(text_col), F.lit("")).alias("text")]), F.current_timestamp().alias("added"))
        before = len(change.state["tables"].get("documents", {"files": []})["files"])
        change.append("documents", kept)
        n = change.read_files("documents", change.state["tables"]["documents"]["files"][before:]).count()
        sizes = self._sizes(change.state)
        change.note("keywords", {"n_docs": sizes["n_docs"] + n, "total_tokens": sizes["total_tokens"] + tokens})

    def _add_postings(self, change: Change, words: DataFrame, size: int) -> int:
        """Adds (id, term, tf, len) as a segment, with what it changes in the counts; gives its number of tokens."""
        buckets = self.buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
        slices = self.slices or max(1, min(65_536, size // SLICE_BYTES))
        # however few buckets are asked for, a task has about TASK_BYTES of the input, and what it sorts does not grow with the batch
        parts = max(1, min(-(-size // (TASK_BYTES * buckets * slices)), 100_000 // (buckets * slices)))
        words = words.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "slice": F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"), "part": self._part(parts)})
        cells, most = buckets * slices * parts, 100_000
        words = words.withColumn("cell", ((F.col("bucket") * slices + F.col("slice")) * parts + F.col("part")) % min(cells, most))
        words = words.repartitionById(min(cells, most), F.col("cell"))  # a cell a task: hashed, several of them would meet in one
        posts = self._blocks(words)
        before = list(change.state["tables"].get("postings", {"files": []})["files"])
        change.append("postings", posts, by="bucket", extra={"of": buckets, "parts": parts}, options={"parquet.block.size": str(GROUP_BYTES)})
        new = change.state["tables"]["postings"]["files"][len(before):]
        added = change.read_files("postings", new)
        df = added.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("posts", F.lit(0).cast("long"), lambda s, p: s + p["tf"])).alias("tokens"))
        if before:
            old = self._headers(before, df, change).groupBy("term").agg(F.sum("n").alias("was"))
            df = df.join(old, "term", "left").fillna({"was": 0})
        else:
            df = df.withColumn("was", F.lit(0).cast("long"))
        # a term leaves the number of those of its old document frequency and joins that of its new one
        now, then = F.struct((F.col("df") + F.col("was")).alias("df"), F.lit(1).cast("long").alias("terms"), "tokens"), F.struct(F.col("was").alias("df"), F.lit(-1).cast("long").alias("terms"), F.lit(0).cast("long").alias("tokens"))
        moved = df.select(F.explode(F.array(now, then)).alias("m")).select("m.*").filter("df > 0").groupBy("df").agg(F.sum("terms").alias("terms"), F.sum("tokens").alias("tokens"))
        at = len(change.state["tables"].get("histogram", {"files": []})["files"])
        change.append("histogram", moved.coalesce(1))
        return change.read_files("histogram", change.state["tables"]["histogram"]["files"][at:]).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    @staticmethod
    def _part(parts: int) -> Column:
        """A term's part of its bucket; another hash than that of the buckets, which would leave parts empty."""
        return F.pmod(F.hash("term"), F.lit(parts)).cast("int")

    def _blocks(self, words: DataFrame) -> DataFrame:
        """Postings (cell, bucket, slice, part, term, id, tf, len), partitioned by cell, which follows from bucket, slice and part, in blocks."""
        order = Window.partitionBy("cell", "bucket", "slice", "part", "term").orderBy("id")
        words = words.withColumn("block", F.floor((F.row_number().over(order) - 1) / self.block).cast("int"))
        posts = words.groupBy("cell", "bucket", "slice", "part", "term", "block").agg(F.array_sort(F.collect_list(F.struct("id", "tf", "len"))).alias("posts"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        posts = posts.select("bucket", "slice", "term", F.get("posts", F.lit(0))["id"].alias("first"), F.element_at("posts", -1)["id"].alias("last"), F.size("posts").cast("long").alias("n"), "max_tf", "min_len", "posts")
        return posts.sortWithinPartitions("bucket", "term", "slice", "first")

    def remove(self, change: Change, ids: DataFrame) -> None:
        """Takes documents (id) out, as part of a change: the files of their terms' buckets are written anew without them, others stay."""
        ids = stored(ids.select(F.col("id").cast(self.id_type).alias("id")).distinct(), "removed")
        docs = change.read("documents", self.document).select("id", *([] if self.lite else ["text"]))
        if self.texts:
            docs = self._with_texts(docs, change.read(self.texts[0], f"{self.texts[1]} {self.id_type}, {self.texts[2]} string"))
        gone = docs.join(ids, "id", "left_semi")
        n = gone.count()
        if not n:
            return
        files = change.state["tables"]["postings"]["files"]
        if not self.lite or self.texts:
            own = gone.select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct().limit(TERMS + 1).collect()
            if len(own) <= TERMS:
                files = self._of_terms(files, [r["term"] for r in own])
        if files:
            apart = change.read_files("postings", files).withColumn("file", F.input_file_name()).select("file", "slice", "term", F.explode("posts").alias("p")).select("file", "slice", "term", "p.*")
            apart = stored(apart.join(ids.withColumn("gone", F.lit(True)), "id", "left").withColumn("gone", F.col("gone").isNotNull()), "apart")
            old = {f["path"]: f for f in files}
            lost = apart.filter("gone").groupBy("term").agg(F.count("*").alias("lost"), F.sum("tf").alias("tokens"))
            paths = [next(p for p in old if r["file"].endswith(p)) for r in apart.filter("gone").select("file").distinct().collect()]
            was = self._headers(change.state["tables"]["postings"]["files"], lost, change).groupBy("term").agg(F.sum("n").alias("was"))
            moved = stored(lost.join(was, "term"), "moved")
            now, then = F.struct((F.col("was") - F.col("lost")).alias("df"), F.lit(1).cast("long").alias("terms"), (-F.col("tokens")).alias("tokens")), F.struct(F.col("was").alias("df"), F.lit(-1).cast("long").alias("terms"), F.lit(0).cast("long").alias("tokens"))
            spread = moved.select(F.explode(F.array(now, then)).alias("m")).select("m.*").groupBy("df").agg(F.sum("terms").alias("terms"), F.sum("tokens").alias("tokens"))
            lost_tokens = moved.agg(F.sum("tokens")).first()[0] or 0
            table = change.state["tables"]["postings"]
            table["files"] = [f for f in table["files"] if f["path"] not in paths]
            kinds = {p: (f["of"], f.get("parts", 1)) for p, f in old.items()}
            for of, parts in sorted({kinds[p] for p in paths}):
                names = [p for p in paths if kinds[p] == (of, parts)]
                rest = apart.filter(F.exists(F.array(*map(F.lit, names)), lambda p: F.col("file").endswith(p)) & ~F.col("gone")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(of)).cast("int")).withColumn("part", self._part(parts)).withColumn("cell", F.lit(0))
                change.append("postings", self._blocks(rest.repartition(len(names), "bucket", "slice", "part")), by="bucket", extra={"of": of, "parts": parts}, options={"parquet.block.size": str(GROUP_BYTES)})
            change.append("histogram", spread.coalesce(1))
        else:
            lost_tokens = 0
        sizes = self._sizes(change.state)
        change.delete("documents", ids, "id")
        change.note("keywords", {"n_docs": sizes["n_docs"] - n, "total_tokens": sizes["total_tokens"] - lost_tokens})

    def compact(self) -> None:
        """All segments as one, of buckets by the size of all; nothing that a search or get() gives changes."""
        change = self.tables.begin()
        words, kept = self.postings(), self.documents()
        size = int(self.tables.read("postings", self.posting)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        for name in ("postings", "histogram"):
            change.state["tables"].pop(name, None)
        self._add_postings(change, words, size)
        change.replace("documents", kept)
        change.commit()

    def _headers(self, files: list[dict], terms: DataFrame, change: Change) -> DataFrame:
        """The postings of a column of terms in some files: of few terms those of their buckets, of many those that a join finds."""
        few = [r["term"] for r in terms.select("term").limit(TERMS + 1).collect()]
        if len(few) > TERMS:
            return change.read_files("postings", files).select("term", "n").join(terms.select("term"), "term", "left_semi")
        chosen = self._of_terms(files, few)
        if not chosen:
            return self.spark.createDataFrame([], "term string, n long")
        return change.read_files("postings", chosen).filter(F.col("term").isin(few)).select("term", "n")

    def _of_terms(self, files: list[dict], terms: list[str]) -> list[dict]:
        """The files that may hold one of the terms, by the bucket each file is of."""
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.xxhash64("term").alias("h")) if terms else None
        hashes = [r["h"] for r in rows.collect()] if terms else []
        wanted: dict[int, set[int]] = {}
        for f in files:
            if f["of"] not in wanted:
                wanted[f["of"]] = {h % f["of"] for h in hashes}
        return [f for f in files if f["low"] in wanted[f["of"]]]

    def postings(self) -> DataFrame:
        """(term, id, tf, len), a row a document and term."""
        return self.tables.read("postings", self.posting).select("term", F.explode("posts").alias("p")).select("term", "p.*")

    def _with_texts(self, docs: DataFrame, texts: DataFrame) -> DataFrame:
        return docs.join(texts.select(F.col(self.texts[1]).alias("id"), F.coalesce(self.texts[2], F.lit("")).alias("text")), "id", "left")

    def documents(self) -> DataFrame:
        return self.tables.read("documents", self.document)

    def _spread(self) -> DataFrame:
        """(df, terms): how many terms have each document frequency, summed over the segments."""
        return self.tables.read("histogram", "df long, terms long, tokens long").filter("df > 0").groupBy("df").agg(F.sum("terms").alias("terms")).filter("terms > 0")

    def _floor_of_idf(self, n: int) -> tuple[float | None, int]:
        """What stands for negative idf, a share of the mean over the vocabulary, and the size of that."""
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        r = self._spread().agg(F.sum(raw * F.col("terms")).alias("s"), F.sum("terms").alias("v")).first()
        return (EPSILON * r["s"] / r["v"], r["v"]) if r["v"] else (None, 0)

    def stats(self) -> DataFrame:
        """One row: n_docs, unique_refs, total_tokens, low (the floor of negative idf), vocabulary, avg_tokens."""
        sizes = self._sizes(self.tables.state())
        n, total = sizes["n_docs"], sizes["total_tokens"]
        low, vocabulary = self._floor_of_idf(n)
        refs = self.documents().agg(F.count_distinct("ref").alias("unique_refs"))
        return refs.select(F.lit(n).cast("long").alias("n_docs"), "unique_refs", F.lit(total).cast("long").alias("total_tokens"), F.lit(low).cast("double").alias("low"), F.lit(vocabulary).cast("long").alias("vocabulary"), F.lit(total / n if n else 0.0).alias("avg_tokens"))

    def idf(self) -> DataFrame:
        """(term, df, idf); negative ones become EPSILON times the mean over the vocabulary, negatives included."""
        n = self._sizes(self.tables.state())["n_docs"]
        df = self.tables.read("postings", self.posting).groupBy("term").agg(F.sum("n").alias("df"))
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return df.select("term", "df", F.when(raw < 0, F.lit(self._floor_of_idf(n)[0])).otherwise(raw).alias("idf"))

    def _asked(self, queries: DataFrame) -> list[tuple]:
        asked = queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("asked"))
        return [tuple(r) for r in asked.collect()]  # the terms of the stated queries

    def search(self, queries: DataFrame, k: int, *, within: DataFrame | None = None, direct: int = DIRECT) -> DataFrame:
        """(query_id, id, score, rank) of the k best documents a query (query_id, query); repeated terms count; ties by id; scores above 0.

        queries are a stated set, whose terms the driver knows.  An index that is not built gives no rows.  within (id) keeps the search
        to some documents; statistics stay those of all.  direct: postings up to which nothing is skipped, which changes no result.
        """
        state = self.tables.state()
        sizes, asked = self._sizes(state), self._asked(queries)
        kind = queries.schema["query_id"].dataType.simpleString()
        nothing = self.spark.createDataFrame([], f"query_id {kind}, id {self.id_type}, score double, rank int")
        if not sizes["n_docs"] or not asked or not sizes["total_tokens"]:
            return nothing
        terms = sorted({t for _, t, _ in asked})
        files = self._of_terms(self.tables.files("postings", state=state), terms)
        posts = self.tables.read("postings", self.posting, files=files)
        if len(terms) <= TERMS:
            posts = posts.filter(F.col("term").isin(terms))
        else:
            posts = posts.join(self.spark.createDataFrame([(t,) for t in terms], "term string"), "term", "left_semi")
        n, avg = sizes["n_docs"], sizes["total_tokens"] / sizes["n_docs"]
        heads = {r["term"]: r for r in posts.groupBy("term").agg(F.sum("n").alias("df"), F.max(weight(F.col("max_tf"), F.col("min_len"), avg)).alias("most")).collect()}  # a row an asked term
        low = self._floor_of_idf(n)[0]
        idf = {t: (raw if (raw := math.log(n - r["df"] + 0.5) - math.log(r["df"] + 0.5)) >= 0 else low) for t, r in heads.items()}
        asked = [(q, t, c * idf[t], c * idf[t] * heads[t]["most"]) for q, t, c in asked if t in heads]
        if not asked:
            return nothing
        many = sum(heads[t]["df"] for _, t, *_ in asked)
        if many <= direct or within is not None or low < 0:
            scored = self._scored(posts, asked, kind, avg, within)
        else:
            scored = self._pruned(posts, asked, kind, avg, k, {t: r["df"] for t, r in heads.items()})
        return top(scored.withColumn("score", F.round("score", 6)).filter("score > 0"), k)

    def _met(self, posts: DataFrame, asked: list[tuple], kind: str, avg: float) -> DataFrame:
        """Blocks with the queries that ask for them (query_id, w, others), and what a document of the block adds at most."""
        rows = self.spark.createDataFrame(asked, f"query_id {kind}, term string, w double, others double")
        rows = F.broadcast(rows) if len(asked) <= TERMS else rows
        return posts.join(rows, "term").withColumn("bound", F.col("w") * weight(F.col("max_tf"), F.col("min_len"), avg))

    def _parts(self, met: DataFrame, avg: float) -> DataFrame:
        rows = met.select("query_id", "w", F.explode("posts").alias("p"))
        return rows.select("query_id", F.col("p.id").alias("id"), (F.col("w") * weight(F.col("p.tf"), F.col("p.len"), avg)).alias("part"))

    def _scored(self, posts: DataFrame, asked: list[tuple], kind: str, avg: float, within: DataFrame | None = None) -> DataFrame:
        parts = self._parts(self._met(posts, asked, kind, avg), avg)
        if within is not None:
            parts = parts.join(within.select("id"), "id", "left_semi")
        return parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"))

    def _pruned(self, posts: DataFrame, asked: list[tuple], kind: str, avg: float, k: int, df: dict[str, int]) -> DataFrame:
        """All documents that can be among the k best, with their whole scores."""
        of = defaultdict(list)
        for q, t, w, most in asked:
            of[q].append((most, t, w))
        # the heaviest terms that together have k postings, and more where cheap: k of their documents set the floor
        seeds = []
        for q, own in of.items():
            have = 0
            for most, t, w in sorted(own, reverse=True):
                if have >= k:
                    break
                seeds.append((q, t, w, 0.0))
                have += df[t]
        best = top(self._scored(posts, seeds, kind, avg), k)
        floors = {r["query_id"]: r["floor"] for r in best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k).collect()}  # a row a query
        leading, completing, spare = [], [], []
        for q, own in of.items():
            floor, total, below, left = floors.get(q, 0.0) - MARGIN, sum(m for m, *_ in own), 0.0, 0.0
            for most, t, w in sorted(own):
                below += most
                # a document that has only terms of this list stays below the floor
                if below < floor:
                    left = below
                (completing if below < floor else leading).append((q, t, w, total - most))
            spare.append((q, left, floor))
        rest = F.broadcast(self.spark.createDataFrame(spare, f"query_id {kind}, spare double, floor double"))  # a row a stated query
        met = self._met(posts, leading, kind, avg).join(rest, "query_id").filter(F.col("bound") + F.col("others") >= F.col("floor"))
        # a block that is skipped may hold a part of a document that is found, but no document of it reaches the floor
        first = self._parts(met, avg).groupBy("query_id", "id").agg(F.sum("part").alias("part")).join(rest, "query_id")
        first = stored(first.filter(F.col("part") + F.col("spare") >= F.col("floor")).select("query_id", "id", "part"), "leading")
        if not completing:
            return first.withColumnRenamed("part", "score")
        more = self._met(posts, completing, kind, avg)
        most = first.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        if most <= CANDIDATES:
            # only the blocks that have one of these documents in their range
            wanted = first.groupBy("query_id").agg(F.collect_list("id").alias("ids"))
            more = more.join(F.broadcast(wanted), "query_id").filter(F.exists("ids", lambda i: i.between(F.col("first"), F.col("last"))))
        parts = self._parts(more, avg).join(first.select("query_id", "id"), ["query_id", "id"], "left_semi")
        return first.unionByName(parts).groupBy("query_id", "id").agg(F.sum("part").alias("score"))

    def get(self, ids: DataFrame) -> DataFrame:
        """The stored documents of ids (id), the last stored of a repeated one; ids that are not there give no row."""
        found = self.documents().join(ids.select("id").distinct(), "id", "left_semi")
        if self.texts:
            found = self._with_texts(found.select("id", "ref", "added"), self.tables.read(self.texts[0], f"{self.texts[1]} {self.id_type}, {self.texts[2]} string")).select("id", "ref", "text", "added")
        others = [c for c in found.columns if c not in ("id", "added")]
        return found.groupBy("id").agg(F.max_by(F.struct(*others), F.struct("added", *others)).alias("d")).select("id", "d.*")

"""Sections, sentences and token-budget chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.functions.encoding import BytePairs

# The four sections in output order and their headings, alone or behind a number.
HEADINGS = {
    "background": ("BACKGROUND|INTRODUCTION|THE APPLICATION", "BACKGROUND|INTRODUCTION"),
    "facts": ("THE FACTS|FACTS|EVIDENCE|THE EVIDENCE|FINDINGS OF FACT", "FACTS|THE FACTS|EVIDENCE"),
    "reasoning": ("REASONS|THE REASONS|REASONING|THE TRIBUNAL'S REASONS|DISCUSSION", "REASONS|REASONING|DISCUSSION"),
    "decision": ("DECISION|THE DECISION|DETERMINATION|ORDER|THE ORDER|CONCLUSION", "DECISION|DETERMINATION|ORDER"),
}
CHUNK_TOKENS, OVERLAP_TOKENS = 500, 50


def section_list(text: Column) -> Column:
    """array<struct<section, ord, body>> of a text: what stands between headings, in section order; of a repeated section the last with a
    body; else all as unknown (ord 0).  A blank or null text has none.  Row-local: nothing is shuffled."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")

    def kind(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, (plain, numbered) in reversed(HEADINGS.items()):
            out = F.when(line.rlike(rf"(?i)^\s*(?:{plain})\s*$|^\s*\d+\.\s*(?:{numbered})\s*$"), name).otherwise(out)
        return out

    marked = F.filter(F.transform(lines, lambda x, i: F.struct(kind(x).alias("section"), i.alias("at"))), lambda x: x["section"].isNotNull())

    def bodies(heads: Column) -> Column:
        def body(x: Column, k: Column) -> Column:
            until = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines))
            return F.struct(x["section"].alias("section"), T.strip(F.array_join(F.slice(lines, x["at"] + 2, until - x["at"] - 1), "\n")).alias("body"))

        return F.filter(F.transform(heads, body), lambda x: x["body"] != "")

    def last(found: Column) -> Column:
        def of(name: str, place: int) -> Column:
            own = F.try_element_at(F.filter(found, lambda x: x["section"] == name), F.lit(-1))
            return F.when(own.isNotNull(), F.struct(F.lit(name).alias("section"), F.lit(place).alias("ord"), own["body"].alias("body")))

        return F.array_compact(F.array(*[of(name, k + 1) for k, name in enumerate(HEADINGS)]))

    everything = F.struct(F.lit("unknown").alias("section"), F.lit(0).alias("ord"), T.strip(whole).alias("body"))
    rest = F.filter(F.array(everything), lambda x: x["body"] != "")
    # most texts have no heading at all: one search of the text tells
    any_heading = "|".join(f"(?:\\d+\\.\\s*)?(?:{plain}|{numbered})" for plain, numbered in HEADINGS.values())
    found = F.get(F.transform(F.array(F.get(F.transform(F.array(marked), bodies), F.lit(0))), last), F.lit(0))
    found = F.when(whole.rlike(rf"(?im)^\s*(?:{any_heading})\s*$"), found).otherwise(F.slice(F.array(everything), 1, 0))
    return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(rest)), F.lit(0))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, ord, body): a row for each section of section_list()."""
    return docs.select(F.col(id_col).alias("id"), F.explode(section_list(F.col(text_col))).alias("s")).select("id", "s.section", "s.ord", "s.body")


def token_windows(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, window, tokens): windows of `size` words, each `size - overlap` behind the one before; the last may be overlap alone."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))
    return rows.select("id", "w", F.posexplode(starts).alias("window", "at")).select("id", "window", F.slice("w", F.col("at") + 1, F.lit(size)).alias("tokens"))


def pack_sentences(counts: list[int], size: int, overlap: int) -> list[list[int]]:
    """Chunks of sentence indices.  A sentence over size stands alone; a chunk that would grow past size is closed, and the next
    begins with the closed one's last sentences that fit the overlap (and is not measured again)."""
    out: list[list[int]] = []
    now: list[int] = []
    held = 0
    for k, n in enumerate(counts):
        if n > size:
            if now:
                out.append(now)
            out.append([k])
            now, held = [], 0
            continue
        if held + n > size and now:
            out.append(now)
            tail: list[int] = []
            kept = 0
            for j in reversed(now):
                if kept + counts[j] > overlap:
                    break
                tail.insert(0, j)
                kept += counts[j]
            now, held = tail, kept
        now = [*now, k]
        held += n
    if now:
        out.append(now)
    return out


def chunks(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, id_col: str = "doc_id", text_col: str = "text", encoder: BytePairs | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, id, chunk_index, section, text, token_count, and the document's columns to keep): sections in order, sentences packed by tokens, ids numbered over the document.

    A document is one row, so nothing is shuffled: sentences and their tokens are counted in the row, and one Arrow pass packs them.
    Tokens are words and marks, or with an encoder those of its vocabulary: a sentence over size is then cut between its tokens, and a
    chunk's count is that of its joined text.
    """
    own = F.struct(F.col(id_col).alias("id"), *keep)  # what a document's chunks share passes as it is
    parted = docs.select(own.alias("id"), section_list(F.col(text_col)).alias("parts"))
    parted = parted.select("id", "parts.section", F.transform("parts.body", T.sentences).alias("sents"))
    parted = parted.select("id", "section", F.transform("sents", lambda s: F.array_join(s, "\u0001")).alias("sents"), (F.lit(None).cast("array<array<int>>") if encoder else F.transform("sents", lambda s: F.transform(s, T.token_count))).alias("counts"))

    def fold(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, names, bodies, counted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = 0
                for name, body, counts in zip(names, bodies, counted or [None] * len(names), strict=True):
                    sents = body.split("\x01")
                    if encoder:
                        counts = [len(encoder.ids(s)) for s in sents]
                    for part in pack_sentences(counts, size, overlap):
                        long = len(part) == 1 and counts[part[0]] > size
                        if encoder and long:
                            ids = encoder.ids(sents[part[0]])
                            cut = [ids[a : a + size] for a in range(0, len(ids), size - overlap)]
                            made = [(encoder.text(c), len(c)) for c in cut]
                        elif encoder:
                            joined = " ".join(sents[k] for k in part)
                            made = [(joined, len(encoder.ids(joined)))]
                        elif long:
                            words = sents[part[0]].split()
                            made = [(" ".join(words[a : a + size]), None) for a in range(0, len(words), size - overlap)]
                        else:
                            made = [(" ".join(sents[k] for k in part), sum(counts[k] for k in part))]
                        for text, n in made:
                            out.append((doc, index, name, text, n))
                            index += 1
            kinds = (batch.schema.field("id").type, pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds, strict=True)], ["id", "chunk_index", "section", "text", "n"])

    kind = parted.schema["id"].dataType.simpleString()
    packed = parted.select("id", "section", "sents", "counts").mapInArrow(fold, f"id {kind}, chunk_index int, section string, text string, n int")
    count = F.coalesce("n", T.token_count(F.col("text")))  # tokens never span the space between sentences; windows of words are counted anew
    return packed.select(F.concat_ws("_", F.col("id.id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "id.id", "chunk_index", "section", "text", count.alias("token_count"), *[f"id.{c}" for c in keep])

"""Text normalisation, PII redaction and tokens as Column expressions, so that Catalyst sees through all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal replacements in their order, noise, PII and citation patterns.  Java and RE2 read them alike.
ENCODING = (
    ("â\u0080\u0099", "'"), ("â\u0080\u009c", '"'), ("â\u0080\u009d", '"'), ("â\u0080\u0094", "-"), ("â\u0080\u0093", "-"),
    ("Â£", "£"), ("Â", ""), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."),
)
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOISE = (
    rf"(?m)^{SPACE}*Page{SPACE}+\d+{SPACE}+of{SPACE}+\d+{SPACE}*$",
    rf"(?m)^{SPACE}*-{SPACE}*\d+{SPACE}*-{SPACE}*$",
    rf"(?is)BAILII:{SPACE}*Copyright Policy.*?Donate to BAILII",
    r"\n{3,}",
    r"[\x{a0}\x{2000}-\x{200b}\x{2028}\x{2029}]+",
)
WHITESPACE = (("\t", " "), ("\r\n", "\n"), ("\r", "\n"), (" +", " "), ("\n{3,}", "\n\n"), (" *\n *", "\n"))
PII = (
    ("postcode", r"(?i)\b[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}\b", "[POSTCODE]"),
    ("phone", r"\b(?:0[0-9]{10}|(?:\+44|0044)\s?[0-9]{10}|\(?0[0-9]{3,4}\)?\s?[0-9]{3}\s?[0-9]{4})\b", "[PHONE]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    ("bank", r"\b(?:[0-9]{6}[-\s]?[0-9]{8}|[0-9]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{2})\b", "[BANK_DETAILS]"),
)
CITATION = r"\[\d{4}\]\s*(?:UKFTT|EWCA|EWHC|UKUT|UKSC)\s+[A-Z0-9_]+(?:\s+\([^)]+\))?"
NOT_TOKEN = r"[^\p{L}\p{N}_\s-]"
SENTENCE_CUT = r"([.!?])\s+([A-Z])"


def _once(value: Column, then) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def fix_encoding(text: Column) -> Column:
    """The replacements in their order; a text without any of their first letters is left as it is."""

    def replaced(t: Column) -> Column:
        for old, new in ENCODING:
            t = F.replace(t, F.lit(old), F.lit(new))
        return t

    odd = F.translate(text, "".join(sorted({old[0] for old, _ in ENCODING})), "")
    return F.when(F.length(odd) == F.length(text), text).otherwise(replaced(text))


def remove_noise(text: Column, *, preserve_paragraphs: bool = False) -> Column:
    """Page numbers, boilerplate, blank runs and odd spaces become one space each; preserve_paragraphs keeps blank runs for later."""
    for pattern in NOISE:
        if not (preserve_paragraphs and pattern == r"\n{3,}"):
            text = F.regexp_replace(text, pattern, " ")
    return text


def normalise_whitespace(text: Column) -> Column:
    for old, new in WHITESPACE:
        text = F.regexp_replace(text, old, new)
    return text


def redact(text: Column) -> Column:
    for _, pattern, mark in PII:
        text = F.regexp_replace(text, pattern, mark.replace("[", r"\[").replace("]", r"\]"))
    return text


def pii_counts(text: Column) -> dict[str, Column]:
    """How often each kind is redacted, each counted on text that the earlier kinds have redacted."""
    found = {}
    for kind, pattern, mark in PII:
        found[kind] = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
        text = F.regexp_replace(text, pattern, mark)
    return found


def detect_pii(text: Column) -> Column:
    """array<struct<kind, text, start, end>> over the raw text, by kind and then position; kinds may overlap.  Offsets count characters from 0."""

    def of(kind: str, pattern: str) -> Column:
        found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
        size = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x))

        def one(x: Column, k: Column) -> Column:
            start = size(F.slice(between, 1, k + 1)) + size(F.slice(found, 1, k))
            return F.struct(F.lit(kind).alias("kind"), x.alias("text"), start.alias("start"), (start + F.length(x)).alias("end"))

        return F.transform(found, one)

    return F.concat(*[of(kind, pattern) for kind, pattern, _ in PII])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean(text: Column, *, pii: bool = True, preserve_paragraphs: bool = False) -> Column:
    """Encoding, noise, whitespace, PII, strip, in this order; null gives an empty text."""
    out = normalise_whitespace(remove_noise(fix_encoding(text), preserve_paragraphs=preserve_paragraphs))
    return F.coalesce(strip(redact(out) if pii else out), F.lit(""))


def tokens(text: Column) -> Column:
    """Search tokens: lower case, hyphens kept inside, no single letters but s and a, digits only if four of them."""
    words = F.split(F.regexp_replace(F.lower(text), NOT_TOKEN, " "), r"\s+")
    return F.filter(words, lambda w: ((F.length(w) >= 2) | w.isin("s", "a")) & (~w.rlike(r"^[0-9]+$") | (F.length(w) == 4)))


def token_count(text: Column) -> Column:
    """Words and punctuation marks: the offline stand-in for a tokenizer's count."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")), F.lit(0))


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, SENTENCE_CUT, "$1\u0001$2"), "\u0001")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def snippet(text: Column, size: int = 500) -> Column:
    return F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "...").otherwise(""))


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.8, "High").when(x >= 0.6, "Medium").when(x >= 0.4, "Low").otherwise("Very Low")


def percentage(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def issue_title(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def outcome_label(x: Column) -> Column:
    """Labels of both vocabularies that occur for outcomes."""
    out = F.when(x.isin("tenant_favored", "tenant_win"), "Tenant Likely to Win").when(x.isin("landlord_favored", "landlord_win"), "Landlord Likely to Win")
    return out.when(x == "split", "Likely Split Decision").when(x == "uncertain", "Outcome Uncertain").otherwise(x)

"""Fields from references, paths, HTML pages and JSON answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Patterns of page fields, in the order in which they are tried.
META_TITLE, META_DATE, META_ID = (rf'(?is)<meta\s+name="DC\.{name}"\s+content="([^"]*)"' for name in ("title", "date", "identifier"))
TITLE, TITLE_CITATION, HEADING = r"(?is)<title[^>]*>(.*?)</title>", r"\s*\[?\d{4}\]?\s*UK\w+\s*\S+$", r"(?is)<h[12][^>]*>(.*?)</h[12]>"
VERSUS, PAIR = r"(?i)^(.+?)\s+(?:vs?\.?|vs\.?)\s+(.+)", r"(?i)^(.+?)\s+(?:and|&)\s+(.+)"
NEAR_DATES = (r"(\d{1,2}\s+\w+\s+\d{4})", r"(\d{1,2}/\d{1,2}/\d{4})", r"(\d{4}-\d{2}-\d{2})")
DECISION_DATES = (
    (r"(?i)(?:dated?|decided?)\s*:?\s*(\d{1,2}\s+\w+\s+\d{4})", "d MMMM yyyy"), (r"(?i)(?:dated?|decided?)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})", "d/M/yyyy"),
    (r"(?i)decision\s+date\s*:?\s*(\d{1,2}\s+\w+\s+\d{4})", "d MMMM yyyy"),
)
JUDGES = (r"(?:Judge|Tribunal Judge|Deputy Judge)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"(?:Before|Presided by):\s*(?:Judge\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)")
CASE_REFERENCE, IN_PARENTHESES = r"^[A-Z]{2,4}_", r"\(([^)]+)\)"
# Ours: where an entry of a list page begins (the element around a link), and its link.
ENTRY, ANCHOR = r"(?i)<(?:li|p|td|div|dd|dt)\b", r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clean_reference(ref: Column) -> Column:
    return F.replace(F.replace(F.trim(ref), F.lit(".html"), F.lit("")), F.lit(".pdf"), F.lit(""))


def reference_region(ref: Column) -> Column:
    parts = F.split(ref, "_")
    return F.when(F.size(parts) >= 3, parts[0])


def reference_type(ref: Column) -> Column:
    """The first later part of three letters."""
    parts = F.split(ref, "_")
    later = F.filter(F.slice(parts, 2, 1 << 20), lambda p: p.rlike("^[A-Za-z]{3}$"))
    return F.when(F.size(parts) >= 3, F.try_element_at(later, F.lit(1)))


def reference_from_path(path: Column) -> Column:
    parts = F.split(path, "/")
    parent, above = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
    return clean_reference(F.when(parent == "decision", above).otherwise(parent))


def year_from_path(path: Column, as_of_year: int) -> Column:
    return F.coalesce(_found(path, r"(20[0-2][0-9])").cast("int"), F.lit(as_of_year))


def category_from_path(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("deposit"), "deposit").when(low.contains("adjacent"), "adjacent").otherwise("other")


def html_title(html: Column) -> Column:
    title = F.regexp_replace(F.trim(_found(html, TITLE)), TITLE_CITATION, "")
    return F.coalesce(_found(html, META_TITLE), F.nullif(title, F.lit("")), F.trim(_found(html, HEADING)))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go with their bodies, then tags; entities are resolved, blanks collapse."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def parties(title: Column) -> Column:
    """`A v B` from "v", "v." or "vs"; else `A & B` from "and" or "&"; null if neither."""
    join = lambda p, mid: F.concat(F.trim(F.regexp_extract(title, p, 1)), F.lit(mid), F.trim(F.regexp_extract(title, p, 2)))
    return F.when(title.rlike(VERSUS), join(VERSUS, " v ")).when(title.rlike(PAIR), join(PAIR, " & "))


def near_date(text: Column) -> Column:
    """The first date as written, trying each form in order."""
    return F.coalesce(*[_found(text, p) for p in NEAR_DATES])


def decision_date(text: Column, html: Column | None = None) -> Column:
    """The date that the page's head gives in ISO form, else the first labelled one of the text that is a date."""
    meta = [F.try_to_date(_found(html, META_DATE), "yyyy-MM-dd")] if html is not None else []
    return F.coalesce(*meta, *[F.try_to_date(_found(text, p), form) for p, form in DECISION_DATES])


def judge(text: Column) -> Column:
    return F.coalesce(*[_found(text, p) for p in JUDGES])


def neutral_citation(html: Column, text: Column, ref: Column, year: Column) -> Column:
    """The head's identifier, else the citation of this year and reference as the text writes it, else one made of both."""
    made = F.concat(F.lit("["), year.cast("string"), F.lit("] UKFTT "), ref)
    quoted = F.regexp_replace(ref, r"([^A-Za-z0-9_])", r"\\$1")
    written = F.regexp_substr(text, F.concat(F.lit(r"(?i)\["), year.cast("string"), F.lit(r"\]\s*UKFTT\s+"), quoted))
    return F.coalesce(_found(html, META_ID), written, made)


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from the page at base: whole, from the site's root, or beside the page."""
    site, beside = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1), F.regexp_extract(base, r"^(.*/)", 1)
    return F.when(href.rlike(r"^[a-z]+:"), href).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(beside, href))


def pdf_link(html: Column, base: Column) -> Column:
    """The first link to a .pdf, as an absolute URL; null where there is none."""
    return absolute_url(base, F.try_element_at(F.filter(html_links(html), lambda h: h.endswith(".pdf")), F.lit(1)))


def index_entries(html: Column, year: Column) -> Column:
    """array<struct<case_reference, href, title, near_date, category_text>> of a year's list page, in order.

    A link counts if it ends in .html, an absolute path has the year in it, and its file is named like a reference.  The title is the link's
    text, or the first 200 characters of its element's where that has three or fewer; date and category come from the element's text.
    """
    def of_link(href: Column, inside: Column, around: Column) -> Column:
        ref, said = F.replace(F.try_element_at(F.split(href, "/"), F.lit(-1)), F.lit(".html"), F.lit("")), html_text(inside)
        counts = href.endswith(".html") & (~href.startswith("/") | href.contains(F.concat(F.lit("/"), year.cast("string"), F.lit("/")))) & ref.rlike(CASE_REFERENCE)
        title = F.when(F.length(said) > 3, said).otherwise(F.nullif(F.substring(around, 1, 200), F.lit("")))
        return F.when(counts, F.struct(ref.alias("case_reference"), href.alias("href"), title.alias("title"), near_date(around).alias("near_date"), _found(around, IN_PARENTHESES).alias("category_text")))

    def of_element(part: Column) -> Column:
        around = html_text(F.concat(F.lit("<"), part))
        return F.zip_with(F.regexp_extract_all(part, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(part, F.lit(ANCHOR), F.lit(2)), lambda href, inside: of_link(href, inside, around))

    return F.array_compact(F.flatten(F.transform(F.split(html, ENTRY), of_element)))


def index_row(*, base: Column, path: Column, year: Column) -> list[Column]:
    """Of a case row (case_reference, title, decision_date, case_type_name): the six light columns of an index entry."""
    ref = F.col("case_reference")
    return [
        ref, F.col("title"), F.date_format("decision_date", "yyyy-MM-dd").alias("decision_date"), F.col("case_type_name").alias("category_text"),
        case_url(base, path, year, ref).alias("html_url"), case_url(base, path, year, ref, "pdf").alias("pdf_url"),
    ]


def parse_date(text: Column) -> Column:
    """`Y-M-D` or `D/M/Y`; null if neither is a date."""
    return F.coalesce(F.try_to_date(text, "yyyy-M-d"), F.try_to_date(text, "d/M/yyyy"))


def fenced_json(text: Column) -> Column:
    """The JSON of an answer: in a ```json fence, in a plain fence, or the text itself."""
    return F.regexp_replace(F.coalesce(_found(text, r"(?s)```json\s*(.*?)```"), _found(text, r"(?s)```\s*(.*?)```"), text), r"^\s+|\s+$", "")


def unwrap(json: Column, field: str) -> Column:
    """A field that may be {"value": v, "confidence": c}."""
    return F.coalesce(F.get_json_object(json, f"$.{field}.value"), F.get_json_object(json, f"$.{field}"))


def unwrap_confidence(json: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{field}.confidence").cast("double"), F.when(F.get_json_object(json, f"$.{field}").isNotNull(), 1.0))


def year_list(spec: Column) -> Column:
    """The years of `2020-2025`, `2020,2022` or a mix with blanks, distinct and latest first."""
    parts = F.filter(F.split(spec, r"[,\s]+"), lambda p: p.rlike(r"^\d{4}(-\d{4})?$"))
    spans = F.transform(parts, lambda p: F.sequence(F.substring(p, 1, 4).cast("int"), F.right(p, F.lit(4)).cast("int")))
    return F.sort_array(F.array_distinct(F.flatten(spans)), asc=False)


def index_url(base: Column, path: Column, year: Column) -> Column:
    return F.concat(base, path, year.cast("string"), F.lit("/"))


def case_url(base: Column, path: Column, year: Column, ref: Column, kind: str = "html") -> Column:
    return F.concat(index_url(base, path, year), ref, F.lit(f".{kind}"))


def download_status(has_html: Column, has_pdf: Column, dry_run: Column) -> Column:
    """complete with both files, html_downloaded or pdf_downloaded with one, failed with none; pending in a dry run."""
    return F.when(dry_run, "pending").when(has_html & has_pdf, "complete").when(has_html, "html_downloaded").when(has_pdf, "pdf_downloaded").otherwise("failed")

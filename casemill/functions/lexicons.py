"""Domain lexicons and what is computed from them; every function takes the lexicon as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Issues, evidence kinds, keyword tiers, code tables and ordered maps.
ISSUES = {
    "deposit_protection": ("deposit protection", "section 213", "section 214", "tenancy deposit scheme", "tds", "dps", "mydeposits", "protected deposit", "unprotected deposit", "prescribed information"),
    "cleaning": ("cleaning", "professional clean", "end of tenancy clean", "cleanliness", "dirty", "filthy", "clean condition"),
    "damage": ("damage", "damages", "broken", "stain", "mark", "scratch", "hole", "burn", "tear", "worn", "deterioration"),
    "fair_wear_and_tear": ("fair wear and tear", "reasonable wear", "natural wear", "normal use", "betterment"),
    "inventory": ("inventory", "check-in", "check-out", "schedule of condition", "photographic evidence", "inspection report"),
    "rent_arrears": ("rent arrears", "unpaid rent", "outstanding rent", "rent owed", "arrears"),
    "garden": ("garden", "lawn", "grass", "overgrown", "landscaping", "outdoor area", "patio"),
    "decoration": ("redecoration", "painting", "redecorating", "walls", "paintwork", "marks on walls"),
}
EVIDENCE = {
    "inventory": ("inventory", "schedule of condition", "check-in report", "check-out report"),
    "photographs": ("photograph", "photo", "picture", "image"),
    "receipts": ("receipt", "invoice", "quotation", "quote", "estimate"),
    "correspondence": ("email", "letter", "text message", "whatsapp", "correspondence"),
    "witness": ("witness", "testimony", "statement"),
    "contract": ("tenancy agreement", "contract", "lease"),
}
DEPOSIT_KEYWORDS = (
    "section 214", "s.214", "s214", "housing act 2004", "tenancy deposit scheme", "deposit protection scheme", "tds", "mydeposits", "my deposits", "dps",
    "deposit protection service", "deposit withholding", "deposit withheld", "deposit deduction", "deposit deductions", "return of deposit", "return the deposit",
    "deposit return", "deposit refund", "failure to protect", "failed to protect", "unprotected deposit", "deposit not protected", "three times the deposit",
    "3 times the deposit", "deposit penalty", "penalty deposit", "prescribed information", "failed to provide prescribed information",
)
ADJACENT_KEYWORDS = (
    "rent repayment order", "rro", "unlicensed hmo", "hmo licensing", "house in multiple occupation", "hmo licence", "hmo license", "disrepair", "housing conditions",
    "improvement notice", "hazard awareness notice", "section 21", "s.21", "s21", "possession order", "notice to quit", "assured shorthold tenancy", "ast",
    "tenancy agreement", "inventory", "check-out report", "check-in report", "end of tenancy",
)
REGIONS = {
    "LON": "London", "CHI": "Chichester (South East)", "MAN": "Manchester (North West)", "BIR": "Birmingham (Midlands)", "CAM": "Cambridge (East)", "HAV": "Havant (South)",
    "KA": "Kent Area", "MID": "Midlands", "NOR": "Northern", "WMI": "West Midlands", "EAS": "Eastern", "SOU": "Southern",
}
CASE_TYPES = {
    "HNA": "Housing Act 2004", "HMF": "Housing and Planning Act 2016", "LDC": "Leasehold - Dispute/Complaint", "LSC": "Leasehold - Service Charges",
    "LAM": "Leasehold - Administration", "LRM": "Leasehold - Right to Manage", "LBC": "Leasehold - Breach of Covenant", "LEE": "Leasehold - Enfranchisement",
    "LVT": "Leasehold Valuation Tribunal", "RRO": "Rent Repayment Order", "MHR": "Mobile Homes", "RPM": "Residential Property", "HBD": "Housing - Band/Disability",
}
ISSUE_WORDS = (
    ("clean", "cleaning"), ("dirt", "cleaning"), ("damage", "damage"), ("broken", "damage"), ("rent", "rent_arrears"), ("arrears", "rent_arrears"),
    ("deposit", "deposit_protection"), ("protection", "deposit_protection"), ("unprotected", "deposit_protection"), ("inventory", "inventory_dispute"),
    ("garden", "garden"), ("decoration", "decoration"), ("decorating", "decoration"), ("wear", "fair_wear_and_tear"), ("missing", "missing_items"), ("items", "missing_items"),
)
EVIDENCE_WORDS = (
    ("checkin", "inventory_checkin"), ("check_in", "inventory_checkin"), ("checkout", "inventory_checkout"), ("check_out", "inventory_checkout"), ("photo", "photos_after"),
    ("receipt", "receipts"), ("invoice", "invoices"), ("email", "correspondence"), ("message", "correspondence"), ("letter", "correspondence"),
    ("contract", "tenancy_agreement"), ("agreement", "tenancy_agreement"), ("certificate", "deposit_certificate"),
)
# Of an evidence file: words, words that refine the kind, the kind.
EVIDENCE_RULES = (
    (("inventory", "check-in", "checkin"), ((("out", "checkout", "check-out", "end"), "inventory_checkout"),), "inventory_checkin"),
    (("photo", "picture", "image"), ((("before", "start", "move in", "movein"), "photos_before"),), "photos_after"),
    (("receipt", "paid"), (), "receipts"), (("invoice", "bill", "quote"), (), "invoices"), (("email", "letter", "message", "correspondence"), (), "correspondence"),
    (("tenancy", "agreement", "contract", "lease"), (), "tenancy_agreement"), (("deposit", "certificate", "protection"), (), "deposit_certificate"),
)
EVIDENCE_OTHER = "other"
EVIDENCE_ISSUES = {
    "inventory_checkin": ("cleaning", "damage", "fair_wear_and_tear"), "inventory_checkout": ("cleaning", "damage", "fair_wear_and_tear"),
    "photos_before": ("cleaning", "damage", "decoration"), "photos_after": ("cleaning", "damage", "decoration"), "receipts": ("cleaning", "damage"),
    "invoices": ("cleaning", "damage"), "deposit_certificate": ("deposit_protection",), "tenancy_agreement": ("rent_arrears", "deposit_protection"),
}


def _has(text: Column, word: str, whole: bool) -> Column:
    return text.rlike(rf"\b\Q{word}\E\b") if whole else F.contains(text, F.lit(word))


def keyword_hits(text: Column, keywords: tuple[str, ...], *, word_boundary: bool = False) -> Column:
    """The keywords found in the lower-cased text, sorted; inside words too unless word_boundary."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.array_compact(F.array(*[F.when(_has(low, k, word_boundary), k) for k in keywords])))


def categories(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """The lexicon's categories of which any word is found, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False)), name) for name, words in sorted(lexicon.items())]
    return F.array_compact(F.array(*found))


def tier(text: Column, first: tuple[str, ...] = DEPOSIT_KEYWORDS, second: tuple[str, ...] = ADJACENT_KEYWORDS, names=("deposit", "adjacent", "other")) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return F.when(hit(first), names[0]).when(hit(second), names[1]).otherwise(names[2])


def category_flags(category: Column, first_hits: Column, second_hits: Column) -> dict[str, Column]:
    """is_deposit_case, is_adjacent_case and all keywords, the first tier's before the second's."""
    return {"is_deposit_case": category == "deposit", "is_adjacent_case": category == "adjacent", "all_keywords": F.concat(first_hits, second_hits)}


def first_match(text: Column, words: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first word, in the given order, that the text contains; null if none."""
    out = F.lit(None).cast("string")
    for word, value in reversed(words):
        out = F.when(F.contains(text, F.lit(word)), value).otherwise(out)
    return out


def code_name(code: Column, names: dict[str, str]) -> Column:
    up = F.upper(code)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(up.isNull(), None).otherwise(F.coalesce(F.try_element_at(table, up), F.concat(F.lit("Unknown ("), code, F.lit(")"))))


def evidence_type(text: Column) -> Column:
    """The kind of an evidence file from its path, description and text: the first rule of which a word occurs, and its first refinement."""
    low = F.lower(text)
    any_of = lambda words: F.greatest(F.lit(False), *[F.contains(low, F.lit(w)) for w in words])
    out = F.lit(EVIDENCE_OTHER)
    for words, refined, kind in reversed(EVIDENCE_RULES):
        value = F.lit(kind)
        for inner, other in refined:
            value = F.when(any_of(inner), other).otherwise(value)
        out = F.when(any_of(words), value).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays: shared over all; 0.3 if one is empty, 0.5 if both are."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).when((F.size(a) == 0) & (F.size(b) == 0), 0.5).otherwise(0.3)


def temporal_factor(year: Column, as_of_year: int) -> Column:
    age = F.lit(as_of_year) - year
    return F.when(age <= 0, 1.0).when(age <= 2, 0.9).when(age <= 5, 0.7).otherwise(F.greatest(F.lit(0.3), 1.0 - 0.05 * age))


def region_factor(a: Column, b: Column) -> Column:
    return F.when(F.upper(a) == F.upper(b), 1.0).otherwise(0.5)

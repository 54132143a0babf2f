"""Literal rows for normalisation, redaction, tokens, sentences."""

import pytest
from pyspark.sql import functions as F

from casemill.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("0207 123 4567", "[PHONE]"), ("(0207) 123 4567", "([PHONE]"), (" +447123456789", " +447123456789"), ("12-34-56 12345678", "[BANK_DETAILS] 12345678"),
        ("SW1A 1AA", "[POSTCODE]"), ("john.smith@example.com", "[EMAIL]"), ("", ""),
    ],
)
def test_redact(spark, raw, want):
    assert one(spark, T.redact, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Section 213 of the Housing Act 2004", ["section", "of", "the", "housing", "act", "2004"]),
        ("The landlord's duty, under section 213.", ["the", "landlord", "s", "duty", "under", "section"]),
        ("café d'été x_1 co-op", ["café", "été", "x_1", "co-op"]), ("", []),
    ],
)
def test_tokens(spark, raw, want):
    assert one(spark, T.tokens, raw) == want


def test_clean(spark):
    assert one(spark, T.clean, "intro\n\n\n\nBACKGROUND\n\n\nbody") == "intro BACKGROUND body"
    assert one(spark, lambda c: T.clean(c, preserve_paragraphs=True), "intro\n\n\n\nBACKGROUND\n\n\nbody") == "intro\n\nBACKGROUND\n\nbody"
    assert one(spark, T.clean, "a\n \n \nb") == "a\n\n\nb"
    assert one(spark, T.clean, "a\n\n\nb") == "a b"
    assert one(spark, T.clean, "x\nPage 3 of 9\ny") == "x\n\ny"
    assert one(spark, T.clean, "Â£5 â\u0080\u0099 ‘q’ …") == "£5 ' 'q' ..."
    assert one(spark, T.clean, None) == ""


def test_pii_counts_follow_the_order(spark):
    row = spark.createDataFrame([("a@b.co, c@d.org, 02071234567, 0207 123 4567, SW1A 1AA, 12-34-56",)], "t string").select(*[c.alias(k) for k, c in T.pii_counts(F.col("t")).items()]).first()
    assert row.asDict() == {"postcode": 1, "phone": 2, "email": 2, "bank": 1}


def test_detect_keeps_kind_order(spark):
    found = one(spark, T.detect_pii, "x@y.com SW1A 1AA")
    assert [(r["kind"], r["text"]) for r in found] == [("postcode", "SW1A 1AA"), ("email", "x@y.com")]


def test_sentences(spark):
    assert one(spark, T.sentences, "One. Two! three? Four.\nFive") == ["One.", "Two! three?", "Four.", "Five"]


def test_formats(spark):
    assert one(spark, T.issue_title, "fair_wear_and_tear") == "Fair Wear And Tear"
    assert one(spark, lambda c: T.snippet(c, 3), "abcd") == "abc..." and one(spark, lambda c: T.snippet(c, 3), "abc") == "abc"

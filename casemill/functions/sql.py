"""The engine's functions for SQL users: temporary SQL functions made of expressions, so that Catalyst inlines and sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from casemill.functions import text as T


def _q(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(body: str, pairs, regex: bool = True) -> str:
    for old, new in pairs:
        body = f"{'regexp_replace' if regex else 'replace'}({body}, {_q(old)}, {_q(new)})"
    return body


def _redacted(body: str) -> str:
    return _all(body, [(p, mark.replace("[", r"\[").replace("]", r"\]")) for _, p, mark in T.PII])


def definitions() -> dict[str, tuple[str, str, str]]:
    """(parameters, type, body) by name."""
    spaced = _all(_all(_all("t", T.ENCODING, regex=False), [(p, " ") for p in T.NOISE]), T.WHITESPACE)
    strip = [(rf"^{T.SPACE}+|{T.SPACE}+$", "")]
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    return {
        "clean_text": ("t STRING", "STRING", f"coalesce({_all(_redacted(spaced), strip)}, '')"),
        "redact_pii": ("t STRING", "STRING", _redacted("t")),
        "bm25_tokens": ("t STRING", "ARRAY<STRING>", rf"filter(split(regexp_replace(lower(t), {_q(T.NOT_TOKEN)}, ' '), '\\s+'), w -> (length(w) >= 2 OR w IN ('s', 'a')) AND (NOT w RLIKE '^[0-9]+$' OR length(w) = 4))"),
        "cosine_sim": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN {dot('a', 'a')} = 0 OR {dot('b', 'b')} = 0 THEN 0D ELSE {dot('a', 'b')} / (sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')})) END"),
        "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) WHEN size(a) = 0 AND size(b) = 0 THEN 0.5D ELSE 0.3D END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Defines clean_text, redact_pii, bm25_tokens, cosine_sim and jaccard in the session; returns their names."""
    for name, (parameters, kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(definitions())

"""Lookups and listings over stored sessions, cases, disputes, evidence, chunks and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_region_and_year(rows: DataFrame, region: str | None = None, year: int | None = None) -> DataFrame:
    """The command line's filter: a region in any case, a year; what is not given does not filter."""
    if region is not None:
        rows = rows.filter(F.col("region") == region.upper())
    return rows if year is None else rows.filter(F.col("year") == year)


def disputes_of_status(disputes: DataFrame, status: str | None, limit: int, tie: str = "dispute_id") -> DataFrame:
    """The latest disputes of a status (None: of any), newest first; the limit is the listing's page."""
    rows = disputes if status is None else disputes.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), tie).limit(limit)


def dispute_list(disputes: DataFrame) -> DataFrame:
    """disputes with has_tenant and has_landlord instead of the sessions' ids."""
    rest = [c for c in disputes.columns if c not in ("tenant_session_id", "landlord_session_id")]
    return disputes.select(*rest, F.col("tenant_session_id").isNotNull().alias("has_tenant"), F.col("landlord_session_id").isNotNull().alias("has_landlord"))


def dispute_of_session(disputes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, dispute_id, side) for asked sessions (session_id) on either side of a dispute; the two columns are one before the join."""
    sides = F.array(F.struct(F.col("tenant_session_id").alias("session_id"), F.lit("tenant").alias("side")), F.struct(F.col("landlord_session_id").alias("session_id"), F.lit("landlord").alias("side")))
    return disputes.select("dispute_id", F.explode(sides).alias("x")).select("x.session_id", "dispute_id", "x.side").join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def existing(ids: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, exists) of the asked ids."""
    return ids.select(key).distinct().join(stored.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").select(key, F.col("_k").isNotNull().alias("exists"))


def predictions_of(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """All predictions of the asked cases (case_id), newest first within a case."""
    return predictions.join(cases.select("case_id").distinct(), "case_id", "left_semi").orderBy("case_id", F.desc("created_at"))


def session_status(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions (session_id, stage, is_complete) with n_messages and the messages in order (array<struct<seq, role, text>>): a conversation's length each."""
    said = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("messages"))
    return sessions.join(said, "session_id", "left").fillna({"n_messages": 0})


def kpis(disputes: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: total_disputes, both_joined, waiting, ready, total_sessions, complete_sessions."""
    both = F.col("tenant_session_id").isNotNull() & F.col("landlord_session_id").isNotNull()
    a = disputes.agg(F.count("*").alias("total_disputes"), F.count_if(both).alias("both_joined"), F.count_if(~both).alias("waiting"), F.count_if(F.col("status").isin("both_complete", "ready_for_mediation")).alias("ready"))
    return a.crossJoin(sessions.agg(F.count("*").alias("total_sessions"), F.count_if("is_complete").alias("complete_sessions")))  # one row each

"""Property graphs of many case files at once: nodes, edges, validation.

A case has: case_id, user_role, tenant_name, landlord_name, agent_name, address, postcode, region, start_date, end_date, deposit_amount,
deposit_protected, protection_date, issues array<string>, evidence array<struct<id,type,description>>, claims
array<struct<party,id,issue,amount,description,evidence_ids>>, events array<struct<type,date,description>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.lexicons import EVIDENCE_ISSUES

# What an issue is called when no claim describes it.
ISSUE_TEXT = {
    "cleaning": "Dispute over cleaning charges", "damage": "Dispute over damage claims", "rent_arrears": "Dispute over unpaid rent",
    "deposit_protection": "Deposit protection compliance issue", "inventory_dispute": "Dispute over inventory condition", "garden": "Dispute over garden maintenance",
    "decoration": "Dispute over decoration/redecoration", "fair_wear_and_tear": "Dispute over fair wear and tear assessment",
    "missing_items": "Dispute over missing items", "utilities": "Dispute over utility charges",
}
LATE_DAYS, LONGEST_DAYS = 30, 7300
NODE_TYPES = ("party", "property", "lease", "evidence", "issue", "claimed_amount", "event")
RELEVANCE = 0.7
BEFORE_IS_FINE = ("tenancy_start", "deposit_protected")


def _node(kind: str, node_id, label, date=None):
    return F.struct(node_id.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), (date if date is not None else F.lit(None).cast("date")).alias("date"))


def node_list() -> Column:
    """array<struct<node_id, node_type, label, date>> of a case's row, in order of construction."""
    c, lit = F.col, F.lit
    user_is_tenant = c("user_role") == "tenant"
    user, other = F.when(user_is_tenant, c("tenant_name")).otherwise(c("landlord_name")), F.when(user_is_tenant, c("landlord_name")).otherwise(c("tenant_name"))
    other_role = F.when(user_is_tenant, "landlord").otherwise("tenant")
    named = lambda x: x.isNotNull() & (x != "")
    fixed = [
        _node("party", F.concat(lit("party_"), c("user_role")), F.coalesce(user, lit("user"))), _node("party", F.concat(lit("party_"), other_role), F.coalesce(other, lit("inferred"))),
        F.when(named(c("agent_name")), _node("party", lit("party_agent"), c("agent_name"))), F.when(named(c("address")), _node("property", lit("property"), c("address"))),
        F.when(c("start_date").isNotNull() | c("deposit_amount").isNotNull(), _node("lease", lit("lease"), lit("lease"), c("start_date"))),
        F.when(c("start_date").isNotNull(), _node("event", lit("event_tenancy_start"), lit("tenancy_start"), c("start_date"))),
        F.when(c("end_date").isNotNull(), _node("event", lit("event_tenancy_end"), lit("tenancy_end"), c("end_date"))),
        F.when(c("protection_date").isNotNull(), _node("event", lit("event_deposit_protected"), lit("deposit_protected"), c("protection_date"))),
    ]
    default = F.create_map(*[lit(x) for pair in ISSUE_TEXT.items() for x in pair])

    def issue(i):
        said = F.filter("claims", lambda x: x["issue"] == i)
        return _node("issue", F.concat(lit("issue_"), i), F.coalesce(F.try_element_at(said, lit(1))["description"], F.try_element_at(default, i), F.concat(lit("Dispute regarding "), i)))

    many = [
        F.transform("evidence", lambda e: _node("evidence", F.concat(lit("evidence_"), e["id"]), e["type"])), F.transform("issues", issue),
        F.transform("claims", lambda x: _node("claimed_amount", F.concat(lit("claim_"), x["party"], lit("_"), x["id"]), x["description"])),
        F.transform("events", lambda e, k: _node("event", F.concat(lit("event_"), k.cast("string")), e["type"], e["date"])),
    ]
    return F.array_compact(F.concat(F.array(*fixed), *[F.coalesce(m, F.array()) for m in many]))


def nodes(cases: DataFrame) -> DataFrame:
    """(case_id, node_id, node_type, label, date), made of each case's row alone."""
    return cases.select("case_id", F.explode(node_list()).alias("n")).select("case_id", "n.*")


def edges(cases: DataFrame, *, contains: bool = False) -> DataFrame:
    """(case_id, src, dst, edge_type, confidence): ownership, tenancy, claims, relevance, support, and events in order of time.

    All of it comes from the case's row, so nothing is shuffled.  Events of one day keep their order of construction.  contains
    links support to the first claim whose node id contains the claim's id, as the reference does, instead of the claim itself.
    """
    c, lit = F.col, F.lit
    has_address, has_lease = c("address").isNotNull() & (c("address") != ""), c("start_date").isNotNull() | c("deposit_amount").isNotNull()
    edge = lambda s, d, kind, sure=1.0: F.struct(s.alias("src"), d.alias("dst"), lit(kind).alias("edge_type"), lit(sure).alias("confidence"))
    fixed = F.array(
        F.when(has_address, edge(lit("party_landlord"), lit("property"), "PARTY_OWNS")), F.when(has_address, edge(lit("party_tenant"), lit("property"), "PARTY_RENTS")),
        F.when(has_address & has_lease, edge(lit("lease"), lit("property"), "LEASE_FOR")),
    )
    claim = lambda x: F.concat(lit("claim_"), x["party"], lit("_"), x["id"])
    claimed = F.transform("claims", lambda x: edge(F.concat(lit("party_"), x["party"]), claim(x), "PARTY_CLAIMS"))
    about = F.transform(F.filter("claims", lambda x: F.array_contains("issues", x["issue"])), lambda x: edge(claim(x), F.concat(lit("issue_"), x["issue"]), "CLAIM_RELATES_TO"))
    kinds = F.create_map(*[y for k, v in EVIDENCE_ISSUES.items() for y in (lit(k), F.array(*[lit(i) for i in v]))])
    # evidence of a kind without a list relates to every issue
    relevant = F.flatten(F.transform("evidence", lambda e: F.transform(
        F.filter("issues", lambda i: F.coalesce(F.array_contains(F.try_element_at(kinds, e["type"]), i), lit(True))), lambda i: edge(F.concat(lit("evidence_"), e["id"]), F.concat(lit("issue_"), i), "EVIDENCE_RELATES_TO", RELEVANCE))))
    target = (lambda x: F.get(F.filter(F.transform("claims", claim), lambda y: y.contains(x["id"])), 0)) if contains else claim
    supports = F.flatten(F.transform("claims", lambda x: F.transform(F.filter(x["evidence_ids"], lambda e: F.exists("evidence", lambda v: v["id"] == e)), lambda e: edge(F.concat(lit("evidence_"), e), target(x), "EVIDENCE_SUPPORTS"))))
    dated = F.transform(F.filter(node_list(), lambda n: (n["node_type"] == "event") & n["date"].isNotNull()), lambda n, k: F.struct(n["date"], k, n["node_id"]))
    pairs = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, lit(0))), F.slice(x, 2, F.size(x)), lambda a, b: edge(a["node_id"], b["node_id"], "EVENT_BEFORE"))
    chain = F.get(F.transform(F.array(F.array_sort(dated)), pairs), 0)
    every = F.array_compact(F.concat(fixed, *[F.coalesce(x, F.array()) for x in (claimed, about, relevant, supports, chain)]))
    return cases.select("case_id", F.explode(every).alias("e")).select("case_id", "e.*")


def validate(cases: DataFrame, *, strict: bool = False) -> DataFrame:
    """(case_id, errors, warnings, is_consistent) from rules on each case's row."""
    c, lit = F.col, F.lit
    late = F.date_diff("protection_date", "start_date")
    covered = lambda i: F.exists("evidence", lambda e: F.coalesce(F.array_contains(F.try_element_at(kinds, e["type"]), i), lit(True)))
    kinds = F.create_map(*[y for k, v in EVIDENCE_ISSUES.items() for y in (lit(k), F.array(*[lit(i) for i in v]))])
    bare = F.array_sort(F.filter("issues", lambda i: ~covered(i)))
    loose = F.filter("claims", lambda x: (F.size(F.coalesce(x["evidence_ids"], F.array())) <= 0) & ~F.array_contains("issues", x["issue"]))
    early = F.array_sort(F.transform(F.filter("events", lambda e: (e["date"] < c("start_date")) & ~e["type"].isin(*BEFORE_IS_FINE)), lambda e: e["type"]))
    errors = F.array_compact(F.array(F.when(c("end_date") < c("start_date"), "Tenancy ends before it starts")))
    warnings = F.array_compact(F.array(
        F.when(F.date_diff("end_date", "start_date") > LONGEST_DAYS, "Unusually long tenancy"), F.when(late < 0, "Deposit protected before tenancy start"),
        F.when(late > LATE_DAYS, F.concat(lit("Deposit protected "), late.cast("string"), lit(" days after start"))),
        F.when(F.size(early) > 0, F.concat(lit("Before tenancy start: "), F.array_join(early, ", "))),
        F.when(F.array_contains("issues", "deposit_protection") & c("deposit_protected").eqNullSafe(True) & (late <= LATE_DAYS), "Protection is disputed but was in time"),
        F.when(F.size(bare) > 0, F.concat(lit("Issues without evidence: "), F.array_join(bare, ", "))), F.when(F.size(loose) > 0, "Claims without support"),
        F.when((c("address").isNull() | (c("address") == "")) & c("start_date").isNull() & c("deposit_amount").isNull(), "Neither property nor lease"),
        F.when(F.size("issues") <= 0, "No issues"),
    ))
    consistent = (F.size("errors") == 0) & ((F.size("warnings") == 0) if strict else lit(True))
    return cases.select("case_id", errors.alias("errors"), warnings.alias("warnings")).withColumn("is_consistent", consistent)


def required_nodes(node_rows: DataFrame) -> DataFrame:
    """(case_id, warnings) of a graph's nodes, by one count of its types: fewer than two parties, neither property nor lease, no issues."""
    n = lambda *kinds: F.count_if(F.col("node_type").isin(*kinds))
    per = node_rows.groupBy("case_id").agg(n("party").alias("parties"), n("property", "lease").alias("places"), n("issue").alias("issues"))
    found = F.array_compact(F.array(F.when(F.col("parties") < 2, "Fewer than two parties"), F.when(F.col("places") == 0, "Neither property nor lease"), F.when(F.col("issues") == 0, "No issues")))
    return per.select("case_id", found.alias("warnings"))


def check_dates(cases: DataFrame) -> DataFrame:
    """(case_id, findings) of dates alone: an end before the start, events before the start, events after the end, in this order by event."""
    start, end = F.col("start_date"), F.col("end_date")
    of_event = F.flatten(F.transform(F.coalesce("events", F.array()), lambda e: F.array_compact(F.array(
        F.when(e["date"] < start, F.concat(F.lit("Event "), e["type"], F.lit(" before start date"))), F.when(e["date"] > end, F.concat(F.lit("Event "), e["type"], F.lit(" after end date")))))))
    return cases.select("case_id", F.concat(F.array_compact(F.array(F.when(end < start, "End date before start date"))), of_event).alias("findings"))


def nodes_of_type(node_rows: DataFrame, kind: str) -> DataFrame:
    return node_rows.filter(F.col("node_type") == kind)


def neighbours(edge_rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The edges at either end of the asked nodes (case_id, node_id), with that node and the one across; ends are one column before the join."""
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    return edge_rows.select("case_id", "edge_type", F.explode(ends).alias("x")).select("case_id", "x.*", "edge_type").join(asked.select("case_id", "node_id").distinct(), ["case_id", "node_id"], "left_semi")


def summary(node_rows: DataFrame, edge_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, n_nodes, n_edges, is_consistent, n_warnings); findings as validate() gives them."""
    n, e = node_rows.groupBy("case_id").agg(F.count("*").alias("n_nodes")), edge_rows.groupBy("case_id").agg(F.count("*").alias("n_edges"))
    rows = n.join(e, "case_id", "left").join(findings.select("case_id", "is_consistent", F.size("warnings").alias("n_warnings")), "case_id", "left")
    return rows.fillna({"n_edges": 0})


def save_graphs(node_rows: DataFrame, edge_rows: DataFrame, folder: str) -> None:
    """Graphs as JSON, a folder a case, replaced whole; nodes keep their type as a tag."""
    from casemill.operators.store import save_json

    save_json(node_rows, f"{folder}/nodes", "case_id")
    save_json(edge_rows, f"{folder}/edges", "case_id")


def load_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dropped): nodes of a type that is not known are dropped, and handed back for a warning."""
    found = spark.read.schema("node_id string, node_type string, label string, date date, case_id long").json(f"{folder}/nodes")
    edge_rows = spark.read.schema("src string, dst string, edge_type string, confidence double, case_id long").json(f"{folder}/edges")
    known = F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False))
    return found.filter(known), edge_rows, found.filter(~known)

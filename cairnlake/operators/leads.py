"""Leads: scoring, consolidation, evidence index, analyst state, timelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.functions.sets import sorted_tokens


def merge_state(rows: DataFrame, state: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Rows with their kept state, or the defaults for rows that have none."""
    merged = rows.join(state, key, "left")
    return merged.select(*rows.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def history(before: DataFrame, after: DataFrame, key: str, field: str) -> DataFrame:
    """(key, event, old, new): CREATED for new keys, STATUS_CHANGED where the field differs."""
    old = before.select(key, F.col(field).alias("old"), F.lit(True).alias("known"))
    rows = after.select(key, F.col(field).alias("new")).join(old, key, "left")
    event = F.when(F.col("known").isNull(), "CREATED").when(~F.col("old").eqNullSafe(F.col("new")), "STATUS_CHANGED")
    return rows.withColumn("event", event).where("event IS NOT NULL").select(key, "event", "old", "new")


def priority(terms: Sequence[tuple[Column, float, float]]) -> Column:
    """The capped sum of (value, most, weight) terms."""
    return scores.capped_sum(terms)


def consolidate(leads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One lead per key: the winner by priority, risk and confidence; the largest counts; all sources."""
    best = F.struct(F.col("priority"), F.col("risk"), F.col("confidence"), F.col("lead_id"))
    return leads.groupBy(*keys).agg(F.max_by("lead_id", best).alias("lead_id"), F.max("priority").alias("priority"), F.max("risk").alias("risk"), F.max("confidence").alias("confidence"), sorted_tokens(F.col("source")).alias("sources"), F.count(F.lit(1)).alias("merged"))


def evidence_index(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(lead_id, evidence_kind, reference) of several kinds, numbered within each lead."""
    rows = None
    for kind, frame in parts.items():
        one = frame.select("lead_id", F.lit(kind).alias("evidence_kind"), F.col("reference").cast("string").alias("reference"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("n", F.row_number().over(W.partitionBy("lead_id").orderBy("evidence_kind", "reference")).cast("long"))


def timeline(events: DataFrame, key: str, ts: str, kind: str) -> DataFrame:
    """Events in order, with the whole days since the one before."""
    over = W.partitionBy(key).orderBy(ts, kind)
    gap = F.expr("(us - before) div 86400000000")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(key, ts, kind, F.row_number().over(over).cast("long").alias("n"), micros.alias("us"), F.lag(micros).over(over).alias("before"))
    return rows.select(key, ts, kind, "n", gap.alias("days_since"))


#: Kinds of leads, what each is recommended, and what a lead with little evidence is told besides.
KINDS_BY_ENTITY = {"address": "ADDRESS_CLUSTER", "property": "PROPERTY_CLUSTER", "phone": "COMMUNICATION_CLUSTER", "email": "COMMUNICATION_CLUSTER", "website": "COMMUNICATION_CLUSTER", "business": "BUSINESS_CLUSTER"}
ENABLED = ("ENTITY", "NETWORK", "CROSS_SOURCE_CLUSTER", "ADDRESS_CLUSTER", "BUSINESS_CLUSTER", "PROPERTY_CLUSTER", "COMMUNICATION_CLUSTER", "TEMPORAL_CLUSTER")
RECOMMENDED = {
    "ADDRESS_CLUSTER": "Verify whether the address is residential, commercial, mailbox, virtual office, shelter, or multifamily; review businesses, owners, officers, phones, websites, and filing dates connected to the address.",
    "PROPERTY_CLUSTER": "Compare parcel owner, mailing address, business officers, registered agents, and related filings; confirm whether shared infrastructure explains the property-business correlation.",
    "COMMUNICATION_CLUSTER": "Review all entities sharing the same phone, email, domain, or website and determine whether the identifier appears to belong to a service provider or facilitator.",
    "TEMPORAL_CLUSTER": "Review formation, filing, transaction, and source dates for coordinated activity and confirm whether the timing reflects a legitimate batch process or unusual concentration.",
    "NETWORK": "Identify central and bridge entities, review the shortest paths connecting high-risk members, and determine whether shared infrastructure explains the network legitimately.",
    "CROSS_SOURCE_CLUSTER": "Compare records across independent sources, validate whether the matched entity attributes resolve to the same party, and review any conflicting source values before escalation.",
    "": "Review the primary entity, linked fraud markers, connected relationships, and supporting public sources before taking further action.",
}
VALIDATE_FIRST = " Lead requires evidence validation before any referral or enforcement action."
REVIEW_ACTIONS = {
    "shared address": "Review shared address connections and validate ownership.",
    "shared phone": "Verify phone ownership and call history for connected entities.",
    "shared website": "Inspect website registration and linked entity relationships.",
    "keyword": "Review suspicious keywords and associated entity filings.",
    "": "Conduct a manual review of this high-risk entity and its relationships.",
}
LEAST_COMPLETE, TEMPORAL_EVENTS = 60, 5


def lead_type(entity_type: Column, matches: Column, events: Column, enabled: Sequence[str] = ENABLED) -> Column:
    """What a lead is about, by the first rule that holds among the kinds that are enabled."""
    kind = F.lower(F.coalesce(entity_type, F.lit("")))
    rules = [(matches > 0, "CROSS_SOURCE_CLUSTER"), *((kind == e, k) for e, k in KINDS_BY_ENTITY.items()), (events >= TEMPORAL_EVENTS, "TEMPORAL_CLUSTER")]
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in rules if name in enabled], F.lit("ENTITY"))


def recommendation(lead_kind: Column, entity_type: Column, markers: Column, completeness: Column) -> Column:
    """What to review; the kind counts, then the entity's type or words of its markers."""
    kind, entity, said = F.upper(F.coalesce(lead_kind, F.lit(""))), F.lower(F.coalesce(entity_type, F.lit(""))), F.lower(F.coalesce(markers, F.lit("")))
    contact = said.contains("phone") | said.contains("email") | said.contains("website")
    also = {"ADDRESS_CLUSTER": entity == "address", "PROPERTY_CLUSTER": entity == "property", "COMMUNICATION_CLUSTER": contact}
    text = F.coalesce(*[F.when((kind == k) | also.get(k, F.lit(False)), F.lit(t)) for k, t in RECOMMENDED.items() if k], F.lit(RECOMMENDED[""]))
    return F.concat(text, F.when(F.coalesce(completeness, F.lit(0)) < LEAST_COMPLETE, VALIDATE_FIRST).otherwise(""))


def why_flagged(rules: Column, evidence: Column, anomalies: Column) -> Column:
    """Rules, evidence and anomalies that speak for a lead, parts that say nothing left out."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    parts = F.concat_ws(" | ", F.concat(F.lit("Rules: "), filled(rules)), F.concat(F.lit("Evidence: "), filled(evidence)), F.when(anomalies > 0, F.concat(F.lit("Matched "), anomalies.cast("string"), F.lit(" anomaly findings"))))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("High-risk entity identified by rule-based scoring"))


def review_action(rules: Column) -> Column:
    said = F.lower(F.coalesce(rules, F.lit("")))
    return F.coalesce(*[F.when(said.contains(word), F.lit(text)) for word, text in REVIEW_ACTIONS.items() if word], F.lit(REVIEW_ACTIONS[""]))


def risk_explanation(rules: Column, relationships: Column, sources: Column, cross_source: Column, top_marker: Column) -> Column:
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    count = lambda name, c: F.when(c > 0, F.concat(F.lit(f"{name}: "), c.cast("string")))
    parts = F.concat_ws(" | ", F.concat(F.lit("Markers: "), filled(rules)), count("Relationships", relationships), count("Sources", sources), F.when(cross_source, "Cross-source correlation detected"), F.concat(F.lit("Top marker: "), filled(top_marker)))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("Rule-based lead generated for manual review."))


def most_common(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the most frequent value of each key; ties go to the one seen first."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias(value))

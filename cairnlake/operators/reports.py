"""Reports of one row: what leads, markers and a resolution come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.sets import token_count, tokens

#: How many of the most frequent values a summary names.
NAMED = 5


def most_frequent(values: DataFrame, name: str, most: int = NAMED) -> DataFrame:
    """One row: the most frequent values of (value), equals by name, joined by bars. Values are counted first, and the few that count are picked by a limit."""
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value")))
    return counts.agg(F.array_join(F.transform(in_order, lambda x: x["value"]), "|").alias(name))


def _mean(c: str, digits: int) -> Column:
    return F.coalesce(F.round(F.round(F.avg(F.coalesce(F.col(c), F.lit(0))), 8), digits), F.lit(0.0))


def investigation_summary(leads: DataFrame) -> DataFrame:
    """Counts and means of leads (priority, contains_real, matches, lead_type, risk_score, confidence_score, completeness, markers, source_names), and their most frequent markers and combinations of sources."""
    n = lambda condition, name: F.count_if(condition).alias(name)
    p = F.col("priority")
    counts = leads.agg(
        F.count(F.lit(1)).alias("total_leads"), *[n(p == level, f"{level.lower()}_leads") for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], n(F.col("contains_real"), "real_data_leads"), n(~F.col("contains_real"), "synthetic_data_leads"),
        n(F.coalesce("matches", F.lit(0)) > 0, "cross_source_leads"), n(F.col("lead_type") != "NETWORK", "entity_leads"), n(F.col("lead_type") == "NETWORK", "network_leads"),
        _mean("risk_score", 2).alias("average_risk"), _mean("confidence_score", 4).alias("average_confidence"), _mean("completeness", 2).alias("average_completeness"),
    )
    markers = most_frequent(leads.select(F.explode(tokens(F.col("markers"))).alias("value")), "most_common_markers")
    sources = most_frequent(leads.select(F.coalesce("source_names", F.lit("")).alias("value")).where("value <> ''"), "most_common_source_combinations")
    return counts.join(F.broadcast(markers), how="cross").join(F.broadcast(sources), how="cross")  # a row each


def dashboard_metrics(markers: DataFrame, entities: DataFrame, edges: DataFrame, risk: DataFrame, leads: DataFrame) -> DataFrame:
    """Counts over markers (score), entities, edges, risks (risk_level, mean_confidence) and leads (priority, confidence, sources)."""
    n = lambda condition, name: F.count_if(condition).alias(name)
    every = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        markers.agg(F.count(F.lit(1)).alias("total_markers"), _mean("score", 2).alias("avg_marker_score")), every(entities, "total_entities"), every(edges, "total_relationships"),
        risk.agg(n(F.col("risk_level") == "High", "high_risk_entities"), n(F.col("risk_level") == "Medium", "medium_risk_entities"), _mean("mean_confidence", 2).alias("avg_confidence")),
        leads.agg(n(F.upper("priority") == "CRITICAL", "critical_leads"), n(F.upper("priority").isin("CRITICAL", "HIGH"), "high_priority_leads"), n(F.upper("confidence").isin("VERY HIGH", "VERY_HIGH", "HIGH"), "high_confidence_leads"), n(F.col("sources") > 1, "cross_source_leads"), F.least(F.count(F.lit(1)), F.lit(10)).alias("newest_leads")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), how="cross")  # a row each
    return out


def resolution_metrics(raw: DataFrame, canonical: DataFrame, matches: DataFrame) -> DataFrame:
    """How many entities came, stayed and merged; pairs for review; canonical entities of several sources (source_names)."""
    parts = [raw.agg(F.count(F.lit(1)).alias("raw_entities")), canonical.agg(F.count(F.lit(1)).alias("canonical_entities"), F.count_if(token_count(F.col("source_names")) > 1).alias("cross_source_canonical_entities")), matches.agg(F.count_if(F.upper(F.trim("decision")) == "REVIEW").alias("review_candidates"))]
    out = parts[0].join(F.broadcast(parts[1]), how="cross").join(F.broadcast(parts[2]), how="cross")  # a row each
    return out.withColumn("entities_merged", F.greatest(F.col("raw_entities") - F.col("canonical_entities"), F.lit(0)))

"""Rules with overrides, their members, and reports of one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import markers, reports, rules
from cairnlake.plans.marker_queries import _RISK
from cairnlake.plans.profile_queries import lead_candidates
from cairnlake.plans.profile_queries import ORACLE_SQL as _PROFILES
from cairnlake.plans.registry import Registry
from cairnlake.sources.scratch import stored
from cairnlake.sources.tables import GRAPH_SQL, table
from cairnlake.sources.tables import graph as entity_graph

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_BUSINESSES = """SELECT c_custkey AS record_id, 'N' || (c_custkey % 50) AS business_name, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE (c_custkey % 90) || ' MAIN ST' END AS address, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '305' || (c_custkey % 70) END AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'w' || (c_custkey % 55) || '.com' END AS website, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment || ' LLC' END AS llc_name FROM {customer}"""
_PATTERNS = "SELECT p_partkey AS record_id, 'N' || (p_partkey % 400) AS entity_name, p_brand AS keyword FROM {part}"
#: What the configuration overrides: fewer findings of one rule, another score and text, one rule off.
_CONFIG = {"shared_address_phones": {"threshold": 3, "base_score": 30, "description": "Phones"}, "keyword_frequency": {"threshold": 40}, "shared_address_websites": {"enabled": True, "base_score": 13}}
_TABLES_SQL = f"""businesses AS ({_BUSINESSES.format(customer="customer")}), patterns AS ({_PATTERNS.format(part="part")}),
grouped AS (
  SELECT 'shared_address_businesses' AS rule, address AS key, count(*) AS n, 25 AS base, 5 AS step, 1 AS threshold, 'Multiple businesses sharing one address' AS description, count(*) || ' businesses share address ' || coalesce(address, '') AS evidence, 'business_entities' AS source_table FROM businesses GROUP BY address
  UNION ALL SELECT 'shared_address_phones', address, count(DISTINCT phone), 30, 3, 3, 'Phones', count(DISTINCT phone) || ' phone numbers appear at address ' || coalesce(address, ''), 'business_entities' FROM businesses WHERE phone <> '' GROUP BY address
  UNION ALL SELECT 'shared_address_websites', address, count(DISTINCT website), 13, 2, 1, 'Multiple websites linked to one address', count(DISTINCT website) || ' websites appear at address ' || coalesce(address, ''), 'business_entities' FROM businesses WHERE website <> '' GROUP BY address
  UNION ALL SELECT 'shared_phone_llcs', phone, count(DISTINCT llc_name), 20, 3, 1, 'Multiple LLCs sharing one phone', count(DISTINCT llc_name) || ' LLCs share phone ' || phone, 'business_entities' FROM businesses WHERE phone <> '' AND llc_name <> '' GROUP BY phone
  UNION ALL SELECT 'keyword_frequency', keyword, count(*), 25, 4, 40, 'Repeated maternity/postpartum/travel keywords', 'Keyword ''' || keyword || ''' appears ' || count(*) || ' times', 'known_patterns' FROM patterns GROUP BY keyword),
found AS (SELECT * FROM grouped WHERE n > 1 AND n >= threshold + 1),
placed AS (SELECT DISTINCT p.entity_name, b.address AS key, p.keyword, p.record_id FROM patterns p JOIN businesses b ON b.business_name = p.entity_name WHERE b.address IS NOT NULL)"""


def _rules_and_tables(spark, sf_dir):
    made = {"business_entities": spark.sql(_BUSINESSES, customer=table(spark, sf_dir, "customer")), "known_patterns": spark.sql(_PATTERNS, part=table(spark, sf_dir, "part"))}
    return rules.configured(_CONFIG), {name: stored(df, name) for name, df in made.items()}


@R.query(f"""WITH {_TABLES_SQL},
scored AS (SELECT *, (base + least(n - 2, 5) * step)::INT AS score FROM found)
SELECT rule, key, n, score, CASE WHEN rule = 'shared_address_websites' THEN CASE WHEN score >= 15 THEN 'Medium' ELSE 'Low' END WHEN score >= 25 THEN 'High' ELSE 'Medium' END AS level, description, evidence, source_table FROM scored
UNION ALL SELECT 'known_pattern_addresses', key, 1, 15, 'Medium', 'Addresses listed in known_patterns', 'Known pattern keyword ''' || keyword || ''' linked to address ' || key, 'known_patterns' FROM placed""")
def rule_findings(spark, sf_dir):
    """The findings of all rules under a configuration that overrides thresholds, scores and texts."""
    return rules.findings(*_rules_and_tables(spark, sf_dir))


@R.query(f"""WITH {_TABLES_SQL},
members AS (
  SELECT b.record_id FROM businesses b JOIN found f ON rule = 'shared_address_businesses' AND f.key IS NOT DISTINCT FROM b.address
  UNION ALL SELECT b.record_id FROM businesses b JOIN found f ON rule = 'shared_address_phones' AND f.key IS NOT DISTINCT FROM b.address WHERE phone <> ''
  UNION ALL SELECT b.record_id FROM businesses b JOIN found f ON rule = 'shared_address_websites' AND f.key IS NOT DISTINCT FROM b.address WHERE website <> ''
  UNION ALL SELECT b.record_id FROM businesses b JOIN found f ON rule = 'shared_phone_llcs' AND f.key = b.phone WHERE llc_name <> ''
  UNION ALL SELECT p.record_id FROM patterns p JOIN found f ON rule = 'keyword_frequency' AND f.key = p.keyword
  UNION ALL SELECT record_id FROM placed)
SELECT record_id::VARCHAR AS record_id, count(*) AS mentions FROM members GROUP BY 1""")
def finding_mentions(spark, sf_dir):
    return rules.mentions(rules.members(*_rules_and_tables(spark, sf_dir)))


@R.query(f"""WITH leads AS ({_PROFILES["lead_candidates"]}),
words AS (SELECT m, count(*) AS n FROM (SELECT DISTINCT lead_id, unnest(string_split(explanation, '|')) AS m FROM leads WHERE lead_type <> 'NETWORK') GROUP BY 1),
combined AS (SELECT source_names AS s, count(*) AS n FROM leads WHERE source_names <> '' GROUP BY 1)
SELECT count(*) AS total_leads, count(*) FILTER (priority = 'CRITICAL') AS critical_leads, count(*) FILTER (priority = 'HIGH') AS high_leads, count(*) FILTER (priority = 'MEDIUM') AS medium_leads, count(*) FILTER (priority = 'LOW') AS low_leads, count(*) FILTER (contains_real) AS real_data_leads,
  count(*) FILTER (NOT contains_real) AS synthetic_data_leads, count(*) FILTER (matches > 0) AS cross_source_leads, count(*) FILTER (lead_type <> 'NETWORK') AS entity_leads, count(*) FILTER (lead_type = 'NETWORK') AS network_leads,
  round(avg(risk_score)::DECIMAL(18, 8), 2)::DOUBLE AS average_risk, round(avg(confidence_score)::DECIMAL(18, 8), 4)::DOUBLE AS average_confidence, round(avg(completeness)::DECIMAL(18, 8), 2)::DOUBLE AS average_completeness,
  (SELECT string_agg(m, '|' ORDER BY n DESC, m) FROM (SELECT * FROM words ORDER BY n DESC, m LIMIT 5)) AS most_common_markers, (SELECT string_agg(s, '|' ORDER BY n DESC, s) FROM (SELECT * FROM combined ORDER BY n DESC, s LIMIT 5)) AS most_common_source_combinations FROM leads""")
def lead_summary(spark, sf_dir):
    leads = stored(lead_candidates(spark, sf_dir), "leads")
    said = F.when(F.col("lead_type") != "NETWORK", F.col("explanation")).otherwise("")
    return reports.investigation_summary(leads.withColumn("marker_names", said).drop("markers").withColumnRenamed("marker_names", "markers"))


@R.query(f"""WITH {_RISK}
SELECT (SELECT count(*) FROM fired) AS total_markers, (SELECT round(avg(confidence)::DECIMAL(18, 8), 2)::DOUBLE FROM fired) AS avg_marker_score, (SELECT count(*) FROM entities) AS total_entities, (SELECT count(*) FROM edges) AS total_relationships,
  count(*) FILTER (risk_score >= 60) AS high_risk_entities, count(*) FILTER (risk_score >= 30 AND risk_score < 60) AS medium_risk_entities, round(avg(mean_confidence)::DECIMAL(18, 8), 2)::DOUBLE AS avg_confidence,
  count(*) FILTER (risk_score >= 90) AS critical_leads, count(*) FILTER (risk_score >= 60) AS high_priority_leads, count(*) FILTER (mean_confidence >= 0.75) AS high_confidence_leads, count(*) FILTER (sources > 1) AS cross_source_leads, least(count(*), 10) AS newest_leads FROM banded""")
def dashboard_metrics(spark, sf_dir):
    """Entities' risks stand for leads too: their bands are priorities here."""
    g = entity_graph(spark, sf_dir)
    g = markers.Graph(stored(g.entities, "entities"), stored(g.edges, "edges"))
    fired = stored(markers.run_markers(g), "fired")
    risk = stored(markers.entity_risk(g, fired), "risk")
    level = F.when(F.col("risk_score") >= 60, "High").when(F.col("risk_score") >= 30, "Medium").otherwise("Low")
    leads = risk.select(F.when(F.col("risk_score") >= 90, "critical").when(F.col("risk_score") >= 60, "High").otherwise("Low").alias("priority"), F.when(F.col("mean_confidence") >= 0.75, "High").otherwise("Low").alias("confidence"), "sources")
    return reports.dashboard_metrics(fired.withColumn("score", F.col("confidence")), g.entities, g.edges, risk.withColumn("risk_level", level), leads)

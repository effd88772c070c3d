"""Marker rules, their union, summary, entity risk and leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.operators import leads, markers, observations
from cairnlake.plans.registry import Registry
from cairnlake.sources.tables import GRAPH_SQL, edges, entities, graph, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: Every marker as SQL: (entity_id, marker, support, score, source_count, sources, related) before the gate, then records.
_MEMBERS = """
SELECT p.src AS entity_id, '{name}' AS marker, g.n AS support, least({base}::DOUBLE + {step}::DOUBLE * g.n, {cap}::DOUBLE) AS score, g.k AS source_count, g.sources, p.dst AS related
FROM (SELECT DISTINCT src, dst FROM ends WHERE {where}) p
JOIN (SELECT dst, count(DISTINCT src) AS n, count(DISTINCT src_source) AS k, string_agg(DISTINCT src_source, '|' ORDER BY src_source) AS sources FROM ends WHERE {where} GROUP BY dst HAVING count(DISTINCT src) >= 2) g USING (dst)"""
_TARGETS = """
SELECT dst AS entity_id, '{name}' AS marker, count(DISTINCT src) AS support, least({base}::DOUBLE + {step}::DOUBLE * count(DISTINCT src), {cap}::DOUBLE) AS score, count(DISTINCT src_source) AS source_count,
  string_agg(DISTINCT src_source, '|' ORDER BY src_source) AS sources, min(src) AS related FROM ends WHERE {where} GROUP BY dst HAVING count(DISTINCT src) >= 2"""
_PLACED = "kind IN ('LOCATED_AT', 'BUSINESS_LOCATED_AT', 'BUSINESS_PRINCIPAL_ADDRESS') AND src_type = 'business' AND dst_type = 'address'"
_MAILBOX = " OR ".join(f"upper(dst_name) LIKE '%{w}%'" for w in ("PO BOX", "P O BOX", "PMB", "MAIL DROP", "UPS STORE", "BOX "))
_TWINS = """
SELECT o.entity_id, '{name}' AS marker, count(*) AS support, least({base}::DOUBLE + 0.05::DOUBLE * count(*), {cap}::DOUBLE) AS score, (SELECT count(*) FROM (SELECT any_value(o.source_name) AS s UNION SELECT unnest(list(x.source_name)) AS s)) AS source_count,
  (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT any_value(o.source_name) AS s UNION SELECT unnest(list(x.source_name)) AS s)) AS sources, min(x.entity_id) AS related
FROM entities o JOIN entities x USING (normalized_value) WHERE {ours} AND x.entity_type IN ('business', 'owner', 'officer', 'person', 'registered_agent') AND {others} GROUP BY o.entity_id"""
_FIRED = f"""
ends AS (
  SELECT e.src, e.dst, e.kind, e.source_name, coalesce(s.entity_type, '') AS src_type, coalesce(s.source_name, '') AS src_source, coalesce(t.entity_type, '') AS dst_type, coalesce(t.source_name, '') AS dst_source, t.display_name AS dst_name
  FROM edges e LEFT JOIN entities s ON e.src = s.entity_id LEFT JOIN entities t ON e.dst = t.entity_id),
around AS (
  SELECT i.entity_id, count(*) AS n, count(DISTINCT coalesce(t.entity_type, '')) AS types, string_agg(DISTINCT coalesce(t.entity_type, ''), '|' ORDER BY coalesce(t.entity_type, '')) AS type_names, count(DISTINCT i.kind) AS kinds,
    count(DISTINCT i.source_name) AS sources, string_agg(DISTINCT i.source_name, '|' ORDER BY i.source_name) AS source_names
  FROM incident i LEFT JOIN entities t ON i.other = t.entity_id GROUP BY i.entity_id),
named AS (SELECT e.dst, b.entity_id, b.normalized_value AS name, b.source_name FROM (SELECT DISTINCT src, dst FROM ends WHERE {_PLACED}) e JOIN entities b ON b.entity_id = e.src),
alike AS (SELECT l.dst, l.entity_id AS left_id, r.entity_id AS right_id FROM named l JOIN named r ON l.dst = r.dst AND l.name = r.name AND l.entity_id < r.entity_id),
alike_members AS (SELECT DISTINCT dst, left_id, left_id AS entity_id FROM alike UNION ALL SELECT dst, left_id, right_id FROM alike),
single AS (
  {_MEMBERS.format(name="shared_address_businesses", base=0.55, step=0.08, cap=0.95, where=_PLACED)}
  UNION ALL {_TARGETS.format(name="mailbox_address_cluster", base=0.6, step=0.05, cap=0.92, where="(kind LIKE '%ADDRESS%' OR kind = 'LOCATED_AT') AND dst_type = 'address' AND (" + _MAILBOX + ")")}
  UNION ALL {_TARGETS.format(name="mailing_address_reuse", base=0.58, step=0.06, cap=0.88, where="kind = 'PROPERTY_HAS_MAILING_ADDRESS'")}
  UNION ALL {_MEMBERS.format(name="business_mailing_address_cluster", base=0.62, step=0.06, cap=0.94, where="kind = 'BUSINESS_MAILING_ADDRESS' AND src_type = 'business' AND dst_type = 'address'")}
  UNION ALL {_MEMBERS.format(name="shared_phone", base=0.6, step=0.07, cap=0.93, where="kind = 'USES_PHONE' AND dst_type = 'phone'")}
  UNION ALL {_MEMBERS.format(name="shared_email", base=0.6, step=0.07, cap=0.93, where="kind = 'USES_EMAIL' AND dst_type = 'email'")}
  UNION ALL {_MEMBERS.format(name="shared_website", base=0.6, step=0.07, cap=0.93, where="kind = 'HAS_WEBSITE' AND dst_type = 'website'")}
  UNION ALL SELECT entity_id, 'similar_business_names', n, 0.62::DOUBLE, 1, 'registry', dst FROM alike_members JOIN (SELECT dst, left_id, count(*) AS n FROM alike_members GROUP BY ALL) USING (dst, left_id)
  UNION ALL {_TWINS.format(name="arcgis_owner_in_business_records", base=0.72, cap=0.96, ours="o.entity_type = 'owner' AND o.source_type = 'arcgis'", others="x.source_type <> 'arcgis'")}
  UNION ALL {_TWINS.format(name="county_clerk_party_in_business_records", base=0.7, cap=0.94, ours="o.entity_type IN ('person', 'business', 'owner') AND o.source_name = 'county_clerk_local_file'", others="x.source_name <> 'county_clerk_local_file'")}
  UNION ALL SELECT src, 'officer_controls_many_businesses', count(DISTINCT dst), least(0.68::DOUBLE + 0.04::DOUBLE * count(DISTINCT dst), 0.96::DOUBLE), 2, CASE WHEN any_value(src_source) < 'registry' THEN any_value(src_source) || '|registry' ELSE 'registry|' || any_value(src_source) END, min(dst)
    FROM ends WHERE src_type = 'officer' AND kind = 'OFFICER_OF' GROUP BY src
  UNION ALL SELECT src, 'registered_agent_dense_network', count(DISTINCT dst) FILTER (kind = 'REGISTERED_AGENT_FOR'),
    least(0.66::DOUBLE + 0.05::DOUBLE * count(DISTINCT dst) FILTER (kind = 'REGISTERED_AGENT_FOR') + 0.02::DOUBLE * count(*) FILTER (kind LIKE 'REGISTERED_AGENT%ADDRESS'), 0.97::DOUBLE), 2,
    CASE WHEN any_value(src_source) < 'registry' THEN any_value(src_source) || '|registry' ELSE 'registry|' || any_value(src_source) END, min(dst) FILTER (kind = 'REGISTERED_AGENT_FOR')
    FROM ends WHERE src_type = 'registered_agent' GROUP BY src
    HAVING count(*) FILTER (kind = 'REGISTERED_AGENT_FOR') > 0 AND (count(*) FILTER (kind LIKE 'REGISTERED_AGENT%ADDRESS') > 1 OR count(*) FILTER (kind <> 'REGISTERED_AGENT_FOR' AND kind NOT LIKE 'REGISTERED_AGENT%ADDRESS') > 0)
  UNION ALL SELECT a.entity_id, 'dense_entity_cluster', n, least(0.5::DOUBLE + 0.03::DOUBLE * n, 0.9::DOUBLE), 1, e.source_name, type_names FROM around a JOIN entities e USING (entity_id) WHERE types >= 2 AND a.entity_id IN (SELECT src FROM edges)
  UNION ALL SELECT a.entity_id, 'bridge_entity', n, least(0.58::DOUBLE + 0.04::DOUBLE * types + 0.03::DOUBLE * sources, 0.91::DOUBLE), sources, source_names, type_names FROM around a JOIN entities e USING (entity_id) WHERE types >= 2 AND kinds >= 2),
rules (marker, category, weight, least_confidence, least_support, least_sources) AS (VALUES
  ('shared_address_businesses', 'address', 18, 0.65, 2, 1), ('mailbox_address_cluster', 'address', 16, 0.6, 2, 1), ('mailing_address_reuse', 'address', 14, 0.6, 2, 1), ('business_mailing_address_cluster', 'address', 17, 0.65, 2, 1),
  ('shared_phone', 'communication', 14, 0.65, 2, 1), ('shared_email', 'communication', 12, 0.65, 2, 1), ('shared_website', 'communication', 10, 0.65, 2, 1), ('similar_business_names', 'business', 11, 0.55, 2, 1),
  ('arcgis_owner_in_business_records', 'cross_source', 20, 0.7, 1, 2), ('county_clerk_party_in_business_records', 'cross_source', 18, 0.7, 1, 2), ('officer_controls_many_businesses', 'control', 18, 0.7, 3, 1),
  ('registered_agent_dense_network', 'network', 18, 0.7, 3, 1), ('dense_entity_cluster', 'network', 12, 0.55, 4, 1), ('bridge_entity', 'network', 15, 0.6, 3, 2), ('business_cluster_compound', 'compound', 24, 0.75, 2, 1)),
passed AS (SELECT s.* FROM single s JOIN rules r USING (marker) WHERE s.support >= r.least_support AND s.score >= r.least_confidence::DOUBLE AND s.source_count >= r.least_sources),
components AS (SELECT entity_id, marker, unnest(string_split(sources, '|')) AS source FROM passed WHERE marker IN ('shared_address_businesses', 'shared_phone', 'shared_email', 'shared_website', 'similar_business_names')),
every AS (
  SELECT * FROM passed UNION ALL
  SELECT entity_id, 'business_cluster_compound', count(DISTINCT marker), least(0.72::DOUBLE + 0.06::DOUBLE * count(DISTINCT marker), 0.97::DOUBLE), count(DISTINCT source), string_agg(DISTINCT source, '|' ORDER BY source), string_agg(DISTINCT marker, '|' ORDER BY marker)
  FROM components GROUP BY entity_id HAVING count(DISTINCT marker) >= 2),
fired AS (
  SELECT entity_id, marker, category, support::BIGINT AS support, round(score, 4)::DOUBLE AS confidence, CASE WHEN score >= 0.9 THEN 'Very High' WHEN score >= 0.75 THEN 'High' WHEN score >= 0.55 THEN 'Medium' WHEN score >= 0.35 THEN 'Low' ELSE 'Unknown' END AS confidence_label,
    weight::BIGINT AS risk, weight::BIGINT AS raw_risk, 0::BIGINT AS adjustment, 0::DOUBLE AS rarity, '' AS rarity_level, sources, source_count::BIGINT AS source_count, related FROM every JOIN rules USING (marker))"""


def _fired(*names: str) -> str:
    return f"WITH {GRAPH_SQL}, {_FIRED} SELECT * FROM fired WHERE marker IN ({', '.join(repr(n) for n in names)})"


@R.query(_fired("shared_address_businesses"))
def shared_address_businesses(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "shared_address_businesses")


@R.query(_fired("mailing_address_reuse"))
def mailing_reuse(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "mailing_address_reuse")


@R.query(_fired("mailbox_address_cluster"))
def mailbox_cluster(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "mailbox_address_cluster")


@R.query(_fired("business_mailing_address_cluster"))
def business_mailing_cluster(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "business_mailing_address_cluster")


@R.query(_fired("shared_phone", "shared_email", "shared_website"))
def shared_identifier_members(spark, sf_dir):
    g = graph(spark, sf_dir)
    return markers.fire(g, "shared_phone").unionByName(markers.fire(g, "shared_email")).unionByName(markers.fire(g, "shared_website"))


@R.query(_fired("similar_business_names"))
def similar_business_names(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "similar_business_names")


@R.query(_fired("arcgis_owner_in_business_records"))
def owners_in_business_records(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "arcgis_owner_in_business_records")


@R.query(_fired("county_clerk_party_in_business_records"))
def clerk_parties_in_business_records(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "county_clerk_party_in_business_records")


@R.query(_fired("officer_controls_many_businesses"))
def many_controls(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "officer_controls_many_businesses")


@R.query(_fired("registered_agent_dense_network"))
def agent_density(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "registered_agent_dense_network")


@R.query(_fired("dense_entity_cluster"))
def dense_cluster(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "dense_entity_cluster")


@R.query(_fired("bridge_entity"))
def bridge_entity(spark, sf_dir):
    return markers.fire(graph(spark, sf_dir), "bridge_entity")


@R.query(_fired("business_cluster_compound"))
def compound_marker(spark, sf_dir):
    return markers.run_markers(graph(spark, sf_dir)).where("marker = 'business_cluster_compound'")


@R.query(f"""WITH {GRAPH_SQL}, {_FIRED}
SELECT marker, category, count(*) AS n, count(DISTINCT entity_id) AS entities, round(avg(risk), 4)::DOUBLE AS mean_risk, round(avg(support), 4)::DOUBLE AS mean_support, round(avg(confidence), 4)::DOUBLE AS mean_confidence, round(avg(rarity), 4)::DOUBLE AS mean_rarity
FROM fired GROUP BY marker, category""")
def marker_summary(spark, sf_dir):
    return markers.marker_summary(markers.run_markers(graph(spark, sf_dir)))


@R.query(f"""WITH {GRAPH_SQL}, {_FIRED}
SELECT risk AS risk_score, CASE WHEN risk >= 70 THEN 'High' WHEN risk >= 35 THEN 'Medium' WHEN risk >= 1 THEN 'Low' ELSE 'None' END AS risk_level, marker AS rule, entity_id || '|' || related AS entity_ids,
  concat_ws('|', CASE WHEN entity_id LIKE 'a:%' THEN entity_id END, CASE WHEN related LIKE 'a:%' THEN related END) AS addresses, CASE WHEN related LIKE 'ph:%' THEN related ELSE '' END AS phones, category AS source_table, sources AS source_name FROM fired""")
def anomaly_view(spark, sf_dir):
    return markers.anomaly_view(markers.run_markers(graph(spark, sf_dir)))


_RISK = f"""{GRAPH_SQL}, {_FIRED},
said AS (SELECT *, CASE confidence_label WHEN 'Very High' THEN 1.0 WHEN 'High' THEN 0.85 WHEN 'Medium' THEN 0.65 WHEN 'Low' THEN 0.45 ELSE 0.25 END::DOUBLE AS s FROM fired),
by_marker AS (
  SELECT entity_id, sum(risk)::BIGINT AS marker_risk, count(*) AS markers, round(avg(s), 6) AS mean, string_agg(DISTINCT marker, '|' ORDER BY marker) AS rules, arg_max(marker, (risk, confidence, marker)) AS top_marker FROM said GROUP BY entity_id),
backing AS (SELECT entity_id, unnest(string_split(sources, '|')) AS source FROM fired UNION SELECT entity_id, source_name FROM entities),
by_source AS (SELECT entity_id, count(*) AS sources, string_agg(source, '|' ORDER BY source) AS source_names FROM backing GROUP BY entity_id),
risk AS (
  SELECT e.entity_id, e.entity_type, e.display_name, e.source_type, coalesce(m.markers, 0)::BIGINT AS markers, coalesce(a.n, 0)::BIGINT AS degree, b.sources::BIGINT AS sources, b.source_names, coalesce(m.mean, 0)::DOUBLE AS mean, coalesce(m.rules, '') AS rules, coalesce(m.top_marker, '') AS top_marker,
    least(coalesce(marker_risk, 0) + least(coalesce(a.n, 0) * 2, 20) + CASE WHEN b.sources >= 3 THEN 5 ELSE 0 END + CASE WHEN m.mean >= 0.9 THEN 10 WHEN m.mean >= 0.75 THEN 6 WHEN m.mean >= 0.55 THEN 3 ELSE 0 END, 100)::BIGINT AS risk_score
  FROM entities e JOIN by_source b USING (entity_id) LEFT JOIN by_marker m USING (entity_id) LEFT JOIN around a USING (entity_id)),
banded AS (
  SELECT entity_id, entity_type, display_name, source_names, source_type, markers, degree, sources, risk_score, CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 35 THEN 'Medium' WHEN risk_score >= 1 THEN 'Low' ELSE 'None' END AS risk_level,
    CASE WHEN mean >= 0.9 THEN 'Very High' WHEN mean >= 0.75 THEN 'High' WHEN mean >= 0.55 THEN 'Medium' WHEN mean >= 0.35 THEN 'Low' ELSE 'Unknown' END AS confidence, round(mean, 4)::DOUBLE AS mean_confidence, rules, top_marker FROM risk)"""


@R.query(f"WITH {_RISK} SELECT * FROM banded")
def entity_risk(spark, sf_dir):
    g = graph(spark, sf_dir)
    return markers.entity_risk(g, markers.run_markers(g))


_OBSERVED = f"""{GRAPH_SQL},
real_edges AS (SELECT * FROM edges WHERE source_type <> 'synthetic'),
ends AS (SELECT e.src, e.dst, e.kind, e.source_name, coalesce(s.entity_type, '') AS src_type, coalesce(t.entity_type, '') AS dst_type FROM real_edges e LEFT JOIN entities s ON e.src = s.entity_id LEFT JOIN entities t ON e.dst = t.entity_id),
at_place AS (SELECT * FROM ends WHERE dst_type = 'address' AND kind IN ('LOCATED_AT', 'PROPERTY_HAS_MAILING_ADDRESS', 'PROPERTY_HAS_SITUS_ADDRESS')),
places AS (
  SELECT dst, count(DISTINCT src) FILTER (src_type = 'business') AS businesses, count(DISTINCT src) FILTER (kind = 'PROPERTY_HAS_MAILING_ADDRESS') AS mailings, count(DISTINCT src) AS everyone,
    CASE WHEN any_value(d.display_name) LIKE 'PO BOX%' THEN 'VIRTUAL_OFFICE_OR_MAILBOX' WHEN any_value(d.display_name) LIKE '%COUNTY%' THEN 'GOVERNMENT_FACILITY' WHEN any_value(d.display_name) LIKE '% APT %' THEN 'EXACT_APARTMENT_OR_UNIT'
      WHEN any_value(d.display_name) LIKE '%PLAZA%' THEN 'COMMERCIAL_PROPERTY' ELSE 'UNKNOWN' END AS context
  FROM at_place JOIN entities d ON d.entity_id = dst GROUP BY dst),
used AS (SELECT DISTINCT kind, dst, src FROM ends WHERE kind IN ('USES_PHONE', 'USES_EMAIL', 'HAS_WEBSITE')),
both_ends AS (SELECT src AS entity_id, dst_type AS type, source_name FROM ends UNION ALL SELECT dst, src_type, source_name FROM ends),
degrees AS (SELECT entity_id, count(*) AS n, count(DISTINCT source_name) + count(DISTINCT nullif(type, '')) AS reach FROM both_ends GROUP BY entity_id),
people AS (SELECT * FROM entities WHERE source_type <> 'synthetic' AND entity_type IN ('owner', 'business', 'person', 'registered_agent', 'officer')),
observed AS (
  SELECT 'shared_address_businesses' AS marker, src AS entity_id, context, businesses AS observed, context AS hint FROM (SELECT DISTINCT src, dst FROM at_place WHERE src_type = 'business') JOIN places USING (dst)
  UNION ALL SELECT 'mailing_address_reuse', dst, context, mailings, context FROM places WHERE mailings > 0
  UNION ALL SELECT 'mailbox_address_cluster', dst, context, everyone, context FROM places WHERE context = 'VIRTUAL_OFFICE_OR_MAILBOX'
  UNION ALL SELECT CASE kind WHEN 'USES_PHONE' THEN 'shared_phone' WHEN 'USES_EMAIL' THEN 'shared_email' ELSE 'shared_website' END, src, 'UNKNOWN', count(*) OVER (PARTITION BY kind, dst), NULL FROM used
  UNION ALL SELECT 'dense_entity_cluster', entity_id, 'UNKNOWN', n, NULL FROM degrees UNION ALL SELECT 'bridge_entity', entity_id, 'UNKNOWN', reach, NULL FROM degrees
  UNION ALL SELECT 'arcgis_owner_in_business_records', o.entity_id, 'UNKNOWN', count(*), 'owner_cross_source' FROM people o JOIN people x USING (normalized_value) WHERE o.entity_type = 'owner' AND o.source_type = 'arcgis' AND x.source_type <> 'arcgis' GROUP BY o.entity_id
  UNION ALL SELECT 'county_clerk_party_in_business_records', o.entity_id, 'UNKNOWN', count(*), 'clerk_cross_source' FROM people o JOIN people x USING (normalized_value)
    WHERE o.source_name = 'county_clerk_local_file' AND x.source_name <> 'county_clerk_local_file' AND x.entity_type <> 'owner' GROUP BY o.entity_id),
grouped AS (SELECT o.*, e.entity_type, e.source_name, concat_ws('|', o.marker, e.entity_type, 'REAL_ONLY', o.context, 'ALL', coalesce(o.hint, e.entity_type)) AS "group" FROM observed o JOIN entities e USING (entity_id)),
peers AS (SELECT "group", count(*) AS peers, avg(observed) AS mean, median(observed::DOUBLE) AS med FROM grouped GROUP BY 1),
spread AS (SELECT "group", median(abs(observed - med)) AS mad FROM grouped JOIN peers USING ("group") GROUP BY 1),
judged AS (
  SELECT g.*, peers, mean, round(cume_dist() OVER (PARTITION BY "group" ORDER BY observed), 4)::DOUBLE AS percentile, CASE WHEN peers >= 5 AND mad <> 0 THEN round(0.6745::DOUBLE * (observed - med) / mad, 4) END AS z
  FROM grouped g JOIN peers USING ("group") JOIN spread USING ("group")),
tails AS (
  SELECT "group", observed, CASE WHEN any_value(peers) >= 5 THEN least(greatest(1 - coalesce((SELECT sum(exp(-any_value(mean) + v * ln(any_value(mean)) - lgamma(v + 1))) FROM range(any_value(observed)::BIGINT) t(v)), 0), 0), 1) END AS p FROM judged GROUP BY 1, 2),
scored AS (
  SELECT j.*, p, CASE WHEN peers < 5 THEN 0 ELSE round(greatest(CASE WHEN p > 0 THEN least(greatest(-25 * log10(greatest(p, 1e-9)), 0), 100) ELSE 0 END, greatest((percentile - 0.5) * 200, 0), least(greatest(coalesce(z, 0) / 6 * 100, 0), 100)), 2) END::DOUBLE AS rarity,
    CASE WHEN peers < 5 THEN 'INSUFFICIENT_BASELINE' WHEN p <= 0.001 THEN 'EXTREME_OUTLIER' WHEN p <= 0.01 THEN 'IMMEDIATE_REVIEW' WHEN p <= 0.05 THEN 'ELEVATED_REVIEW' WHEN p <= 0.15 THEN 'ROUTINE_REVIEW' ELSE 'COMMON' END AS level
  FROM judged j JOIN tails USING ("group", observed)),
weighed AS (
  SELECT *, CASE marker WHEN 'shared_address_businesses' THEN 18 WHEN 'shared_phone' THEN 14 WHEN 'shared_email' THEN 12 WHEN 'shared_website' THEN 10 WHEN 'arcgis_owner_in_business_records' THEN 20 WHEN 'county_clerk_party_in_business_records' THEN 20 ELSE 12 END AS base,
    CASE WHEN marker IN ('shared_address_businesses', 'mailbox_address_cluster', 'mailing_address_reuse') THEN CASE context WHEN 'EXACT_APARTMENT_OR_UNIT' THEN 6 WHEN 'COMMERCIAL_PROPERTY' THEN -6 WHEN 'VIRTUAL_OFFICE_OR_MAILBOX' THEN -4 WHEN 'GOVERNMENT_FACILITY' THEN -6 ELSE 0 END
      WHEN marker IN ('shared_phone', 'shared_email', 'shared_website') AND observed >= 5 THEN -2 ELSE 0 END + CASE WHEN level IN ('ELEVATED_REVIEW', 'IMMEDIATE_REVIEW', 'EXTREME_OUTLIER') THEN 2 ELSE 0 END AS adjustment
  FROM scored)"""


@R.query(f"""WITH {_OBSERVED}
SELECT marker, entity_id, entity_type, source_name, context AS address_context, observed::DOUBLE AS observed, "group", peers::BIGINT AS peers, round(mean, 4)::DOUBLE AS expected, percentile, round(p, 6)::DOUBLE AS probability, rarity, level, base::BIGINT AS base, adjustment::BIGINT AS adjustment, greatest(1, base + adjustment)::BIGINT AS adjusted
FROM weighed""")
def statistical_rarity(spark, sf_dir):
    rare = observations.rarity(observations.observations(entities(spark, sf_dir), edges(spark, sf_dir)))
    return rare.select("marker", "entity_id", "entity_type", "source_name", "address_context", "observed", "group", "peers", "expected", "percentile", F.round("probability", 6).alias("probability"), "rarity", "level", "base", "adjustment", "adjusted")


@R.query(f"""WITH {_OBSERVED}
SELECT count(*) AS evaluated, count(*) FILTER (adjustment > 0) AS elevated, count(*) FILTER (adjustment < 0) AS reduced, count(*) FILTER (adjustment = 0) AS unchanged, count(*) FILTER (level = 'INSUFFICIENT_BASELINE') AS insufficient_baseline, count(*) FILTER (level = 'COMMON') AS common,
  count(*) FILTER (level = 'ROUTINE_REVIEW') AS routine_review, count(*) FILTER (level = 'ELEVATED_REVIEW') AS elevated_review, count(*) FILTER (level = 'IMMEDIATE_REVIEW') AS immediate_review, count(*) FILTER (level = 'EXTREME_OUTLIER') AS extreme_outlier FROM weighed""")
def calibration_report(spark, sf_dir):
    return observations.calibration(observations.rarity(observations.observations(entities(spark, sf_dir), edges(spark, sf_dir))))


@R.query(f"""WITH {_OBSERVED}
SELECT 'positive' AS direction, marker, entity_id, adjustment::BIGINT AS adjustment FROM (SELECT * FROM weighed ORDER BY adjustment DESC, marker, entity_id, "group" LIMIT 5)
UNION ALL SELECT 'negative', marker, entity_id, adjustment::BIGINT FROM (SELECT * FROM weighed ORDER BY adjustment, marker, entity_id, "group" LIMIT 5)""")
def largest_adjustments(spark, sf_dir):
    return observations.largest_adjustments(observations.rarity(observations.observations(entities(spark, sf_dir), edges(spark, sf_dir))))


@R.query(f"""WITH {_OBSERVED}, {_FIRED.replace("ends AS (", "all_ends AS (", 1).replace("FROM ends", "FROM all_ends")},
best AS (SELECT entity_id, marker, arg_max(adjustment, (rarity, observed, "group")) AS adjustment, arg_max(greatest(1, base + adjustment), (rarity, observed, "group")) AS adjusted, max(rarity) AS rarity, arg_max(level, (rarity, observed, "group")) AS level FROM weighed GROUP BY 1, 2)
SELECT f.entity_id, f.marker, f.related, f.raw_risk, coalesce(b.adjusted, f.raw_risk)::BIGINT AS risk, coalesce(b.adjustment, 0)::BIGINT AS adjustment, coalesce(b.rarity, 0)::DOUBLE AS rarity, coalesce(b.level, '') AS rarity_level FROM fired f LEFT JOIN best b ON f.entity_id = b.entity_id AND f.marker = b.marker""")
def adjusted_markers(spark, sf_dir):
    g = graph(spark, sf_dir)
    statistics = observations.marker_statistics(observations.rarity(observations.observations(g.entities, g.edges)))
    return markers.run_markers(g, statistics=statistics).select("entity_id", "marker", "related", "raw_risk", "risk", "adjustment", "rarity", "rarity_level")


@R.query(f"""WITH {_RISK}
SELECT risk_level, count(*) AS entities, sum(markers)::BIGINT AS markers, max(risk_score) AS most FROM banded GROUP BY risk_level""")
def investigation_summary(spark, sf_dir):
    return entity_risk(spark, sf_dir).groupBy("risk_level").agg(F.count(F.lit(1)).alias("entities"), F.sum("markers").alias("markers"), F.max("risk_score").alias("most"))


@R.query("""
WITH per AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS largest, count(DISTINCT o_orderpriority) AS kinds, bool_or(o_orderstatus = 'F') AS any_f, bool_or(o_orderstatus = 'P') AS any_p, min(o_orderdate) AS first_seen FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(((CASE WHEN n >= 3 THEN 2 ELSE 0 END) + (CASE WHEN largest >= 300000 THEN 1 ELSE 0 END) + (CASE WHEN any_f THEN 1 ELSE 0 END) + (CASE WHEN any_p THEN 1 ELSE 0 END)) / 5.0::DOUBLE * 100, 2)::DOUBLE AS completeness,
  round(least(least(n, 30) / 30.0::DOUBLE * 100 * 0.5::DOUBLE + least(kinds, 5) / 5.0::DOUBLE * 100 * 0.3::DOUBLE + least(largest, 500000) / 500000.0::DOUBLE * 100 * 0.2::DOUBLE, 100), 2)::DOUBLE AS priority
FROM per""")
def priority_score(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest"), F.countDistinct("o_orderpriority").alias("kinds"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_p")
    )
    complete = scores.completeness([(F.col("n") >= 3, 2), (F.col("largest") >= 300000, 1), (F.col("any_f"), 1), (F.col("any_p"), 1)])
    urgent = leads.priority([(F.col("n"), 30, 0.5), (F.col("kinds"), 5, 0.3), (F.col("largest"), 500000, 0.2)])
    return per.select("o_custkey", F.round(complete, 2).alias("completeness"), F.round(urgent, 2).alias("priority"))


@R.query("""
WITH l AS (SELECT o_orderkey AS lead_id, o_custkey, o_orderstatus, o_totalprice AS priority, o_totalprice / 2 AS risk, 0.5::DOUBLE AS confidence, o_orderpriority AS source FROM orders)
SELECT o_custkey, o_orderstatus, arg_max(lead_id, (priority, risk, confidence, lead_id)) AS lead_id, max(priority) AS priority, max(risk) AS risk, max(confidence) AS confidence, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(*) AS merged
FROM l GROUP BY o_custkey, o_orderstatus""")
def lead_consolidation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("lead_id"), "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("priority"), (F.col("o_totalprice") / 2).alias("risk"), F.lit(0.5).alias("confidence"), F.col("o_orderpriority").alias("source")
    )
    return leads.consolidate(rows, ["o_custkey", "o_orderstatus"])


@R.query("""
SELECT lead_id, evidence_kind, reference, row_number() OVER (PARTITION BY lead_id ORDER BY evidence_kind, reference) AS n FROM (
  SELECT o_custkey AS lead_id, 'order' AS evidence_kind, o_orderkey::VARCHAR AS reference FROM orders
  UNION ALL SELECT c_custkey, 'address', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)""")
def evidence_index(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    of = lambda df, key, reference: df.select(F.col(key).alias("lead_id"), F.col(reference).alias("reference"))
    return leads.evidence_index({"order": of(orders, "o_custkey", "o_orderkey"), "address": of(customers, "c_custkey", "c_nationkey"), "segment": of(customers, "c_custkey", "c_mktsegment")})


@R.query("""
SELECT user_id, ts, event_type, row_number() OVER w AS n, CASE WHEN lag(ts) OVER w IS NULL THEN NULL ELSE (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 86400000000 END AS days_since
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)""")
def event_timeline(spark, sf_dir):
    return leads.timeline(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@R.query("""
WITH f AS (SELECT o_orderkey, (o_totalprice > 400000)::INT * 0.4::DOUBLE + (o_orderpriority LIKE '1-%')::INT * 0.3::DOUBLE + (o_orderstatus = 'P')::INT * 0.35::DOUBLE AS s,
  o_totalprice > 400000 AS a, o_orderpriority LIKE '1-%' AS b, o_orderstatus = 'P' AS c FROM orders)
SELECT o_orderkey, round(least(greatest(s, 0), 1), 4)::DOUBLE AS score, CASE WHEN s >= 0.9 THEN 'ACCEPTED_EXACT' WHEN s >= 0.72 THEN 'REVIEW_STRONG' WHEN s >= 0.45 THEN 'REVIEW_WEAK' ELSE 'REJECTED' END AS decision,
  concat_ws('; ', CASE WHEN a THEN 'large' END, CASE WHEN b THEN 'urgent' END, CASE WHEN c THEN 'pending' END) AS why FROM f""")
def weighted_score_bands(spark, sf_dir):
    flags = {"large": F.col("o_totalprice") > 400000, "urgent": F.col("o_orderpriority").startswith("1-"), "pending": F.col("o_orderstatus") == "P"}
    score = scores.weighted_flags(flags, {"large": 0.4, "urgent": 0.3, "pending": 0.35})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 4).alias("score"), scores.banded(score, scores.MATCH_BANDS, "REJECTED").alias("decision"), scores.explain_flags(flags).alias("why"))


_LEAD_KINDS = "(VALUES (0, 'address'), (1, 'Property'), (2, 'phone'), (3, 'email'), (4, 'website'), (5, 'business'), (6, 'person'), (7, 'officer')) AS kinds(k, entity_type)"


@R.query(f"""
WITH per AS (SELECT c_custkey, entity_type, count(*) FILTER (o_orderstatus = 'P') AS matches, count(o_orderkey) AS events, coalesce(string_agg(DISTINCT CASE WHEN o_totalprice > 450000 THEN 'shared_phone' END, '|'), '') AS markers
  FROM customer JOIN {_LEAD_KINDS} ON k = c_custkey % 8 LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
typed AS (SELECT *, CASE WHEN matches > 0 THEN 'CROSS_SOURCE_CLUSTER' WHEN entity_type = 'address' THEN 'ADDRESS_CLUSTER' WHEN entity_type = 'Property' THEN 'PROPERTY_CLUSTER' WHEN entity_type IN ('phone', 'email', 'website') THEN 'COMMUNICATION_CLUSTER'
  WHEN entity_type = 'business' THEN 'BUSINESS_CLUSTER' WHEN events >= 5 THEN 'TEMPORAL_CLUSTER' ELSE 'ENTITY' END AS lead_type FROM per)
SELECT c_custkey, lead_type, CASE WHEN lead_type = 'ADDRESS_CLUSTER' OR entity_type = 'address' THEN 'Verify whether the address' WHEN lead_type = 'PROPERTY_CLUSTER' OR entity_type = 'Property' THEN 'Compare parcel owner, mail' WHEN lead_type = 'COMMUNICATION_CLUSTER' OR markers <> '' THEN 'Review all entities sharin'
    WHEN lead_type = 'TEMPORAL_CLUSTER' THEN 'Review formation, filing, ' WHEN lead_type = 'CROSS_SOURCE_CLUSTER' THEN 'Compare records across ind' ELSE 'Review the primary entity,' END AS review, events * 10 < 60 AS validate,
  coalesce(nullif(concat_ws(' | ', 'Rules: ' || nullif(markers, ''), CASE WHEN events > 0 THEN 'Matched ' || events || ' anomaly findings' END), ''), 'High-risk entity identified by rule-based scoring') AS why,
  coalesce(nullif(concat_ws(' | ', 'Markers: ' || nullif(markers, ''), CASE WHEN events > 0 THEN 'Relationships: ' || events END, CASE WHEN matches > 0 THEN 'Sources: ' || matches END, CASE WHEN matches > 1 THEN 'Cross-source correlation detected' END, 'Top marker: ' || nullif(markers, '')), ''),
    'Rule-based lead generated for manual review.') AS explanation FROM typed""")
def lead_types(spark, sf_dir):
    """Kinds, recommendations and texts of a lead per customer, whose type goes by key and whose orders are its events."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("matches"), F.count(F.lit(1)).alias("events"), F.max(F.when(F.col("o_totalprice") > 450000, "shared_phone")).alias("markers"))
    kinds = spark.sql(f"SELECT * FROM {_LEAD_KINDS}")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 8).alias("k")).join(kinds, "k").join(orders, "c_custkey", "left").na.fill(0).na.fill("", ["markers"])
    rows = rows.withColumn("lead_type", leads.lead_type(F.col("entity_type"), F.col("matches"), F.col("events")))
    said = leads.recommendation(F.col("lead_type"), F.col("entity_type"), F.col("markers"), F.col("events") * 10)
    why = leads.why_flagged(F.col("markers"), F.lit(None).cast("string"), F.col("events"))
    explained = leads.risk_explanation(F.col("markers"), F.col("events"), F.col("matches"), F.col("matches") > 1, F.col("markers"))
    return rows.select("c_custkey", "lead_type", F.substring(said, 1, 26).alias("review"), said.endswith(leads.VALIDATE_FIRST).alias("validate"), why.alias("why"), explained.alias("explanation"))


@R.query("""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL)
SELECT o_custkey, arg_max(o_orderpriority, (n, -seen)) AS o_orderpriority FROM c GROUP BY o_custkey""")
def most_common_value(spark, sf_dir):
    return leads.most_common(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@R.query("""
SELECT l_orderkey, l_linenumber, (list_sort([l_discount * 100, l_tax * 100, l_quantity])[1] + list_sort([l_discount * 100, l_tax * 100, l_quantity])[2]) / 2 AS compound,
  CASE WHEN l_quantity > 24 THEN 'high' WHEN l_quantity > 14 THEN 'medium' ELSE 'low' END AS bin FROM lineitem""")
def compound_score(spark, sf_dir):
    values = F.array(F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.two_smallest_mean(values).alias("compound"), scores.binned(F.col("l_quantity"), (-1, 14, 24), ("low", "medium", "high")).alias("bin"))

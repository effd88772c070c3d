"""Providers beside parcels and the registry, the quality of registry matches, agents in context."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import correlation
from cairnlake.plans import entity_queries, source_queries
from cairnlake.plans.registry import Registry
from cairnlake.sources.scratch import stored
from cairnlake.sources.tables import GRAPH_SQL, edges, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: Parcels by the key of a part: an address written in its own way (its form goes by the key), an owner for odd keys; suppliers are the providers of ``source_queries``.
_PARCELS = """SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN p_partkey || ' MAIN ST, STE 5, MIAMI, FL' WHEN 3 THEN p_partkey || ' MAIN ST, STE 6, MIAMI' WHEN 4 THEN 'PO BOX ' || p_partkey WHEN 5 THEN p_partkey || ' Pine Road, Miami' WHEN 7 THEN p_partkey || ' ELM ST APT 2, MIAMI'
  ELSE p_partkey || ' N MAIN ST, MIAMI, FL 33101' END AS address, 'Ann Lee' || p_partkey AS owner, CASE WHEN cast(floor(p_partkey / 8) AS bigint) % 2 = 0 THEN 'PROPERTY_HAS_SITUS_ADDRESS' ELSE 'PROPERTY_HAS_MAILING_ADDRESS' END AS kind FROM {part}"""
#: How a provider's address and the parcel's of its key match, by form; forms 3 and 5 do not meet.
_PARCEL_SQL = """near AS (SELECT s_suppkey AS npi, s_suppkey % 8 AS form, s_suppkey % 2 = 0 AS firm, (s_suppkey // 8) % 2 = 0 AS situs FROM supplier JOIN part ON p_partkey = s_suppkey),
scoped AS (SELECT *, CASE WHEN form = 4 THEN 'PO_BOX' WHEN form IN (0, 7) THEN 'EXACT_UNIT' WHEN situs THEN 'EXACT_BUILDING' ELSE 'MAILING_ONLY' END AS scope FROM near WHERE form NOT IN (3, 5)),
placed AS (SELECT *, CASE scope WHEN 'PO_BOX' THEN 0 WHEN 'EXACT_UNIT' THEN CASE WHEN situs THEN 0.8 ELSE 0.24 END WHEN 'EXACT_BUILDING' THEN 0.76 ELSE 0.16 END::DOUBLE AS confidence, CASE WHEN situs THEN 'PROVIDER_PRACTICE_ADDRESS_TO_PARCEL_SITUS' ELSE 'PROVIDER_MAILING_ADDRESS_TO_PARCEL_MAILING' END AS match_type FROM scoped),
parcel_legs AS (
  SELECT npi, npi::VARCHAR AS parcel_id, match_type, scope, confidence, CASE WHEN confidence >= 0.72 THEN 'REVIEW_STRONG' ELSE 'REJECTED' END AS decision FROM placed
  UNION ALL SELECT npi, npi::VARCHAR, 'PROVIDER_NAME_TO_PARCEL_OWNER', 'INCOMPLETE', 0.28::DOUBLE, 'REJECTED' FROM near WHERE NOT firm)"""


def _parcel_legs(spark, sf_dir):
    made = stored(spark.sql(_PARCELS, part=table(spark, sf_dir, "part")), "parcels")
    key = F.col("k").cast("string")
    entity = lambda prefix, kind, name: made.select(F.concat(F.lit(prefix), key).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("display_name"))
    known = entity("property:", "property", "address").unionByName(entity("pa:", "address", "address")).unionByName(entity("po:", "owner", "owner"))
    edge = lambda prefix, kind: made.select(F.concat(F.lit(prefix), F.lit("r"), key).alias("relationship_id"), F.concat(F.lit("property:"), key).alias("src"), F.concat(F.lit(prefix), key).alias("dst"), kind.alias("kind"))
    tied = edge("pa:", F.col("kind")).unionByName(edge("po:", F.lit(correlation.OWNED)))
    return correlation.parcel_matches(source_queries.providers(spark, sf_dir), known, tied)


@R.query(f"WITH {_PARCEL_SQL} SELECT npi, parcel_id, 'nppes-parcel:' || npi || ':' || parcel_id || ':' || match_type AS match_id, match_type, scope, confidence, decision FROM parcel_legs")
def provider_parcels(spark, sf_dir):
    return _parcel_legs(spark, sf_dir).drop("property_id")


@R.query(f"""WITH {_PARCEL_SQL}, registry_legs AS ({source_queries.ORACLE_SQL["provider_correlation"].replace("WITH p AS", "WITH p AS", 1)}),
one AS (SELECT npi, entity_id, max(score) AS s1 FROM registry_legs WHERE decision IN ('ACCEPTED_EXACT', 'REVIEW_STRONG') AND scope IN ('EXACT_UNIT', 'EXACT_BUILDING', 'MAILING_ONLY') GROUP BY ALL),
two AS (SELECT npi, parcel_id, max(confidence) AS s2 FROM parcel_legs WHERE decision IN ('ACCEPTED_EXACT', 'REVIEW_STRONG') AND scope IN ('EXACT_UNIT', 'EXACT_BUILDING', 'MAILING_ONLY') GROUP BY ALL)
SELECT 'nppes-path:' || npi || ':' || entity_id || ':property:' || parcel_id AS path_id, npi, entity_id, 'property:' || parcel_id AS property_id, round(least(s1, s2), 4)::DOUBLE AS confidence, CASE WHEN round(least(s1, s2), 4) >= 0.9 THEN 'ACCEPTED_EXACT' ELSE 'REVIEW_STRONG' END AS decision FROM one JOIN two USING (npi)""")
def provider_paths(spark, sf_dir):
    """Providers that both the registry and a parcel are beside."""
    return correlation.three_source_paths(source_queries.provider_correlation(spark, sf_dir), _parcel_legs(spark, sf_dir))


@R.query(f"""WITH decided AS ({entity_queries.ORACLE_SQL["registry_decisions"]}), m AS (SELECT d.*, CASE substr(match_id, 2)::BIGINT % 4 WHEN 0 THEN TRUE WHEN 3 THEN TRUE ELSE FALSE END AS person FROM decided d)
SELECT count(*) AS candidates, count(*) FILTER (scope LIKE 'EXACT%') AS exact, count(*) FILTER (decision = 'ACCEPTED_EXACT') AS accepted, count(*) FILTER (decision = 'REVIEW_STRONG') AS strong, count(*) FILTER (decision = 'REVIEW_WEAK') AS weak, count(*) FILTER (decision = 'REJECTED') AS rejected,
  count(*) FILTER (decision = 'INSUFFICIENT_DATA') AS insufficient, count(*) FILTER (decision = 'REVIEW_WEAK' AND person AND scope IN ('INCOMPLETE', 'GENERALIZED', 'MAILING_ONLY')) AS name_only, count(*) FILTER (downgraded) AS downgraded, count(*) FILTER (person AND scope = 'GENERALIZED') AS unit_conflicts FROM m""")
def registry_quality(spark, sf_dir):
    return correlation.registry_quality(entity_queries.registry_matches(spark, sf_dir))


@R.query("""WITH t AS (SELECT DISTINCT l_suppkey AS npi, l_partkey % 7 AS ordinal, 'T' || (l_partkey % 5) AS description FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY ordinal, description) AS nth FROM t)
SELECT npi, string_agg(description, '|' ORDER BY nth) AS taxonomy FROM n WHERE nth <= 3 GROUP BY npi""")
def provider_taxonomies(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("npi"), (F.col("l_partkey") % 7).alias("ordinal"), F.concat(F.lit("T"), (F.col("l_partkey") % 5).cast("string")).alias("description"))
    return correlation.taxonomy_text(rows)


@R.query(f"""WITH {GRAPH_SQL}, ends AS (SELECT src AS entity_id, dst, kind, relationship_id FROM edges UNION ALL SELECT dst, dst, kind, relationship_id FROM edges WHERE src <> dst)
SELECT entity_id, count(DISTINCT CASE WHEN kind = 'REGISTERED_AGENT_FOR' THEN dst END) AS businesses, count(DISTINCT CASE WHEN kind IN ('REGISTERED_AGENT_AT_ADDRESS', 'REGISTERED_AGENT_ASSOCIATED_WITH_ADDRESS') THEN dst END) AS addresses,
  count(*) FILTER (kind NOT IN ('REGISTERED_AGENT_FOR', 'REGISTERED_AGENT_AT_ADDRESS', 'REGISTERED_AGENT_ASSOCIATED_WITH_ADDRESS')) AS other, count(DISTINCT CASE WHEN relationship_id <> '' THEN 'r' END) AS records,
  count(DISTINCT CASE WHEN kind = 'REGISTERED_AGENT_FOR' THEN dst END) >= 5 AS service FROM ends GROUP BY 1""")
def agent_context(spark, sf_dir):
    return correlation.agent_context(edges(spark, sf_dir).withColumnRenamed("relationship_id", "record"))

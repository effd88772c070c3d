"""Reading the driver's tables and the entity graph that is defined over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.operators.markers import Graph
from cairnlake.sources.scratch import shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The graph is made by SQL that Spark and DuckDB read alike: names of tables stand in braces.
_SOURCE = "CASE cast(floor(c_custkey / 5) AS bigint) % 3 WHEN 0 THEN 'parcels' WHEN 1 THEN 'county_clerk_local_file' ELSE 'sample' END"
_SOURCE_TYPE = "CASE cast(floor(c_custkey / 5) AS bigint) % 3 WHEN 0 THEN 'arcgis' WHEN 1 THEN 'connector' ELSE 'synthetic' END"
_HALF, _QUARTER = "cast(floor(c_custkey / 2) AS bigint)", "cast(floor(c_custkey / 4) AS bigint)"

#: Suppliers are businesses, customers owners, persons, officers and registered agents, parts properties; addresses, phones, e-mail addresses and websites go by customers' keys.
_ENTITIES = f"""
  SELECT 'b:' || s_suppkey AS entity_id, 'business' AS entity_type, s_name AS display_name, substr(md5('n' || cast(floor(s_suppkey / 2) AS bigint)), 1, 12) AS normalized_value, 'registry' AS source_name, 'api' AS source_type FROM {{supplier}}
  UNION ALL SELECT 'c:' || c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'person' WHEN 2 THEN 'officer' WHEN 3 THEN 'registered_agent' ELSE 'owner' END, c_name, substr(md5('n' || (c_custkey % 500)), 1, 12), {_SOURCE}, {_SOURCE_TYPE} FROM {{customer}}
  UNION ALL SELECT 'p:' || p_partkey, 'property', p_name, 'P' || p_partkey, 'parcels', 'arcgis' FROM {{part}}
  UNION ALL SELECT DISTINCT 'a:' || (c_custkey % 40), 'address',
    CASE c_custkey % 5 WHEN 0 THEN 'PO BOX ' || (c_custkey % 40) WHEN 1 THEN (c_custkey % 40) || ' MAIN ST APT ' || (c_custkey % 40) WHEN 2 THEN (c_custkey % 40) || ' COMMERCE PLAZA' WHEN 3 THEN (c_custkey % 40) || ' COUNTY RD' ELSE (c_custkey % 40) || ' OAK RD' END,
    'A' || (c_custkey % 40), 'registry', 'api' FROM {{customer}}
  UNION ALL SELECT DISTINCT 'ph:' || (c_custkey % 25), 'phone', '305555' || (1000 + c_custkey % 25), '305555' || (1000 + c_custkey % 25), 'sample', 'synthetic' FROM {{customer}}
  UNION ALL SELECT DISTINCT 'em:' || {_HALF}, 'email', 'x' || {_HALF} || '@example.com', 'x' || {_HALF} || '@example.com', 'registry', 'api' FROM {{customer}}
  UNION ALL SELECT DISTINCT 'we:' || {_QUARTER}, 'website', 'site' || {_QUARTER} || '.example.com', 'site' || {_QUARTER} || '.example.com', 'sample', 'synthetic' FROM {{customer}}"""

_BUSINESS = "'registry' AS source_name, 'api' AS source_type, s_suppkey AS day FROM {supplier}"
_CUSTOMER = f"{_SOURCE} AS source_name, {_SOURCE_TYPE} AS source_type, c_custkey AS day FROM {{customer}}"
_PROPERTY = "'parcels' AS source_name, 'arcgis' AS source_type, p_partkey AS day FROM {part}"
_EDGES = f"""
  SELECT 'r:' || substr(sha1(src || '|' || dst || '|' || kind), 1, 16) AS relationship_id, src, dst, kind, cast(CASE kind WHEN 'PROPERTY_OWNED_BY' THEN 0.9 ELSE 1.0 END AS double) AS confidence, source_name, source_type,
    '2024-0' || (1 + day % 9) || '-' || lpad(cast(1 + day % 28 AS string), 2, '0') AS imported_at
  FROM (
    SELECT 'b:' || s_suppkey AS src, 'a:' || (cast(floor(s_suppkey / 3) AS bigint) % 40) AS dst, 'LOCATED_AT' AS kind, {_BUSINESS}
    UNION ALL SELECT 'b:' || s_suppkey, 'a:' || (cast(floor(s_suppkey / 2) AS bigint) % 40), 'BUSINESS_MAILING_ADDRESS', {_BUSINESS}
    UNION ALL SELECT 'b:' || s_suppkey, 'ph:' || (cast(floor(s_suppkey / 2) AS bigint) % 25), 'USES_PHONE', {_BUSINESS}
    UNION ALL SELECT 'c:' || c_custkey, 'em:' || {_HALF}, 'USES_EMAIL', {_CUSTOMER}
    UNION ALL SELECT 'c:' || c_custkey, 'we:' || {_QUARTER}, 'HAS_WEBSITE', {_CUSTOMER}
    UNION ALL SELECT 'c:' || c_custkey, 'a:' || (c_custkey % 40), 'PARTY_HAS_ADDRESS', {_CUSTOMER} WHERE c_custkey % 5 <> 3
    UNION ALL SELECT 'p:' || p_partkey, 'a:' || (p_partkey % 40), 'PROPERTY_HAS_SITUS_ADDRESS', {_PROPERTY}
    UNION ALL SELECT 'p:' || p_partkey, 'a:' || (cast(floor(p_partkey / 4) AS bigint) % 40), 'PROPERTY_HAS_MAILING_ADDRESS', {_PROPERTY}
    UNION ALL SELECT 'p:' || p_partkey, 'c:' || (p_partkey % 150 + 1), 'PROPERTY_OWNED_BY', {_PROPERTY}
    UNION ALL SELECT DISTINCT 'c:' || c_custkey, 'b:' || (c_custkey % k + 1), 'OFFICER_OF', {_CUSTOMER} CROSS JOIN (SELECT 10 AS k UNION ALL SELECT 7 UNION ALL SELECT 3) ks WHERE c_custkey % 5 = 2
    UNION ALL SELECT DISTINCT 'c:' || c_custkey, 'b:' || ((c_custkey + k) % 10 + 1), 'REGISTERED_AGENT_FOR', {_CUSTOMER} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 3 UNION ALL SELECT 7) ks WHERE c_custkey % 5 = 3 AND (c_custkey % 4 < 3 OR k > 0)
    UNION ALL SELECT 'c:' || c_custkey, 'a:' || (c_custkey % 40), 'REGISTERED_AGENT_AT_ADDRESS', {_CUSTOMER} WHERE c_custkey % 5 = 3
    UNION ALL SELECT DISTINCT 'b:' || l_suppkey, 'p:' || l_partkey, 'ASSOCIATED_WITH', 'lineitem', 'connector', l_partkey FROM {{lineitem}}) made"""

_TABLES = ("supplier", "customer", "part", "lineitem")


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql})


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, entity_type, display_name, normalized_value, source_name, source_type)."""
    return shuffled(_made(spark, sf_dir, _ENTITIES))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relationship_id, src, dst, kind, confidence, source_name, source_type, imported_at)."""
    return shuffled(_made(spark, sf_dir, _EDGES))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph. Its edges are made once: ``Graph.ends`` stores them with both ends' attributes, which markers read."""
    return Graph(entities(spark, sf_dir), edges(spark, sf_dir))


#: The same views for DuckDB.
GRAPH_SQL = f"""
entities AS ({_ENTITIES}),
edges AS ({_EDGES}),
incident AS (
  SELECT src AS entity_id, dst AS other, kind, source_name FROM edges UNION ALL SELECT dst, src, kind, source_name FROM edges)""".format(**{t: t for t in _TABLES})

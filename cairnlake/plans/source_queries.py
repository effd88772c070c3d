"""Readers, connectors, provenance, sinks read back, and streams, over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import correlation, leads
from cairnlake.plans.registry import Registry
from cairnlake.sources import connectors, files, provenance, sinks
from cairnlake.sources.scratch import scratch_path
from cairnlake.sources.tables import table
from cairnlake.streaming import events as streams

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _parcels(spark, sf_dir):
    """Customers as a parcel file: written as CSV with the headers of a county, read back by the connector."""
    path = scratch_path(spark, "parcels-csv")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("Folio"), F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")).alias("Owner Name"), F.concat(F.col("c_nationkey").cast("string"), F.lit(" Situs St")).alias("SITUS ADDRESS"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("PO Box "), F.col("c_nationkey").cast("string"))).otherwise("").alias("Mailing Address"),
    )
    sinks.write_csv(rows, path)
    return connectors.PARCELS.read(spark, path)


_PARCELS_SQL = "parcels AS (SELECT c_custkey::VARCHAR AS id, c_name AS owner, c_nationkey || ' Situs St' AS situs, CASE WHEN c_custkey % 3 = 0 THEN 'PO Box ' || c_nationkey END AS mailing FROM customer)"


@R.query(f"""WITH {_PARCELS_SQL}
SELECT entity_id, entity_type, count(*)::BIGINT AS records FROM (
  SELECT DISTINCT 'property:' || upper(id) AS entity_id, 'property' AS entity_type, id FROM parcels UNION SELECT 'owner:' || upper(owner), 'owner', id FROM parcels
  UNION SELECT 'address:' || upper(situs), 'address', id FROM parcels UNION SELECT 'address:' || upper(mailing), 'address', id FROM parcels WHERE mailing IS NOT NULL) GROUP BY ALL""")
def connector_entities(spark, sf_dir):
    made = connectors.PARCELS.to_entities(_parcels(spark, sf_dir))
    return made.select("entity_id", "entity_type", F.size(F.split("source_record_id", "[|]")).cast("long").alias("records"))


@R.query(f"""WITH {_PARCELS_SQL}
SELECT DISTINCT 'property:' || upper(id) AS src, 'address:' || upper(situs) AS dst, 'PROPERTY_HAS_SITUS_ADDRESS' AS kind, 1.0::DOUBLE AS confidence FROM parcels
UNION ALL SELECT DISTINCT 'property:' || upper(id), 'address:' || upper(mailing), 'PROPERTY_HAS_MAILING_ADDRESS', 1.0 FROM parcels WHERE mailing IS NOT NULL
UNION ALL SELECT DISTINCT 'property:' || upper(id), 'owner:' || upper(owner), 'PROPERTY_OWNED_BY', 0.9 FROM parcels""")
def connector_edges(spark, sf_dir):
    return connectors.PARCELS.to_edges(_parcels(spark, sf_dir)).drop("source")


@R.query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'arcgis' WHEN 1 THEN 'api' WHEN 2 THEN 'manual' END AS source_type FROM part WHERE p_partkey % 4 < 3""")
def provenance_scope(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    hints = [{"source_name": n} for n in ("County ArcGIS layer", "Open data API", "manual list", "synthetic rows")]
    rows = [provenance.with_provenance(parts.where(F.col("p_partkey") % 4 == i), h, "p_partkey") for i, h in enumerate(hints)]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return provenance.in_scope(both, "REAL_ONLY").select("p_partkey", "source_type")


@R.query("SELECT n_nationkey::VARCHAR AS code, n_name || ', ' || n_regionkey AS label FROM nation")
def json_envelopes(spark, sf_dir):
    path = scratch_path(spark, "envelope-json")
    rows = table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")).alias("r"))
    rows.groupBy(F.col("r.region")).agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("value")).select("value").repartition(4).write.text(path)
    # One envelope a line here; files of one envelope each go through read_envelopes.
    lines = spark.read.text(path)
    found = lines.select(F.explode(F.from_json(F.get_json_object("value", "$.results"), "array<struct<id:string,name:string,region:string>>")).alias("r")).select("r.*")
    return files.project(found, {"code": "id", "label": ["name", "region"]})


@R.query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'CREATED' ELSE 'STATUS_CHANGED' END AS event, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'O' END AS old, o_orderstatus AS new
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderstatus <> 'O'""")
def analyst_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    before = orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.lit("O"))
    return leads.history(before, orders, "o_orderkey", "o_orderstatus")


#: An address and a name by a key, whose form goes by the key.
def _line(k, a, b, c, d, e):
    return f"CASE {k} % 8 WHEN 0 THEN {k} || '{a}' WHEN 3 THEN {k} || '{b}' WHEN 4 THEN 'P O Box ' || {k} WHEN 5 THEN {k} || '{c}' WHEN 7 THEN {k} || '{d}' ELSE {k} || '{e}' END"


def _named(k, firm, person, other):
    return F.expr(f"CASE WHEN {k} % 8 = 6 THEN '{other} ' || {k} || ' Inc' WHEN {k} % 2 = 0 THEN 'Clinic ' || {k} || '{firm}' ELSE 'Ann{' X' if person else ''} Lee' || {k} END")


def providers(spark, sf_dir):
    """Suppliers as providers; firms by even keys, persons by odd."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("npi"), _named("s_suppkey", " LLC", True, "Bolt").alias("name"), F.expr(_line("s_suppkey", " Main Street, Suite 5, Miami, FL", " Main Street, Suite 5, Miami", " Oak Road, Miami", " Elm Street Apartment 2, Miami", " North Main Street, Miami, FL 33101-1234")).alias("address"),
        F.lit(True).alias("active"), (F.col("s_suppkey") % 2 == 0).alias("organization"), (F.col("s_suppkey") % 8 == 2).alias("mailing"),
    )


@R.query("""
WITH p AS (SELECT s_suppkey AS npi, s_suppkey % 8 AS form, s_suppkey % 2 = 0 AS firm FROM supplier), r AS (SELECT c_custkey AS entity_id FROM customer),
d AS (SELECT npi, entity_id, form, firm, CASE form WHEN 0 THEN 'EXACT_UNIT' WHEN 1 THEN 'EXACT_BUILDING' WHEN 2 THEN 'MAILING_ONLY' WHEN 3 THEN 'GENERALIZED' WHEN 4 THEN 'PO_BOX' WHEN 5 THEN 'INCOMPLETE' WHEN 6 THEN 'EXACT_BUILDING' ELSE 'EXACT_UNIT' END AS scope, form <> 6 AS same_name FROM p JOIN r ON npi = entity_id),
s AS (SELECT *, (CASE WHEN same_name AND firm THEN 0.18 ELSE 0 END + CASE WHEN same_name AND NOT firm THEN 0.16 ELSE 0 END + CASE WHEN scope LIKE 'EXACT%' THEN 0.34 ELSE 0 END + CASE WHEN scope = 'EXACT_UNIT' THEN 0.12 ELSE 0 END
  + CASE WHEN scope IN ('EXACT_BUILDING', 'MAILING_ONLY') THEN 0.08 ELSE 0 END + CASE WHEN scope = 'MAILING_ONLY' THEN 0.04 ELSE 0 END + CASE WHEN scope LIKE 'EXACT%' AND NOT same_name THEN 0.22 ELSE 0 END + 0.12 - CASE WHEN scope = 'PO_BOX' THEN 0.28 ELSE 0 END)::DOUBLE AS score FROM d)
SELECT npi, entity_id, scope, round(score, 4)::DOUBLE AS score, CASE WHEN scope = 'PO_BOX' THEN 'REJECTED' WHEN score >= 0.72 THEN 'REVIEW_STRONG' WHEN score >= 0.45 THEN 'REVIEW_WEAK' ELSE 'REJECTED' END AS decision FROM s""")
def provider_correlation(spark, sf_dir):
    """Providers and registry rows of one key, whose names and addresses agree in eight different ways; firms by even keys, persons by odd."""
    registry = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"), _named("c_custkey", ", Inc.", False, "Nut").alias("name"), F.expr(_line("c_custkey", " MAIN ST, STE 5, MIAMI, FL", " MAIN ST, STE 6, MIAMI", " Pine Road, Miami", " ELM ST APT 2, MIAMI", " N MAIN ST, MIAMI, FL 33101")).alias("address")
    )
    return correlation.provider_matches(providers(spark, sf_dir), registry)


@R.query("SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_without_repeats(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    schema = rows.schema
    stream = streams.read_events(spark, f"{sf_dir}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.write_stream(streams.without_repeats(stream, "event_id", "ts", "60 days"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))

"""Leads in their context, and what analysts did with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import text as X
from cairnlake.operators import markers, packets
from cairnlake.operators.workflow import Workbench
from cairnlake.plans.cross_queries import _ALIAS_SQL, _aliases
from cairnlake.plans.marker_queries import _FIRED
from cairnlake.plans.registry import Registry
from cairnlake.sources.scratch import scratch_path, stored
from cairnlake.sources.tables import GRAPH_SQL, table
from cairnlake.sources.tables import graph as entity_graph

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_DAY, _LISTED = "2024-06-01", 10


def _leads(spark, sf_dir):
    """(leads, graph, markers, aliases): every business, address and owner is a lead."""
    g = entity_graph(spark, sf_dir)
    g = markers.Graph(stored(g.entities, "entities"), stored(g.edges, "edges"))
    found = g.entities.where("entity_type IN ('business', 'address', 'owner')").select(X.stable_id("lead", F.col("entity_id")).alias("lead_id"), "entity_id", F.col("display_name").alias("name"), F.lit(_DAY).alias("generated"), "source_name")
    fired = markers.run_markers(g).select("entity_id", F.concat_ws("@", "marker", "entity_id", "related").alias("marker_id"), "marker", "sources", F.concat(F.col("support").cast("string"), F.lit(" in support")).alias("explanation"))
    aliases = _aliases(spark, sf_dir).select(F.col("entity_id").alias("canonical_id"), F.col("canonical_id").alias("alias"))
    return found, g, stored(fired, "fired"), aliases


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in packets.EVENT_LABELS.items())
_CONTEXT_SQL = f"""WITH {GRAPH_SQL}, {_FIRED}, {_ALIAS_SQL},
leads AS (SELECT 'lead:' || substr(sha1(entity_id), 1, 16) AS lead_id, entity_id, display_name AS name, source_name FROM entities WHERE entity_type IN ('business', 'address', 'owner')),
tied AS (SELECT lead_id, l.entity_id, name, relationship_id, kind, other, coalesce(display_name, other) AS other_name, i.source_name, i.imported_at AS date
  FROM (SELECT src AS entity_id, dst AS other, * FROM edges UNION ALL SELECT dst, src, * FROM edges WHERE src <> dst) i JOIN leads l USING (entity_id) LEFT JOIN entities e ON e.entity_id = other),
flagged AS (SELECT lead_id, l.entity_id, name, marker, concat_ws('@', marker, l.entity_id, related) AS marker_id, sources, support || ' in support' AS explanation FROM fired f JOIN leads l ON f.entity_id = l.entity_id),
happened AS (
  SELECT lead_id, entity_id, date, CASE kind {_LABELS} ELSE kind END AS event, name AS entity, source_name AS source, name || ' linked to ' || other_name || ' via ' || kind AS evidence, relationship_id AS record_id FROM tied
  UNION ALL SELECT lead_id, entity_id, '{_DAY}', 'Fraud marker: ' || marker, name, sources, explanation, marker_id FROM flagged)"""


@R.query(f"{_CONTEXT_SQL} SELECT lead_id, entity_id, date, event, entity, source, evidence, record_id FROM happened")
def lead_timelines(spark, sf_dir):
    found, g, fired, _ = _leads(spark, sf_dir)
    return packets.timelines(found, g.edges, fired, g.entities)


@R.query(f"""{_CONTEXT_SQL},
alias_names AS (SELECT DISTINCT lead_id, canonical_id AS alias FROM aliases JOIN leads USING (entity_id)),
first_aliases AS (SELECT lead_id, count(*) AS n_aliases, array_to_string(list_sort(list(alias))[1:{_LISTED}], ' | ') AS aliases FROM alias_names GROUP BY 1),
by_marker AS (SELECT lead_id, count(*) AS n_markers, string_agg(DISTINCT marker, '|' ORDER BY marker) AS markers FROM flagged GROUP BY 1),
by_edge AS (SELECT lead_id, count(*) AS n_relationships, string_agg(DISTINCT kind, '|' ORDER BY kind) AS relationship_kinds FROM tied GROUP BY 1),
by_other AS (SELECT lead_id, count(*) AS n_connected, array_to_string(list_transform(list_sort(list((other_name, other)))[1:{_LISTED}], lambda x: x[1]), ' | ') AS connected FROM (SELECT DISTINCT lead_id, other_name, other FROM tied) GROUP BY 1),
by_event AS (SELECT lead_id, count(*) AS n_events, array_to_string(list_transform(list_sort(list((date, event, record_id)))[1:{_LISTED}], lambda x: x[1] || ': ' || x[2]), ' | ') AS timeline FROM happened GROUP BY 1),
records AS (SELECT lead_id, array_to_string(list_sort(list(r))[1:{_LISTED}], ' | ') AS record_ids FROM (SELECT lead_id, marker_id AS r FROM flagged UNION SELECT lead_id, relationship_id FROM tied) GROUP BY 1),
backed AS (SELECT lead_id, string_agg(DISTINCT s, '|' ORDER BY s) AS sources FROM (SELECT lead_id, unnest(string_split(sources, '|')) AS s FROM flagged UNION ALL SELECT lead_id, source_name FROM tied UNION ALL SELECT lead_id, source_name FROM leads) GROUP BY 1)
SELECT lead_id, entity_id, name, coalesce(n_aliases, 0)::BIGINT AS n_aliases, coalesce(n_markers, 0)::BIGINT AS n_markers, coalesce(n_relationships, 0)::BIGINT AS n_relationships, coalesce(n_connected, 0)::BIGINT AS n_connected, coalesce(n_events, 0)::BIGINT AS n_events,
  coalesce(markers, '') AS markers, coalesce(relationship_kinds, '') AS relationship_kinds, sources, coalesce(aliases, '') AS aliases, coalesce(connected, '') AS connected, coalesce(timeline, '') AS timeline, coalesce(record_ids, '') AS record_ids
FROM leads LEFT JOIN first_aliases USING (lead_id) LEFT JOIN by_marker USING (lead_id) LEFT JOIN by_edge USING (lead_id) LEFT JOIN by_other USING (lead_id) LEFT JOIN by_event USING (lead_id) LEFT JOIN records USING (lead_id) LEFT JOIN backed USING (lead_id)""")
def lead_packets(spark, sf_dir):
    """Every lead with what belongs to it: all of it counted, the first ten of a kind listed."""
    found, g, fired, aliases = _leads(spark, sf_dir)
    return packets.packets(found, g.edges, fired, aliases, g.entities, _LISTED)


@R.query("""WITH u AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'IN_REVIEW' WHEN 'F' THEN 'CLOSED' ELSE 'ESCALATED' END AS status, o_orderpriority LIKE '1-%' AS noted, o_totalprice > 450000 AS exported FROM orders),
moved AS (SELECT *, lag(status, 1, 'NEW') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM u WHERE NOT exported),
events AS (SELECT c_custkey AS k, 'CREATED' AS event_type FROM customer UNION ALL SELECT o_custkey, 'STATUS_CHANGED' FROM moved WHERE status <> was UNION ALL SELECT o_custkey, 'NOTE_ADDED' FROM moved WHERE noted UNION ALL SELECT o_custkey, 'EXPORTED' FROM u WHERE exported),
last AS (SELECT o_custkey, arg_max(status, (o_orderdate, o_orderkey)) AS status FROM moved GROUP BY 1),
known AS (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)
SELECT 'lead:' || k AS lead_id, coalesce(status, 'NEW') AS status, count(*) FILTER (event_type = 'CREATED') AS created, count(*) FILTER (event_type = 'STATUS_CHANGED') AS changed, count(*) FILTER (event_type = 'NOTE_ADDED') AS noted, count(*) FILTER (event_type = 'EXPORTED') AS exported
FROM known LEFT JOIN events USING (k) LEFT JOIN last ON o_custkey = k GROUP BY k, status""")
def analyst_workflow(spark, sf_dir):
    """Customers are leads and orders what analysts did, in two batches: state and history as the workbench keeps them."""
    bench = Workbench(spark, scratch_path(spark, "workbench"))
    lead = lambda c: F.concat(F.lit("lead:"), F.col(c).cast("string")).alias("lead_id")
    bench.create(table(spark, sf_dir, "customer").select(lead("c_custkey"), F.col("c_name").alias("title")), "1990-01-01", 0)
    orders, status = table(spark, sf_dir, "orders"), F.when(F.col("o_orderstatus") == "O", "IN_REVIEW").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("ESCALATED")
    changes = F.create_map(F.lit("status"), status, F.lit("analyst_notes"), F.when(F.col("o_orderpriority").startswith("1-"), "urgent").otherwise(""))
    updates = orders.select(lead("o_custkey"), F.col("o_orderdate").cast("date").cast("string").alias("at"), F.col("o_orderkey").cast("long").alias("seq"), F.lit(None).cast("string").alias("seen"), F.when(F.col("o_totalprice") > 450000, "EXPORT").otherwise("UPDATE").alias("action"), F.lit("r").alias("reviewer"), changes.alias("changes"))
    middle = "1995-06-17"
    bench.apply(updates.where(F.col("at") < middle), 1)
    bench.apply(updates.where(F.col("at") >= middle), 2)
    n = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    counts = bench.history().groupBy("lead_id").agg(n("CREATED", "created"), n("STATUS_CHANGED", "changed"), n("NOTE_ADDED", "noted"), n("EXPORTED", "exported"))
    return bench.state().select("lead_id", "status").join(counts, "lead_id", "left")

"""Leads in their context: markers, edges at either end, aliases and events, as timelines and as evidence packets.

An edge belongs to the leads of both its ends. It is told once to each end, and leads meet it by an equi-join, so no join
asks for one end or the other. A packet counts all that belongs to a lead and lists the first of each kind: these are
picked by a window that keeps no more than those of each task before rows are shuffled, so a lead with very many edges is
no task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.sets import sorted_tokens
from cairnlake.operators.markers import all_tokens
from cairnlake.sources.scratch import stored

#: What an edge's kind is called as an event.
EVENT_LABELS = {
    "PROPERTY_OWNED_BY": "Property ownership link", "PROPERTY_HAS_SITUS_ADDRESS": "Property situs address", "PROPERTY_HAS_MAILING_ADDRESS": "Property mailing address", "CASE_HAS_PARTY": "Court party linked",
    "CASE_HAS_DOCUMENT": "Court document linked", "BUSINESS_LINKED_TO_CASE": "Business linked to case", "LOCATED_AT": "Business location", "USES_PHONE": "Phone usage", "USES_EMAIL": "Email usage", "HAS_WEBSITE": "Website usage",
}
#: Items that a packet lists of each kind.
LISTED = 25


def incident(edges: DataFrame) -> DataFrame:
    """Each edge once for each of its ends: (entity_id, other) and the edge's columns; a loop once."""
    ends = F.array_distinct(F.array(F.struct(F.col("src").alias("entity_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("entity_id"), F.col("src").alias("other"))))
    return edges.withColumn("end", F.explode(ends)).select("end.*", *[c for c in edges.columns])


def lead_edges(leads: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(lead_id, entity_id, relationship_id, kind, other, other_name, source_name, source_type, date) of edges at each lead's entity."""
    at = incident(edges).join(leads.select("lead_id", "entity_id"), "entity_id")
    names = entities.groupBy(F.col("entity_id").alias("other")).agg(F.min("display_name").alias("other_name"))
    return at.join(names, "other", "left").select("lead_id", "entity_id", "relationship_id", "kind", "other", F.coalesce("other_name", "other").alias("other_name"), "source_name", "source_type", F.coalesce("imported_at", F.lit("")).alias("date"))


def event_label(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EVENT_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.nullif(kind, F.lit("")), F.lit("Relationship event"))


def timelines(leads: DataFrame, edges: DataFrame, markers: DataFrame, entities: DataFrame) -> DataFrame:
    """(lead_id, entity_id, date, event, entity, source, evidence, record_id) of leads (lead_id, entity_id, name, generated): edges on their days, markers on the lead's."""
    said = leads.select("lead_id", "name", "generated")
    tied = lead_edges(leads, edges, entities).join(said, "lead_id")
    evidence = F.concat(F.col("name"), F.lit(" linked to "), F.col("other_name"), F.lit(" via "), F.col("kind"))
    rows = tied.select("lead_id", "entity_id", F.coalesce(F.nullif("date", F.lit("")), "generated").alias("date"), event_label(F.col("kind")).alias("event"), F.col("name").alias("entity"), F.col("source_name").alias("source"), evidence.alias("evidence"), F.col("relationship_id").alias("record_id"))
    fired = markers.join(leads.select("lead_id", "entity_id", "name", "generated"), "entity_id")
    flagged = fired.select("lead_id", "entity_id", F.col("generated").alias("date"), F.concat(F.lit("Fraud marker: "), "marker").alias("event"), F.col("name").alias("entity"), F.col("sources").alias("source"), F.col("explanation").alias("evidence"), F.col("marker_id").alias("record_id"))
    return rows.unionByName(flagged)


def _first(rows: DataFrame, order: list[str], item: Column, name: str, most: int) -> DataFrame:
    """(lead_id, name): the first ``most`` items of each lead."""
    nth = F.row_number().over(W.partitionBy("lead_id").orderBy(*order))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= most).select("lead_id", "nth", item.alias("item"))
    return few.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "item"))), lambda x: x["item"]).alias(name))


def packets(leads: DataFrame, edges: DataFrame, markers: DataFrame, aliases: DataFrame, entities: DataFrame, listed: int = LISTED) -> DataFrame:
    """One row per lead of (lead_id, entity_id, name, generated, source_name): what belongs to it, counted, and the first ``listed`` of each kind.

    ``markers`` are (entity_id, marker_id, marker, sources, explanation), ``aliases`` (canonical_id, alias).
    """
    tied = stored(lead_edges(leads, edges, entities), "lead-edges")
    fired = stored(markers.join(leads.select("lead_id", "entity_id"), "entity_id"), "lead-markers")
    named = aliases.where("alias <> ''").select(F.col("canonical_id").alias("entity_id"), "alias").distinct().join(leads.select("lead_id", "entity_id"), "entity_id")
    connected = tied.select("lead_id", "other", "other_name").distinct()
    events = stored(timelines(leads, edges, markers, entities).select("lead_id", "date", "event", "record_id"), "lead-events")
    count = lambda rows, name: rows.groupBy("lead_id").agg(F.count(F.lit(1)).alias(name))
    parts = [
        count(named, "n_aliases"), _first(named, ["alias"], F.col("alias"), "aliases", listed),
        fired.groupBy("lead_id").agg(F.count(F.lit(1)).alias("n_markers"), sorted_tokens(F.col("marker")).alias("markers"), all_tokens(F.col("sources")).alias("marker_sources")),
        tied.groupBy("lead_id").agg(F.count(F.lit(1)).alias("n_relationships"), sorted_tokens(F.col("kind")).alias("relationship_kinds"), all_tokens(F.col("source_name")).alias("edge_sources")),
        count(connected, "n_connected"), _first(connected, ["other_name", "other"], F.col("other_name"), "connected", listed),
        count(events, "n_events"), _first(events, ["date", "event", "record_id"], F.concat_ws(": ", "date", "event"), "timeline", listed),
        _first(fired.select("lead_id", "marker_id").unionByName(tied.select("lead_id", F.col("relationship_id").alias("marker_id"))).distinct(), ["marker_id"], F.col("marker_id"), "record_ids", listed),
    ]
    out = leads.select("lead_id", "entity_id", "name", "source_name")
    for part in parts:
        out = out.join(part, "lead_id", "left")
    none = F.array().cast("array<string>")
    sources = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("marker_sources", none), F.coalesce("edge_sources", none), F.split("source_name", "[|]")), lambda s: s != "")))
    counts = ("n_aliases", "n_markers", "n_relationships", "n_connected", "n_events")
    lists = ("aliases", "connected", "timeline", "record_ids")
    out = out.na.fill(0, list(counts)).na.fill("", ["markers", "relationship_kinds"])
    return out.select("lead_id", "entity_id", "name", *counts, "markers", "relationship_kinds", F.array_join(sources, "|").alias("sources"), *[F.array_join(F.coalesce(c, none), " | ").alias(c) for c in lists])

"""Connectors: source rows to entities and edges.

A connector names its columns, and which of them are entities and which pairs of them edges; one source row emits up to
all of these, blank ones left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.sources.files import canonical_headers, read_csv, trimmed
from cairnlake.sources.provenance import with_provenance


@dataclass(frozen=True)
class Connector:
    """``entities``: column -> entity type. ``edges``: (source column, target column, kind, confidence)."""

    name: str
    source_type: str
    key: str
    aliases: Mapping[str, Sequence[str]]
    entities: Mapping[str, str]
    edges: Sequence[tuple[str, str, str, float]]
    required: Sequence[str] = field(default=())

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        rows = canonical_headers(trimmed(read_csv(spark, path)), self.aliases)
        rows = trimmed(rows, self.required or [self.key])
        return with_provenance(rows, {"source_name": self.name, "source_type": self.source_type, "connector_name": self.name}, self.key)

    def _id(self, column: str):
        value = F.upper(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")))
        return F.concat(F.lit(self.entities[column] + ":"), value)

    def to_entities(self, rows: DataFrame) -> DataFrame:
        """(entity_id, display_name, entity_type, source_name, source_type, source_record_id), one per entity."""
        made = F.array(*[F.struct(self._id(c).alias("entity_id"), F.col(c).alias("display_name"), F.lit(t).alias("entity_type")) for c, t in self.entities.items()])
        out = rows.select(F.explode(F.filter(made, lambda e: e["display_name"] != "")).alias("e"), "source_name", "source_type", "source_record_id")
        return out.groupBy("e.entity_id").agg(
            F.min_by(F.col("e.display_name"), F.col("source_record_id")).alias("display_name"),
            F.first("e.entity_type").alias("entity_type"),
            F.first("source_name").alias("source_name"),
            F.first("source_type").alias("source_type"),
            F.array_join(F.array_sort(F.collect_set("source_record_id")), "|").alias("source_record_id"),
        )

    def to_edges(self, rows: DataFrame) -> DataFrame:
        """(src, dst, kind, confidence, source), one per pair and kind."""
        made = F.array(*[F.when((F.col(a) != "") & (F.col(b) != ""), F.struct(self._id(a).alias("src"), self._id(b).alias("dst"), F.lit(k).alias("kind"), F.lit(float(c)).alias("confidence"))) for a, b, k, c in self.edges])
        return rows.select(F.explode(F.array_compact(made)).alias("e"), F.col("source_name").alias("source")).select("e.*", "source").groupBy("src", "dst", "kind", "source").agg(F.max("confidence").alias("confidence"))


REGISTRY = Connector(
    "registry", "connector", "record_id",
    {"record_id": ("corporation_number", "document_number"), "business_name": ("name", "entity_name"), "address": ("principal_address",), "mailing": ("mailing_address",), "agent": ("registered_agent", "registered_agent_name"), "officer": ("officer_name",), "phone": (), "email": ()},
    {"business_name": "business", "address": "address", "mailing": "address", "agent": "registered_agent", "officer": "officer", "phone": "phone", "email": "email"},
    [("business_name", "address", "BUSINESS_LOCATED_AT", 1.0), ("business_name", "mailing", "BUSINESS_MAILING_ADDRESS", 0.9), ("agent", "business_name", "REGISTERED_AGENT_FOR", 1.0), ("officer", "business_name", "OFFICER_OF", 1.0), ("business_name", "phone", "USES_PHONE", 1.0), ("business_name", "email", "USES_EMAIL", 1.0)],
)
PARCELS = Connector(
    "parcels", "connector", "parcel_id",
    {"parcel_id": ("folio", "parcel_number", "pin"), "owner": ("owner_name", "owner1"), "situs": ("situs_address", "property_address"), "mailing": ("mailing_address", "owner_address")},
    {"parcel_id": "property", "owner": "owner", "situs": "address", "mailing": "address"},
    [("parcel_id", "situs", "PROPERTY_HAS_SITUS_ADDRESS", 1.0), ("parcel_id", "mailing", "PROPERTY_HAS_MAILING_ADDRESS", 1.0), ("parcel_id", "owner", "PROPERTY_OWNED_BY", 0.9)],
)
COURT = Connector(
    "court", "connector", "case_number",
    {"case_number": ("case_no", "case_id"), "party": ("party_name",), "address": ("party_address",), "document": ("document_number", "instrument"), "business_name": ("business",)},
    {"case_number": "case", "party": "person", "address": "address", "document": "document", "business_name": "business"},
    [("case_number", "party", "CASE_HAS_PARTY", 1.0), ("party", "address", "PARTY_HAS_ADDRESS", 1.0), ("case_number", "document", "CASE_HAS_DOCUMENT", 1.0), ("business_name", "case_number", "BUSINESS_LINKED_TO_CASE", 1.0)],
)
MANUAL = Connector(
    "manual", "manual", "record_id",
    {"record_id": (), "business_name": ("name",), "address": (), "phone": (), "email": (), "website": ("url",)},
    {"business_name": "business", "address": "address", "phone": "phone", "email": "email", "website": "website"},
    [("business_name", "address", "LOCATED_AT", 1.0), ("business_name", "phone", "USES_PHONE", 1.0), ("business_name", "email", "USES_EMAIL", 1.0), ("business_name", "website", "HAS_WEBSITE", 1.0)],
)
CONNECTORS = {c.name: c for c in (REGISTRY, PARCELS, COURT, MANUAL)}

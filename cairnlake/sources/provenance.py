"""Provenance columns, source gating and manifests."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.sets import has_token, tokens
from cairnlake.functions.text import source_kind

PROVENANCE = ("source_name", "source_type", "source_record_id", "connector_name", "import_batch_id", "imported_at", "jurisdiction", "is_synthetic")
REAL = ("connector", "api", "arcgis", "manual")


def with_provenance(df: DataFrame, hints: Mapping[str, str], record_id: str | None = None) -> DataFrame:
    """Adds the eight provenance columns from hints and, for the type, from what the name of the source says."""
    name = F.lit(hints.get("source_name", "unknown"))
    kind = F.lit(hints["source_type"]) if hints.get("source_type") else source_kind(F.concat_ws(" ", name, F.lit(hints.get("connector_name", ""))))
    rid = F.coalesce(F.col(record_id).cast("string"), F.lit("")) if record_id else F.lit("")
    made = {"source_name": name, "source_type": kind, "source_record_id": rid, "connector_name": F.lit(hints.get("connector_name", "")), "import_batch_id": F.lit(hints.get("import_batch_id", "")), "imported_at": F.lit(hints.get("imported_at", "")), "jurisdiction": F.lit(hints.get("jurisdiction", ""))}
    out = df.withColumns(made)
    return out.withColumn("is_synthetic", F.when(has_token(F.col("source_type"), "synthetic"), "true").otherwise("false"))


def is_real(source_types: Column) -> Column:
    """Whether one of the tokens, by its standard name, is the type of a real source; blank and unknown ones are not."""
    return F.exists(tokens(source_types), lambda token: source_kind(token).isin(*REAL))


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    """REAL_ONLY, SYNTHETIC_ONLY or ALL rows by their source type tokens."""
    if scope == "REAL_ONLY":
        return df.where(has_token(F.col("source_type"), *REAL))
    if scope == "SYNTHETIC_ONLY":
        return df.where(has_token(F.col("source_type"), "synthetic") & ~has_token(F.col("source_type"), *REAL))
    return df


def ensure_local(path: str) -> str:
    """Refuses remote addresses."""
    if urlparse(str(path)).scheme in ("http", "https", "ftp", "s3", "gs"):
        raise ValueError(f"remote path refused: {path}")
    return path


def check_manifest(source: Mapping[str, object], required: tuple[str, ...] = ("source_name", "source_type", "path")) -> list[str]:
    """What is wrong with a manifest entry."""
    problems = [f"missing {k}" for k in required if not source.get(k)]
    if source.get("source_type") and source["source_type"] not in (*REAL, "synthetic"):
        problems.append(f"unknown source_type {source['source_type']}")
    return problems


def readiness(source: Mapping[str, object], path_exists: bool) -> str:
    """READY, DISABLED, INCOMPLETE or MISSING_INPUT."""
    if check_manifest(source):
        return "INCOMPLETE"
    if not source.get("enabled", True):
        return "DISABLED"
    return "READY" if path_exists else "MISSING_INPUT"

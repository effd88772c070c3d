"""Bulk files of providers: filters that reach the scan, a bound on rows in file order, the last row of a provider.

Files are CSV with the headings of the public provider file. Filters are conjuncts over its columns, which Spark hands to
the CSV scan; the bound counts the rows that match them in the order of the file; of one provider's rows the last counts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import text as X
from cairnlake.functions.parsing import address_record
from cairnlake.operators import stats
from cairnlake.sources.scratch import dealt, stored

#: Headings of the file.
NUMBER, KIND, CLOSED = "NPI", "Entity Type Code", "NPI Deactivation Date"
FIRM, FIRST, LAST = "Provider Organization Name (Legal Business Name)", "Provider First Name", "Provider Last Name (Legal Name)"
OFFICIAL = ("Authorized Official First Name", "Authorized Official Last Name")
MAILING, PRACTICE = "Provider Business Mailing Address", "Provider Practice Location Address"
PARTS = ("1", "2", "City Name", "State Name", "Postal Code")
TAXONOMY, TAXONOMY_TEXT, LICENSE_STATE = "Healthcare Provider Taxonomy Code_1", "Healthcare Provider Taxonomy Description_1", "Provider License Number State Code_1"
REQUIRED = (NUMBER, KIND, TAXONOMY, *(f"{p} {x}" for p in (MAILING, PRACTICE) for x in PARTS if x != "2"))
OPTIONAL = (FIRM, FIRST, LAST, *OFFICIAL, TAXONOMY_TEXT, LICENSE_STATE, CLOSED, *(f"{p} 2" for p in (MAILING, PRACTICE)))
FILTERS = ("state", "city", "postal_code", "postal_prefix", "taxonomy_code", "taxonomy_description", "enumeration_type", "active_only")


def _said(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def wanted(filters: Mapping[str, object]) -> list[Column]:
    """The conjuncts of the filters that are set. States, cities and postal codes may be those of either address."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    f = {k: str(v or "") for k, v in filters.items()}
    raw = lambda c: F.col(f"`{c}`")  # noqa: E731 - a null meets no filter, and bare columns let equality and prefixes reach the parser
    either = lambda part, test: test(raw(f"{MAILING} {part}")) | test(raw(f"{PRACTICE} {part}"))
    out = [raw(NUMBER).isNotNull(), F.trim(raw(NUMBER)) != ""]
    for name, part in (("state", "State Name"), ("city", "City Name")):
        if f.get(name):
            out.append(either(part, lambda c, name=name: F.upper(c) == f[name].upper()))
    for name in ("postal_code", "postal_prefix"):
        if f.get(name):
            out.append(either("Postal Code", lambda c, name=name: c.startswith(f[name])))
    if f.get("taxonomy_code"):
        out.append(F.upper(raw(TAXONOMY)) == f["taxonomy_code"].upper())
    if f.get("taxonomy_description"):
        out.append(F.upper(raw(TAXONOMY_TEXT)).contains(f["taxonomy_description"].upper()))
    if f.get("enumeration_type"):
        out.append(raw(KIND) == f["enumeration_type"].replace("NPI-", ""))
    if filters.get("active_only"):
        out.append(F.trim(_said(CLOSED)) == "")
    return out


@dataclass
class Bulk:
    """``providers`` and one row of counts."""

    providers: DataFrame
    report: DataFrame


def read_bulk(spark: SparkSession, path: str, filters: Mapping[str, object] | None = None, max_records: int | None = None) -> Bulk:
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"the file lacks {', '.join(missing)}")
    for c in OPTIONAL:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    for condition in wanted(filters or {}):
        rows = rows.where(condition)
    # Splits of a file in order, rows in order within them. Raw rows are kept: only the last of a provider is parsed.
    raw = [F.col(f"`{c}`") for c in (*REQUIRED, *OPTIONAL) if c != NUMBER]
    flat = rows.select(F.trim(_said(NUMBER)).alias("npi"), *raw, F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_row"))
    if max_records is None:
        kept = stored(flat, "bulk")
    else:
        kept = stored(stats.numbered(flat, ["_file", "_block", "_row"], "_place").where(F.col("_place") <= max_records).drop("_place"), "bulk")
    last = dealt(kept, "npi").groupBy("npi").agg(F.max_by(F.struct(*raw), F.struct("_file", "_block", "_row")).alias("r")).select("npi", "r.*")
    last = stored(_providers(last), "providers")
    n = lambda condition, name: F.count_if(condition).alias(name)
    report = last.agg(
        F.count(F.lit(1)).alias("providers"), n(F.col("kind") == "1", "persons"), n(F.col("kind") == "2", "organizations"), n(F.col("practice.text") != "", "practice_addresses"), n(F.col("mailing.text") != "", "mailing_addresses"),
        n(F.col("taxonomy_code") != "", "taxonomies"), n(~F.col("active"), "deactivated"), n(F.col("incomplete"), "incomplete"),
    )
    read = kept.agg(F.count(F.lit(1)).alias("matched"))
    report = report.join(F.broadcast(read), how="cross")  # a row each
    cut = F.lit(False) if max_records is None else F.col("matched") >= max_records
    return Bulk(last, report.withColumn("repeats", F.col("matched") - F.col("providers")).withColumn("truncated", cut))


def _providers(rows: DataFrame) -> DataFrame:
    t = lambda c: F.trim(_said(c))
    line = lambda purpose: F.concat_ws(", ", *[F.nullif(t(f"{purpose} {p}"), F.lit("")) for p in PARTS])
    firm = t(KIND) == "2"
    name = F.when(firm & (t(FIRM) != ""), t(FIRM)).otherwise(F.concat_ws(" ", F.nullif(t(FIRST), F.lit("")), F.nullif(t(LAST), F.lit(""))))
    out = rows.select(
        "npi", t(KIND).alias("kind"), F.when(t(KIND).isin("1", "2"), F.concat(F.lit("NPI-"), t(KIND))).otherwise("").alias("enumeration_type"), name.alias("name"), firm.alias("organization"),
        address_record(line(PRACTICE)).alias("practice"), address_record(line(MAILING), F.lit(True)).alias("mailing"), t(TAXONOMY).alias("taxonomy_code"), t(TAXONOMY_TEXT).alias("taxonomy"), t(LICENSE_STATE).alias("license_state"),
        F.concat_ws(" ", *[F.nullif(t(c), F.lit("")) for c in OFFICIAL]).alias("official"), (t(CLOSED) == "").alias("active"),
    )
    return out.withColumn("incomplete", ((F.col("practice.text") == "") & (F.col("mailing.text") == "")) | (F.col("taxonomy_code") == ""))


def bulk_entities(providers: DataFrame) -> DataFrame:
    """(entity_id, entity_type, display_name, normalized_value, scope, source_name, npi): providers, their addresses, taxonomies and officials."""
    p = lambda *parts: F.concat_ws(":", *parts)
    one = lambda entity_id, kind, name, value, scope: F.struct(entity_id.alias("entity_id"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("entity_type"), name.alias("display_name"), value.alias("normalized_value"), scope.alias("scope"))
    own = F.when(F.col("organization"), X.business_name(F.col("name"))).otherwise(X.person_name(F.col("name"))["full"])
    blank = F.lit("")
    address = lambda c: F.when(F.col(f"{c}.text") != "", one(p(F.lit("address:nppes"), "npi", F.lit(c), F.lit("1")), "address", F.col(f"{c}.text"), F.col(f"{c}.building"), F.col(f"{c}.scope")))
    made = F.array_compact(F.array(
        one(p(F.lit("provider:nppes"), "npi"), F.when(F.col("organization"), "organization_provider").otherwise("individual_provider"), F.coalesce(F.nullif("name", blank), "npi"), F.coalesce(own, blank), blank), address("practice"), address("mailing"),
        F.when(F.col("taxonomy_code") != "", one(p(F.lit("taxonomy:nppes"), "taxonomy_code"), "taxonomy", F.coalesce(F.nullif("taxonomy", blank), "taxonomy_code"), F.col("taxonomy_code"), blank)),
        F.when(F.col("official") != "", one(p(F.lit("authorized_official:nppes"), "npi"), "authorized_official", F.col("official"), F.coalesce(X.person_name(F.col("official"))["full"], blank), blank)),
    ))
    rows = providers.select("npi", F.explode(made).alias("e")).select("e.*", F.lit("nppes_npi").alias("source_name"), "npi")
    rest = [c for c in rows.columns if c != "entity_id"]
    return rows.groupBy("entity_id").agg(F.min_by(F.struct(*rest), F.struct("npi", "display_name")).alias("r")).select("entity_id", "r.*")


def bulk_edges(providers: DataFrame) -> DataFrame:
    """(src, dst, kind, source_name, npi) of providers to what ``bulk_entities`` gives for them."""
    p = lambda *parts: F.concat_ws(":", *parts)
    own = p(F.lit("provider:nppes"), "npi")
    edge = lambda when, src, dst, kind: F.when(when, F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")))
    made = F.array_compact(F.array(
        edge(F.col("practice.text") != "", own, p(F.lit("address:nppes"), "npi", F.lit("practice"), F.lit("1")), "PROVIDER_PRACTICES_AT"), edge(F.col("mailing.text") != "", own, p(F.lit("address:nppes"), "npi", F.lit("mailing"), F.lit("1")), "PROVIDER_MAILS_TO"),
        edge(F.col("taxonomy_code") != "", own, p(F.lit("taxonomy:nppes"), "taxonomy_code"), "PROVIDER_HAS_TAXONOMY"), edge((F.col("taxonomy_code") != "") & (F.col("license_state") != ""), own, p(F.lit("state"), "license_state"), "PROVIDER_LICENSE_REPORTED_IN_STATE"),
        edge(F.col("official") != "", own, p(F.lit("authorized_official:nppes"), "npi"), "PROVIDER_REPORTS_AUTHORIZED_OFFICIAL"),
    ))
    return providers.select("npi", F.explode(made).alias("e")).select("e.*", F.lit("nppes_npi").alias("source_name"), "npi")

"""Correlation of providers, registry entities and parcels: scopes, weighted scores, decisions, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.functions import text as X
from cairnlake.sources.scratch import dealt, shuffled, stored

#: Weights of provider evidence, summed in this order.
PROVIDER_WEIGHTS = {
    "exact_business_name": 0.18, "exact_person_name": 0.16, "exact_address": 0.34, "exact_unit": 0.12, "building_only": 0.08, "mailing_only": 0.04,
    "association_bonus": 0.22, "multiple_sources": 0.12, "common_name": -0.16, "po_box": -0.28, "missing": -0.12,
}

GENERALIZED = ("PRIVATE", "REDACTED", "UNKNOWN", "WITHHELD", "GENERAL DELIVERY")


def place(c: Column) -> Column:
    """struct(line, building, unit, house_number) of an address text, for the scopes below."""
    key = X.address_key(c)
    return F.struct(X.address_line(c).alias("line"), key["building"].alias("building"), key["unit"].alias("unit"), key["house_number"].alias("house_number"))


def address_scope(left: Column, right: Column, mailing: Column) -> Column:
    """How two places match: by their whole lines, then by building and unit."""
    a, b = left["line"], right["line"]
    either = lambda words: a.contains(words) | b.contains(words)
    units = left["unit"].isNotNull() & right["unit"].isNotNull()
    same = F.when(mailing, "MAILING_ONLY").otherwise("EXACT_BUILDING")
    return (
        F.when((a == "") | (b == ""), "INCOMPLETE")
        .when(either("PO BOX"), "PO_BOX")
        .when(either("GENERAL DELIVERY"), "GENERALIZED")
        .when((a == b) & units, "EXACT_UNIT")
        .when(a == b, same)
        .when((left["building"] != "") & (left["building"] == right["building"]), F.when(units & (left["unit"] != right["unit"]), "GENERALIZED").otherwise(same))
        .otherwise("INCOMPLETE")
    )


def registry_scope(left: Column, right: Column) -> Column:
    """How a registry's place and a parcel's match. Buildings need a number and a street to be compared."""
    hidden = lambda p: reduce(lambda x, y: x | y, [p["line"].contains(w) for w in GENERALIZED])
    whole = lambda p: p["house_number"].isNotNull() & p["building"].contains(" ")
    units = left["unit"].isNotNull() & right["unit"].isNotNull()
    building = left["building"] == right["building"]
    return (
        F.when((left["line"] == "") | (right["line"] == ""), "INCOMPLETE")
        .when(is_box(left) | is_box(right), "PO_BOX")
        .when(hidden(left) | hidden(right), "GENERALIZED")
        .when(~whole(left) | ~whole(right), "INCOMPLETE")
        .when((left["line"] == right["line"]) & units, "EXACT_UNIT")
        .when(left["line"] == right["line"], "EXACT_BUILDING")
        .when(building & units & (left["unit"] != right["unit"]), "GENERALIZED")
        .when(building, "EXACT_BUILDING")
        .otherwise("MAILING_ONLY")
    )


def is_box(p: Column) -> Column:
    return p["line"].contains("PO BOX") | p["line"].contains("P O BOX")


def registry_decision(method: Column, scope: Column, frequency: Column, box: Column, redacted: Column, incomplete: Column) -> Column:
    """struct(decision, confidence, downgraded, corroborating, conflicting) of a registry and parcel match, by the first rule that holds."""
    person, business = method == "parcel_owner_matches_person_with_secondary", method == "parcel_owner_matches_business_name"
    common = frequency >= 2
    row = lambda decision, confidence, downgraded, corroborating, conflicting: F.struct(
        (F.lit(decision) if isinstance(decision, str) else decision).alias("decision"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
        downgraded.alias("downgraded"), F.lit(corroborating).alias("corroborating"), F.lit(conflicting).alias("conflicting"),
    )
    no, either = F.lit(False), lambda a, b: F.when(common, F.lit(a)).otherwise(F.lit(b))
    return (
        F.when(redacted, row("INSUFFICIENT_DATA", 0.2, no, 0, 0))
        .when(incomplete, row("INSUFFICIENT_DATA", 0.25, no, 0, 0))
        .when(box & (method == "property_situs_matches_business_address"), row("REJECTED", 0.05, no, 0, 1))
        .when(person & (scope == "EXACT_UNIT"), row(either("REVIEW_STRONG", "ACCEPTED_EXACT"), either(0.82, 0.97), common, 2, 0))
        .when(person & (scope == "EXACT_BUILDING"), row("REVIEW_STRONG", either(0.72, 0.8), common, 2, 0))
        .when(business & scope.isin("EXACT_UNIT", "EXACT_BUILDING"), row("REVIEW_STRONG", 0.78, no, 2, 0))
        .when(person & scope.isin("MAILING_ONLY", "GENERALIZED"), row("REVIEW_WEAK", either(0.42, 0.5), common, 1, 0))
        .when(person, row("REVIEW_WEAK", either(0.3, 0.36), common, 1, 0))
        .otherwise(row("REJECTED", 0.1, no, 0, 1))
    )


REGISTRY_METHODS = ("property_situs_matches_business_address", "property_mailing_matches_business_address", "parcel_owner_matches_person_with_secondary", "parcel_owner_matches_business_name")


def registry_matches(matches: DataFrame, registry: DataFrame, parcels: DataFrame, source: str) -> DataFrame:
    """Cross-source ``matches`` of one source with parcels, decided by names and addresses.

    ``registry`` (entity_id, name, address, redacted, incomplete) and ``parcels`` (entity_id, address) describe both
    ends. A name is common if the registry has it twice.
    """
    ours = matches.where(F.col("method").isin(*REGISTRY_METHODS) & ((F.col("left_source") == source) | (F.col("right_source") == source)))
    on_left = F.col("left_source") == source
    ours = ours.dropDuplicates(["match_id"]).select("match_id", "method", F.when(on_left, F.col("left_id")).otherwise(F.col("right_id")).alias("entity_id"), F.when(on_left, F.col("right_id")).otherwise(F.col("left_id")).alias("parcel_id"))
    frequency = registry.where(F.trim("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("frequency"))
    rows = ours.join(registry, "entity_id", "left").join(frequency, "name", "left").join(parcels.select(F.col("entity_id").alias("parcel_id"), F.col("address").alias("parcel_address")), "parcel_id", "left")
    rows = rows.na.fill(0, ["frequency"]).na.fill(False, ["redacted", "incomplete"]).withColumn("l", place(F.col("address"))).withColumn("r", place(F.col("parcel_address")))
    rows = rows.withColumn("scope", registry_scope(F.col("l"), F.col("r")))
    rows = rows.withColumn("d", registry_decision(F.col("method"), F.col("scope"), F.col("frequency"), is_box(F.col("l")) | is_box(F.col("r")), F.col("redacted"), F.col("incomplete")))
    return rows.select("match_id", "method", "entity_id", "parcel_id", "scope", "frequency", "d.*")


def registry_quality(rows: DataFrame) -> DataFrame:
    """One row of counts over decided matches."""
    n = lambda condition, name: F.count_if(condition).alias(name)
    d, person = F.col("decision"), F.col("method") == "parcel_owner_matches_person_with_secondary"
    return rows.agg(
        F.count(F.lit(1)).alias("candidates"), n(F.col("scope").startswith("EXACT_"), "exact"), n(d == "ACCEPTED_EXACT", "accepted"), n(d == "REVIEW_STRONG", "strong"), n(d == "REVIEW_WEAK", "weak"), n(d == "REJECTED", "rejected"),
        n(d == "INSUFFICIENT_DATA", "insufficient"), n((d == "REVIEW_WEAK") & person & F.col("scope").isin("INCOMPLETE", "GENERALIZED", "MAILING_ONLY"), "name_only"), n(F.col("downgraded"), "downgraded"), n(person & (F.col("scope") == "GENERALIZED"), "unit_conflicts"),
    )


def with_cross_source(matches: DataFrame, decided: DataFrame) -> DataFrame:
    """Cross-source matches with what the registry ladder decided on them."""
    return matches.join(decided.select("match_id", F.col("decision").alias("registry_decision"), F.col("confidence").alias("registry_confidence"), F.col("scope").alias("registry_scope")), "match_id", "left")


def provider_decision(score: Column, scope: Column, active: Column) -> Column:
    """The band of a score; a mailbox is rejected and a provider that is not active is not accepted."""
    band = scores.banded(score, scores.MATCH_BANDS, "REJECTED")
    return F.when(scope == "PO_BOX", "REJECTED").when(~active & (band == "ACCEPTED_EXACT"), "REVIEW_STRONG").otherwise(band)


def provider_matches(providers: DataFrame, registry: DataFrame) -> DataFrame:
    """(npi, entity_id, scope, score, decision) of providers (npi, name, address, active[, organization, mailing]) and registry rows (entity_id, name, address).

    Candidates share the normalised name or the address line or building; all are equi-joins. Persons' names are
    compared as persons'. A name is common if two providers have it.
    """
    has = lambda c, otherwise: F.coalesce(c, F.lit(otherwise)) if c in providers.columns else F.lit(otherwise)
    left = providers.select("npi", F.col("name").alias("l_said"), F.col("address").alias("l_address"), F.coalesce("active", F.lit(True)).alias("active"), has("organization", True).alias("firm"), has("mailing", False).alias("mailing"))
    as_firm, as_person = lambda c: F.nullif(X.business_name(F.col(c)), F.lit("")), lambda c: F.nullif(X.person_name(F.col(c))["full"], F.lit(""))
    # Names and addresses are parsed once, in many tasks; what follows reads the parsed rows.
    left = dealt(left, "npi").withColumns({"l": place(F.col("l_address")), "l_name": F.when(F.col("firm"), as_firm("l_said")).otherwise(as_person("l_said"))})
    right = dealt(registry.select("entity_id", F.col("name").alias("r_said"), "address"), "entity_id").select("entity_id", "r_said", place(F.col("address")).alias("r")).withColumns({"r_firm": as_firm("r_said"), "r_person": as_person("r_said")})
    left, right = stored(left, "providers"), stored(right, "registry")
    places = lambda p: [F.concat(F.lit("l:"), F.nullif(F.col(f"{p}.line"), F.lit(""))), F.concat(F.lit("b:"), F.nullif(F.col(f"{p}.building"), F.lit("")))]
    l_keys = F.array(*places("l"), F.concat(F.when(F.col("firm"), "f:").otherwise("p:"), F.col("l_name")))
    r_keys = F.array(*places("r"), F.concat(F.lit("f:"), F.col("r_firm")), F.concat(F.lit("p:"), F.col("r_person")))
    keyed = lambda df, key, keys: df.select(key, F.explode(F.array_distinct(F.array_compact(keys))).alias("k"))
    ids = keyed(left, "npi", l_keys).join(shuffled(keyed(right, "entity_id", r_keys)), "k").select("npi", "entity_id").distinct()
    common = providers.groupBy(F.col("name").alias("l_said")).agg((F.count(F.lit(1)) > 1).alias("common"))
    pairs = ids.join(shuffled(left), "npi").join(shuffled(right), "entity_id").join(shuffled(common), "l_said", "left")
    pairs = pairs.withColumn("scope", address_scope(F.col("l"), F.col("r"), F.col("mailing")))
    pairs = pairs.withColumn("same_name", F.coalesce(F.col("l_name") == F.when(F.col("firm"), F.col("r_firm")).otherwise(F.col("r_person")), F.lit(False)))
    exact = F.col("scope").isin("EXACT_UNIT", "EXACT_BUILDING") & ~F.col("mailing")
    missing = (F.trim(F.coalesce("l_said", F.lit(""))) == "") | (F.trim(F.coalesce("l_address", F.lit(""))) == "")
    flags = {
        "exact_business_name": F.col("same_name") & F.col("firm"), "exact_person_name": F.col("same_name") & ~F.col("firm"), "exact_address": exact, "exact_unit": F.col("scope") == "EXACT_UNIT",
        "building_only": F.col("scope").isin("EXACT_BUILDING", "MAILING_ONLY"), "mailing_only": F.col("scope") == "MAILING_ONLY", "association_bonus": exact & ~F.col("same_name"),
        "multiple_sources": F.lit(True), "common_name": F.coalesce("common", F.lit(False)), "po_box": F.col("scope") == "PO_BOX", "missing": missing,
    }
    score = scores.weighted_flags(flags, PROVIDER_WEIGHTS)
    decision = F.when(missing & (F.col("scope") != "PO_BOX"), "INSUFFICIENT_DATA").otherwise(provider_decision(F.col("exact_score"), F.col("scope"), F.col("active")))
    out = pairs.withColumn("exact_score", score).withColumn("decision", decision)
    return out.where(~((F.col("decision") == "REJECTED") & (F.col("scope") == "INCOMPLETE") & ~F.col("same_name"))).select("npi", "entity_id", "scope", F.round("exact_score", 4).alias("score"), "decision")


#: Weights of parcel evidence by an owner's name and by an address, summed in these orders; kinds of edges; what a match is called.
OWNER_WEIGHTS = {"exact_person_name": 0.16, "exact_business_name": 0.18, "multiple_sources": 0.12, "common_name": -0.16, "missing": -0.12}
PLACE_WEIGHTS = {"exact_address": 0.34, "exact_unit": 0.12, "building_only": 0.08, "mailing_only": 0.04, "association_bonus": 0.22, "multiple_sources": 0.12, "po_box": -0.28, "missing": -0.12}
SITUS, PARCEL_MAILING, OWNED = "PROPERTY_HAS_SITUS_ADDRESS", "PROPERTY_HAS_MAILING_ADDRESS", "PROPERTY_OWNED_BY"
ACCEPTED, PLACED = ("ACCEPTED_EXACT", "REVIEW_STRONG"), ("EXACT_UNIT", "EXACT_BUILDING", "MAILING_ONLY")


def registry_match_type(organization: Column, mailing: Column, entity_type: Column) -> Column:
    """What a provider's match with a registry entity is called."""
    return (
        F.when((entity_type == "address") & ~mailing, "NPI_PRACTICE_ADDRESS_TO_SUNBIZ_PRINCIPAL_ADDRESS")
        .when(entity_type == "address", "NPI_MAILING_ADDRESS_TO_SUNBIZ_MAILING_ADDRESS")
        .when(organization & (entity_type == "business"), "NPI_ORGANIZATION_TO_SUNBIZ_BUSINESS")
        .when(~organization & (entity_type == "officer"), "NPI_PROVIDER_NAME_TO_SUNBIZ_OFFICER")
        .when(~organization & (entity_type == "registered_agent"), "NPI_AUTHORIZED_OFFICIAL_TO_SUNBIZ_OFFICER")
        .otherwise("NPI_ORGANIZATION_ADDRESS_TO_REGISTERED_AGENT_ADDRESS")
    )


def parcel_matches(providers: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(npi, parcel_id, property_id, match_id, match_type, scope, confidence, decision) of providers (npi, name, address[, organization]) and parcels.

    ``entities`` (entity_id, entity_type, display_name) and ``edges`` (relationship_id, src, dst, kind) are the parcels'.
    Two hops, both equi-joins: from a parcel's address that is the provider's, or an owner of its name, to the edges there.
    An owner's edge counts for the name alone; an address's for how the two addresses match.
    """
    firm = F.coalesce("organization", F.lit(True)) if "organization" in providers.columns else F.lit(True)
    known_name = F.nullif(F.when(firm, X.business_name(F.col("name"))).otherwise(X.person_name(F.col("name"))["full"]), F.lit(""))
    ours = providers.select("npi", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("address", F.lit("")).alias("address"), firm.alias("firm"), known_name.alias("own_name"))
    common = providers.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg((F.count(F.lit(1)) > 1).alias("common"))
    ours = ours.join(shuffled(common), "name")
    line, person = X.address_line(F.col("display_name")), X.person_name(F.col("display_name"))["full"]
    known = entities.where(F.col("entity_type").isin("address", "owner")).select("entity_id", F.concat_ws(":", "entity_type", F.nullif(F.when(F.col("entity_type") == "address", line).otherwise(person), F.lit(""))).alias("key")).where("key LIKE '%:%'")
    keys = F.array_compact(F.array(F.concat(F.lit("address:"), F.nullif(X.address_line(F.col("address")), F.lit(""))), F.concat(F.lit("owner:"), F.col("own_name"))))
    ends = ours.withColumn("key", F.explode(keys)).join(shuffled(known), "key").drop("key")
    at = F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id")
    incident = edges.where(F.col("kind").isin(SITUS, PARCEL_MAILING, OWNED)).select(at, "relationship_id", "src", "dst", "kind")
    met = ends.join(shuffled(incident), "entity_id").drop("entity_id").distinct()
    named = entities.select(F.col("entity_id").alias("dst"), F.col("display_name").alias("said"))
    rows = met.join(shuffled(named), "dst", "left").withColumn("said", F.coalesce("said", F.when(F.col("kind") == OWNED, F.col("dst")).otherwise("")))
    blank_name, blank_place = F.col("name") == "", (F.col("address") == "") | (F.col("said") == "")
    owned = rows.where(F.col("kind") == OWNED).where(F.col("own_name") == X.person_name(F.col("said"))["full"])
    by_name = scores.weighted_flags({"exact_person_name": ~F.col("firm"), "exact_business_name": F.col("firm"), "multiple_sources": F.lit(True), "common_name": F.col("common"), "missing": blank_name}, OWNER_WEIGHTS)
    owned = owned.withColumns({"scope": F.lit("INCOMPLETE"), "score": by_name, "lacking": blank_name, "match_type": F.when(F.col("firm"), "ORGANIZATION_NAME_TO_PARCEL_OWNER").otherwise("PROVIDER_NAME_TO_PARCEL_OWNER")})
    situs = F.col("kind") == SITUS
    placed = rows.where(F.col("kind") != OWNED).withColumn("scope", address_scope(place(F.col("address")), place(F.col("said")), ~situs))
    exact = F.col("scope").isin("EXACT_UNIT", "EXACT_BUILDING") & situs
    is_scope = lambda name: F.col("scope") == name
    flags = {"exact_address": exact, "exact_unit": is_scope("EXACT_UNIT"), "building_only": is_scope("EXACT_BUILDING"), "mailing_only": is_scope("MAILING_ONLY"), "association_bonus": exact, "multiple_sources": F.lit(True), "po_box": is_scope("PO_BOX"), "missing": blank_place}
    placed = placed.withColumns({"score": scores.weighted_flags(flags, PLACE_WEIGHTS), "lacking": blank_place, "match_type": F.when(situs, "PROVIDER_PRACTICE_ADDRESS_TO_PARCEL_SITUS").otherwise("PROVIDER_MAILING_ADDRESS_TO_PARCEL_MAILING")})
    decided = F.when(F.col("lacking"), "INSUFFICIENT_DATA").otherwise(scores.banded(F.col("score"), scores.MATCH_BANDS, "REJECTED"))
    out = owned.unionByName(placed).withColumn("decision", decided).where(~((F.col("kind") != OWNED) & (F.col("decision") == "REJECTED") & is_scope("INCOMPLETE")))
    out = out.withColumn("parcel_id", F.regexp_replace("src", "property:", ""))
    match_id = F.concat_ws(":", F.lit("nppes-parcel"), F.col("npi").cast("string"), "parcel_id", "match_type")
    return out.select("npi", "parcel_id", F.col("src").alias("property_id"), match_id.alias("match_id"), "match_type", "scope", F.round("score", 4).alias("confidence"), "decision").distinct()


def three_source_paths(registry: DataFrame, parcels: DataFrame) -> DataFrame:
    """(path_id, npi, entity_id, property_id, confidence, decision) of both legs (npi, id, scope, score or confidence, decision): each has to be placed and accepted."""
    sure = lambda rows, c: rows.where(F.col("decision").isin(*ACCEPTED) & F.col("scope").isin(*PLACED)).withColumnRenamed(c, "sure")
    left = sure(registry, "score").groupBy("npi", "entity_id").agg(F.max("sure").alias("s1"))
    right = sure(parcels, "confidence").groupBy("npi", "property_id").agg(F.max("sure").alias("s2"))
    confidence = F.round(F.least("s1", "s2"), 4)
    path_id = F.concat_ws(":", F.lit("nppes-path"), F.col("npi").cast("string"), F.col("entity_id").cast("string"), "property_id")
    return left.join(shuffled(right), "npi").select(path_id.alias("path_id"), "npi", "entity_id", "property_id", confidence.alias("confidence"), F.when(confidence >= 0.9, "ACCEPTED_EXACT").otherwise("REVIEW_STRONG").alias("decision"))


def taxonomy_text(taxonomies: DataFrame, most: int = 3) -> DataFrame:
    """(npi, taxonomy): the first descriptions of each provider of (npi, ordinal, description), joined."""
    first = taxonomies.groupBy("npi").agg(F.array_sort(F.collect_set(F.struct("ordinal", "description"))).alias("all"))
    return first.select("npi", F.array_join(F.transform(F.slice("all", 1, most), lambda x: x["description"]), "|").alias("taxonomy"))


def agent_context(edges: DataFrame) -> DataFrame:
    """Per end of an edge of (src, dst, kind, record): agencies, agents' addresses, other edges, and record prefixes; five agencies make a likely service."""
    ends = edges.select(F.col("src").alias("entity_id"), "dst", "kind", "record").unionByName(edges.where("src <> dst").select(F.col("dst").alias("entity_id"), "dst", "kind", "record"))
    agency, place = F.col("kind") == "REGISTERED_AGENT_FOR", F.col("kind").isin("REGISTERED_AGENT_AT_ADDRESS", "REGISTERED_AGENT_ASSOCIATED_WITH_ADDRESS")
    out = ends.groupBy("entity_id").agg(
        F.countDistinct(F.when(agency, F.col("dst"))).alias("businesses"), F.countDistinct(F.when(place, F.col("dst"))).alias("addresses"), F.count_if(~agency & ~place).alias("other"),
        F.countDistinct(F.nullif(F.substring_index("record", ":", 1), F.lit(""))).alias("records"),
    )
    return out.withColumn("service", F.col("businesses") >= 5)

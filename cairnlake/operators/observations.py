"""Statistical rarity of markers: what is observed for each entity, how its peers do, and what that adds to a marker's weight.

An observation is a count for (marker, entity). Peers are the observations of one comparison group: the marker, the type
of entity, the scope, the address context and a hint. Peers' statistics come from the counts of each distinct value, so
no group is gathered row by row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.functions import text as X
from cairnlake.functions.sets import has_token, token_count, tokens
from cairnlake.operators import stats
from cairnlake.operators.markers import PEOPLE_AND_FIRMS
from cairnlake.sources.provenance import in_scope
from cairnlake.sources.scratch import stored

#: What address contexts add to address markers, to shared identifiers and to owners' and parties' markers.
ADDRESS_ADJUSTMENTS = {
    "SINGLE_FAMILY_RESIDENTIAL": 8, "MULTIFAMILY_RESIDENTIAL": 3, "APARTMENT_BUILDING": -3, "EXACT_APARTMENT_OR_UNIT": 6, "COMMERCIAL_PROPERTY": -6, "OFFICE_BUILDING": -5,
    "VIRTUAL_OFFICE_OR_MAILBOX": -4, "GOVERNMENT_FACILITY": -6, "REGISTERED_AGENT_SERVICE_ADDRESS": -5, "UNKNOWN": 0,
}
COMMUNICATION_ADJUSTMENTS = {"UNKNOWN": 0, "COMMERCIAL_PROPERTY": -2, "EXACT_APARTMENT_OR_UNIT": 3, "VIRTUAL_OFFICE_OR_MAILBOX": -2}
PROPERTY_ADJUSTMENTS = {"UNKNOWN": 0, "SINGLE_FAMILY_RESIDENTIAL": 4, "COMMERCIAL_PROPERTY": -3}
BASE_WEIGHTS = {
    "shared_address_businesses": 18, "shared_phone": 14, "shared_email": 12, "shared_website": 10, "arcgis_owner_in_business_records": 20, "county_clerk_party_in_business_records": 20,
    "cross_source_multi_source_cluster": 24,
}
OTHER_WEIGHT = 12
ADDRESS_MARKERS = ("shared_address_businesses", "mailbox_address_cluster", "mailing_address_reuse")
IDENTIFIERS = {"USES_PHONE": "shared_phone", "USES_EMAIL": "shared_email", "HAS_WEBSITE": "shared_website"}
COUNTED_PLACES = ("LOCATED_AT", "PROPERTY_HAS_MAILING_ADDRESS", "PROPERTY_HAS_SITUS_ADDRESS")
LEAST_PEERS = 5

COLUMNS = ("marker", "entity_id", "entity_type", "source_name", "scope", "address_context", "observed", "hint")


def observations(entities: DataFrame, edges: DataFrame, matches: DataFrame | None = None, scope: str = "REAL_ONLY") -> DataFrame:
    """(marker, entity_id, entity_type, source_name, scope, address_context, observed, hint) of all kinds, from rows in scope."""
    rows = in_scope(edges, scope).select("src", "dst", "kind", "source_name")
    who = entities.select("entity_id", "entity_type", "display_name", F.col("source_name").alias("own"))
    side = lambda c: who.select(F.col("entity_id").alias(c), F.col("entity_type").alias(f"{c}_type"))
    ends = stored(rows.join(side("src"), "src", "left").join(side("dst"), "dst", "left").na.fill("", ["src_type", "dst_type"]), "counted-ends")
    made = lambda df, marker, observed, hint, context="UNKNOWN": df.select(
        F.lit(marker).alias("marker"), "entity_id", "entity_type", F.col("own").alias("source_name"), F.lit(scope).alias("scope"), (F.col(context) if context != "UNKNOWN" else F.lit(context)).alias("address_context"),
        observed.cast("double").alias("observed"), hint.alias("hint"),
    )

    at = ends.where((F.col("dst_type") == "address") & F.col("kind").isin(*COUNTED_PLACES))
    firm, mailing = F.col("src_type") == "business", F.col("kind") == "PROPERTY_HAS_MAILING_ADDRESS"
    per = at.select("dst", "src", "src_type", "kind").distinct().groupBy("dst").agg(
        F.countDistinct(F.when(firm, F.col("src"))).alias("businesses"), F.countDistinct(F.when(mailing, F.col("src"))).alias("mailings"), F.countDistinct("src").alias("all"), F.collect_set("src_type").alias("types")
    )
    places = per.join(who.withColumnRenamed("entity_id", "dst"), "dst")
    among = F.array_contains("types", "address") & F.array_contains("types", "property")
    places = stored(places.withColumn("context", X.address_context(F.col("display_name"), among_properties=among)["context"]), "places")
    shared = at.where(firm).select("dst", F.col("src").alias("entity_id")).distinct().join(places.select("dst", "businesses", "context"), "dst").join(who, "entity_id")
    of_places = places.withColumnRenamed("dst", "entity_id")
    parts = [
        made(shared, "shared_address_businesses", F.col("businesses"), F.col("context"), "context"),
        made(of_places.where("mailings > 0"), "mailing_address_reuse", F.col("mailings"), F.col("context"), "context"),
        made(of_places.where("context = 'VIRTUAL_OFFICE_OR_MAILBOX'"), "mailbox_address_cluster", F.col("all"), F.col("context"), "context"),
    ]
    used = ends.where(F.col("kind").isin(*IDENTIFIERS)).select("kind", "dst", F.col("src").alias("entity_id")).distinct()
    used = used.join(used.groupBy("kind", "dst").agg(F.count(F.lit(1)).alias("n")), ["kind", "dst"]).join(who, "entity_id", "left").na.fill("", ["entity_type", "own"])
    parts += [made(used.where(F.col("kind") == kind), name, F.col("n"), F.col("entity_type")) for kind, name in IDENTIFIERS.items()]
    out = ends.select(F.col("src").alias("entity_id"), F.col("dst_type").alias("type"), "source_name")
    both = out.unionByName(ends.select(F.col("dst").alias("entity_id"), F.col("src_type").alias("type"), "source_name"))
    around = both.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"), F.collect_set("type").alias("types"), F.collect_set("source_name").alias("sources")).join(who, "entity_id")
    reach = F.size(F.array_distinct(F.flatten(F.transform("sources", tokens)))) + F.size(F.filter("types", lambda t: t != ""))
    parts += [made(around, "dense_entity_cluster", F.col("degree"), F.col("entity_type")), made(around, "bridge_entity", reach, F.col("entity_type"))]

    named = in_scope(entities, scope).where(F.col("entity_type").isin(*PEOPLE_AND_FIRMS) & (F.coalesce("normalized_value", F.lit("")) != "")).withColumn("own", F.col("source_name"))
    mapped, clerk = F.lower("source_type").contains("arcgis"), F.lower("source_name").contains("county_clerk")
    twins = lambda ours, others: named.where(ours).join(named.where(others).groupBy("normalized_value").agg(F.count(F.lit(1)).alias("n")), "normalized_value")
    parts.append(made(twins((F.col("entity_type") == "owner") & mapped, ~mapped), "arcgis_owner_in_business_records", F.col("n"), F.lit("owner_cross_source")))
    parts.append(made(twins(clerk, F.col("entity_type").isin("business", "officer", "registered_agent", "person") & ~clerk), "county_clerk_party_in_business_records", F.col("n"), F.lit("clerk_cross_source")))
    if matches is not None:
        counted = matches.where("decision = 'AUTO_MATCH'" + (" AND contains_real" if scope == "REAL_ONLY" else ""))
        sources = F.array_join(F.array_sort(F.array_distinct(F.concat(F.collect_set("left_source"), F.collect_set("right_source")))), "|")
        per = counted.groupBy(F.col("canonical_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"), F.min("entity_type").alias("entity_type"), sources.alias("own"))
        parts.append(made(per, "cross_source_multi_source_cluster", F.col("n"), F.col("entity_type")))
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)


def comparison_group() -> Column:
    """The peers of an observation; jurisdictions are not told apart."""
    return F.concat_ws("|", "marker", "entity_type", "scope", F.coalesce(F.nullif("address_context", F.lit("")), F.lit("UNKNOWN")), F.lit("ALL"), F.coalesce(F.nullif("hint", F.lit("")), F.lit("ALL")))


def _by(values: Mapping[str, int], key: Column, otherwise: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(otherwise))


def rarity(observed: DataFrame, least_peers: int = LEAST_PEERS) -> DataFrame:
    """Observations with their peers' size and mean, percentile, tail probability, robust z, rarity, level, base weight, adjustment and adjusted weight."""
    rows = stored(observed.withColumn("group", comparison_group()), "observed")
    counts = stored(stats.value_counts(rows, ["group"], "observed"), "observed-counts")
    judged = stats.counted_view(counts, ["group"])
    few = F.col("peers") < least_peers
    probability = F.when(~few, scores.poisson_at_least(F.col("v"), F.col("mean")))
    judged = judged.select("group", F.col("v").alias("observed"), "peers", F.round("mean", 4).alias("expected"), "percentile", probability.alias("probability"), F.when(~few, F.round("robust_z", 4)).alias("robust_z"), F.when(~few, F.round("iqr_score", 4)).alias("iqr_score"))
    score = F.when(F.col("peers") < least_peers, 0.0).otherwise(F.round(scores.rarity(F.col("probability"), F.col("percentile"), F.col("robust_z")), 2))
    judged = judged.withColumn("rarity", score)
    level = F.when(F.col("peers") < least_peers, "INSUFFICIENT_BASELINE").otherwise(scores.review_level(F.col("probability"), F.col("percentile"), F.col("rarity")))
    models = F.array_compact(F.array(F.when(F.col("probability").isNotNull(), "poisson_tail"), F.lit("empirical_percentile"), F.when(F.col("robust_z").isNotNull(), "robust_z"), F.when(F.col("iqr_score").isNotNull(), "iqr")))
    judged = judged.withColumns({"level": level, "model": F.array_join(models, " + ")})
    out = rows.join(judged, ["group", "observed"])
    context = F.col("address_context")
    identifiers = _by(COMMUNICATION_ADJUSTMENTS, context)
    routine = (F.col("observed") >= 5) & (token_count(F.col("source_name")) <= 1)
    adjustment = (
        F.when(F.col("marker").isin(*ADDRESS_MARKERS), _by(ADDRESS_ADJUSTMENTS, context))
        .when(F.col("marker").isin(*IDENTIFIERS.values()), F.when(routine, F.least(identifiers, F.lit(-2))).otherwise(identifiers))
        .when(F.col("marker").isin("arcgis_owner_in_business_records", "county_clerk_party_in_business_records"), _by(PROPERTY_ADJUSTMENTS, context))
        .otherwise(0)
    )
    more = F.when(F.col("level").isin("ELEVATED_REVIEW", "IMMEDIATE_REVIEW", "EXTREME_OUTLIER"), 2).otherwise(0)
    base = _by(BASE_WEIGHTS, F.col("marker"), OTHER_WEIGHT)
    out = out.withColumns({"base": base.cast("long"), "adjustment": (F.least(F.greatest(adjustment, F.lit(-8)), F.lit(8)) + more).cast("long")})
    return out.withColumn("adjusted", F.greatest(F.lit(1), F.col("base") + F.col("adjustment")).cast("long"))


def marker_statistics(rare: DataFrame) -> DataFrame:
    """One row for each (entity_id, marker): that of the rarest observation, which is then the same whatever the order."""
    best = F.max_by(F.struct("observed", "expected", "group", "peers", "probability", "rarity", "level", "adjustment", "adjusted"), F.struct("rarity", "observed", "group"))
    return rare.groupBy("entity_id", "marker").agg(best.alias("r")).select("entity_id", "marker", "r.*")


def baselines(observed: DataFrame) -> DataFrame:
    """(group, peers, mean, median, p90, largest, smallest, status) of each comparison group."""
    return stats.baselines(observed.withColumn("group", comparison_group()), ["group"], "observed", LEAST_PEERS)


def calibration(rare: DataFrame) -> DataFrame:
    """One row: how many weights went up, down and stayed, groups too small to judge by, and levels counted."""
    a = F.col("adjustment")
    n = lambda level: F.count_if(F.col("level") == level).alias(level.lower())
    return rare.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(a > 0).alias("elevated"), F.count_if(a < 0).alias("reduced"), F.count_if(a == 0).alias("unchanged"),
        *[n(x) for x in ("INSUFFICIENT_BASELINE", "COMMON", "ROUTINE_REVIEW", "ELEVATED_REVIEW", "IMMEDIATE_REVIEW", "EXTREME_OUTLIER")],
    )


def largest_adjustments(rare: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest adjustments, with the direction they go."""
    some = lambda order, way: rare.orderBy(order, "marker", "entity_id", "group").limit(n).select(F.lit(way).alias("direction"), "marker", "entity_id", "adjustment")
    return some(F.desc("adjustment"), "positive").unionByName(some(F.asc("adjustment"), "negative"))

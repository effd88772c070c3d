"""Lead candidates of entities, of networks and of matches across sources, and what they score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.functions import text as X
from cairnlake.functions.sets import tokens
from cairnlake.operators.leads import lead_type
from cairnlake.operators.markers import all_tokens
from cairnlake.sources.provenance import is_real
from cairnlake.sources.scratch import stored

#: Fixed values.
LEAST_REAL = 2
UNKNOWN_RESOLUTION = 0.9
CONFIDENCE_BANDS = ((0.9, "VERY_HIGH"), (0.75, "HIGH"), (0.55, "MEDIUM"), (0.35, "LOW"))
#: Columns of a candidate and what stands where a kind of candidate has nothing to say.
BLANKS = {
    "lead_type": "", "primary_id": "", "primary_type": "", "network_id": "", "risk_score": 0.0, "markers": 0, "sources": 0, "relationships": 0, "matches": 0, "members": 0, "bridges": 0, "events": 0, "aliases": 0,
    "resolution_confidence": 0.0, "marker_confidence": 0.0, "relationship_confidence": 1.0, "density": 0.0, "temporal": 0.0, "rarity": 0.0, "rarity_level": "", "source_names": "", "contains_real": False, "contains_synthetic": False, "review": "", "explanation": "",
}


def _candidates(rows: DataFrame, **said: Column) -> DataFrame:
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    columns = {name: F.coalesce(said.get(name, F.lit(blank)).cast(kinds[type(blank)]), F.lit(blank)).alias(name) for name, blank in BLANKS.items()}
    out = rows.select(*columns.values())
    return out.select(X.stable_id("lead", F.col("lead_type"), F.col("primary_id"), F.col("network_id")).alias("lead_id"), *BLANKS)


def _kinds(source_types: Column) -> dict[str, Column]:
    """Whether there are real sources, and synthetic ones."""
    found = tokens(source_types)
    return {"contains_real": is_real(source_types), "contains_synthetic": F.array_contains(found, "synthetic")}


def marker_lookup(records: DataFrame) -> DataFrame:
    """(entity_id, rarity, rarity_level, rare): the largest rarity, the most urgent level and how many markers are rare."""
    order = ("INSUFFICIENT_BASELINE", "COMMON", "ROUTINE_REVIEW", "ELEVATED_REVIEW", "IMMEDIATE_REVIEW", "EXTREME_OUTLIER")
    rank = F.greatest(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("rarity_level")), F.lit(0))
    return records.groupBy("entity_id").agg(F.round(F.max("rarity"), 2).alias("rarity"), F.max_by("rarity_level", rank).alias("rarity_level"), F.count_if(rank > 2).alias("rare"))


def entity_candidates(risk: DataFrame, members: DataFrame | None = None, networks: DataFrame | None = None, statistics: DataFrame | None = None, least_markers: int = 1) -> DataFrame:
    """A candidate of each entity with enough markers.

    ``members`` (entity_id, network_id, and bridge where it is known) and ``networks`` (network_id, members) add the network;
    ``statistics`` is what ``marker_lookup`` gives.
    """
    out = risk.where(F.col("markers") >= least_markers)
    said = {}
    if members is not None:
        bridge = F.col("bridge") == "Yes" if "bridge" in members.columns else F.lit(False)
        out = out.join(members.select("entity_id", "network_id", bridge.alias("is_bridge")), "entity_id", "left")
        said |= {"network_id": F.col("network_id"), "bridges": F.col("is_bridge")}
    if networks is not None:
        out = out.join(networks.select("network_id", F.col("members").alias("network_members")), "network_id", "left")
        said["members"] = F.col("network_members")
    if statistics is not None:
        out = out.join(statistics.select("entity_id", "rarity", "rarity_level"), "entity_id", "left")
        said |= {"rarity": F.col("rarity"), "rarity_level": F.col("rarity_level")}
    if "events" in risk.columns:
        said["events"] = F.col("events")
    known = lambda c: F.col(c) if c in risk.columns else F.lit(0)
    kind = lead_type(F.col("entity_type"), known("matches"), known("events"))
    return _candidates(
        out, **said, **_kinds(F.col("source_type")), lead_type=kind, primary_id=F.col("entity_id"), primary_type=F.col("entity_type"), risk_score=F.col("risk_score"), markers=F.col("markers"), sources=F.col("sources"), relationships=F.col("degree"),
        resolution_confidence=F.lit(1.0), marker_confidence=F.col("mean_confidence"), density=F.least(F.col("degree"), F.lit(1)), source_names=F.col("source_names"), explanation=F.col("rules"),
    )


def network_candidates(networks: DataFrame) -> DataFrame:
    """A candidate of each network's profile."""
    return _candidates(
        networks, **_kinds(F.col("source_types")), lead_type=F.lit("NETWORK"), primary_id=F.col("network_id"), primary_type=F.lit("network"), network_id=F.col("network_id"), risk_score=F.col("risk_score"), markers=F.col("markers"), sources=F.col("sources"), relationships=F.col("relationships"),
        matches=F.col("cross_source_matches"), members=F.col("members"), bridges=F.col("bridges"), events=F.col("events"), resolution_confidence=F.col("resolution_confidence"), marker_confidence=F.col("confidence_score"), density=F.col("density"), temporal=F.least(F.col("growth"), F.lit(1.0)),
        source_names=F.col("source_names"), explanation=F.col("explanation"),
    )


def said(matches: DataFrame) -> DataFrame:
    """Matches that count and have two real sources: of pairs that say the same of an entity, one row with their number."""
    kept = matches.where((F.col("decision") == "AUTO_MATCH") & (F.col("real_sources") >= LEAST_REAL))
    says = ["canonical_id", "entity_type", "sources", "contains_synthetic", "confidence", "evidence"]
    return kept.withColumn("sources", F.concat_ws("|", "left_source", "right_source")).groupBy(*says).agg(F.count(F.lit(1)).alias("n"))


def cross_source_candidates(matches: DataFrame, risk: DataFrame | None = None, least_matches: int = 1) -> DataFrame:
    """``said_candidates`` of pairs."""
    return said_candidates(said(matches), risk, least_matches)


def said_candidates(rows: DataFrame, risk: DataFrame | None = None, least_matches: int = 1) -> DataFrame:
    """A candidate of each canonical entity with enough matches, of which ``rows`` has what ``said`` gives.

    Its explanation is the first three different evidences by their order. Where ``risk`` knows the entity, its risk,
    markers, relationships and confidence count.
    """
    few = stored(rows, "said")
    # Evidences may be many: only the first three of each entity are kept, before they meet in one row.
    per = few.groupBy("canonical_id").agg(
        F.min("entity_type").alias("entity_type"), F.sum("n").alias("n"), F.sum(F.col("confidence") * F.col("n")).alias("sure"), all_tokens(F.col("sources")).alias("names"), F.bool_or("contains_synthetic").alias("synthetic"),
    ).where(F.col("n") >= least_matches)
    first = few.where("evidence <> ''").groupBy("canonical_id", "evidence").agg(F.lit(1).alias("one"))
    ranked = first.withColumn("nth", F.expr("row_number() OVER (PARTITION BY canonical_id ORDER BY evidence)")).where("nth <= 3")
    texts = ranked.groupBy("canonical_id").agg(F.array_join(F.array_sort(F.collect_list("evidence")), " | ").alias("evidence"))
    out = per.join(texts, "canonical_id", "left").withColumn("source_names", F.array_join("names", "|"))
    said = {"relationships": F.col("n"), "resolution_confidence": F.lit(UNKNOWN_RESOLUTION)}
    if risk is not None:
        known = risk.select(F.col("entity_id").alias("canonical_id"), F.col("risk_score").alias("its_risk"), F.col("markers").alias("its_markers"), F.col("degree").alias("its_degree"), F.col("mean_confidence").alias("its_confidence"))
        out = out.join(known, "canonical_id", "left")
        said = {"risk_score": F.col("its_risk"), "markers": F.col("its_markers"), "relationships": F.coalesce("its_degree", "n"), "resolution_confidence": F.coalesce("its_confidence", F.lit(UNKNOWN_RESOLUTION))}
    mean = F.col("sure") / F.col("n")
    return _candidates(
        out, **said, lead_type=F.lit("CROSS_SOURCE_CLUSTER"), primary_id=F.col("canonical_id"), primary_type=F.col("entity_type"), sources=F.size("names"), matches=F.col("n"), marker_confidence=mean, relationship_confidence=mean, source_names=F.col("source_names"),
        contains_real=F.lit(True), contains_synthetic=F.col("synthetic"), explanation=F.col("evidence"), review=F.concat(F.lit("Compare what independent sources say, and why they are independent: "), "source_names"),
    )


def _to(x: Column, digits: int) -> Column:
    """Rounded as decimals are, without what doubles add far behind."""
    return F.round(F.round(x, 8), digits)


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates with their evidence's completeness and what it lacks, confidence, priority and the bands of both."""
    checks = {
        "primary_entity": F.col("primary_id") != "", "marker_evidence": F.col("markers") > 0, "relationship_evidence": F.col("relationships") > 0, "source_provenance": F.col("source_names") != "", "timeline_events": F.col("events") > 0, "aliases": F.col("aliases") > 0,
        "canonical_resolution": F.col("resolution_confidence") > 0, "network_context": (F.col("network_id") != "") | (F.col("members") > 0), "recommended_review": F.col("review") != "",
    }
    out = candidates.withColumns({"completeness": _to(scores.completeness([(c, 1) for c in checks.values()]), 2), "missing": F.array_join(F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()])), "|")})
    part = lambda c, most: F.least(F.col(c).cast("double"), F.lit(float(most)))
    records = F.least(F.col("markers") + F.col("relationships"), F.lit(10)).cast("double")
    sure = [part("sources", 5) / 5 * 0.2, F.col("resolution_confidence") * 0.2, records / 10 * 0.15, F.col("relationship_confidence") * 0.15, F.col("marker_confidence") * 0.15, F.col("completeness") / 100 * 0.1, F.when(F.col("contains_real"), 1.0).otherwise(0.45) * 0.05]
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    out = out.withColumn("confidence_score", _to(F.least(total(sure), F.lit(1.0)), 4))
    terms = [
        F.col("risk_score") * 0.25, part("rarity", 100) * 0.08, F.col("confidence_score") * 100 * 0.15, part("markers", 10) * 10 * 0.08, part("sources", 5) * 20 * 0.08, part("matches", 5) * 20 * 0.08, part("density", 1) * 100 * 0.07, part("members", 25) * 4 * 0.07,
        F.when(F.col("bridges") > 0, 100.0).otherwise(0.0) * 0.06, part("resolution_confidence", 1) * 100 * 0.06, F.col("completeness") * 0.05, part("temporal", 1) * 100 * 0.03, F.when(F.col("contains_real"), 100.0).otherwise(0.0) * 0.02,
    ]
    out = out.withColumn("priority_score", _to(F.least(total(terms), F.lit(100.0)), 2))
    return out.withColumns({"confidence": scores.banded(F.col("confidence_score"), CONFIDENCE_BANDS, "UNKNOWN"), "priority": scores.banded(F.col("priority_score"), scores.PRIORITY_BANDS, "INFORMATIONAL")})

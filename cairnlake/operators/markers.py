"""Marker rules over entity and edge tables, the gate they pass, their union, summaries and entity risk.

A rule is a function of a ``Graph`` that gives (entity_id, support, score, sources, related): whom it flags, how much
supports that, how sure it is, the sources of what supports it and what ties it together. New rules register themselves
by name; ``CONFIG`` has the weight and the gate of each.

Edges meet both ends' attributes once (``Graph.ends``) and each entity's surroundings are counted once
(``Graph.profile``); rules read these stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.functions.sets import has_token, tokens
from cairnlake.functions.text import is_mailbox
from cairnlake.operators.similarity import alike
from cairnlake.sources.scratch import stored


@dataclass(frozen=True)
class Graph:
    """entities (entity_id, entity_type, display_name, normalized_value, source_name, source_type); edges (src, dst, kind, source_name, ...)."""

    entities: DataFrame
    edges: DataFrame

    @cached_property
    def ends(self) -> DataFrame:
        """Edges with both ends' types and sources; blank where an end is not among the entities."""
        side = lambda c, *more: self.entities.select(F.col("entity_id").alias(c), F.col("entity_type").alias(f"{c}_type"), F.col("source_name").alias(f"{c}_source"), *more)
        out = self.edges.select("src", "dst", "kind", "source_name").join(side("src"), "src", "left").join(side("dst", is_mailbox(F.col("display_name")).alias("dst_mailbox")), "dst", "left")
        return stored(out.na.fill("", ["src_type", "src_source", "dst_type", "dst_source"]).na.fill(False, ["dst_mailbox"]), "ends")

    def incident(self) -> DataFrame:
        """(entity_id, other, kind, source_name): each edge from both ends, as two rows, which later joins meet by key."""
        out = self.edges.select(F.col("src").alias("entity_id"), F.col("dst").alias("other"), "kind", "source_name")
        return out.unionByName(self.edges.select(F.col("dst").alias("entity_id"), F.col("src").alias("other"), "kind", "source_name"))

    @cached_property
    def profile(self) -> DataFrame:
        """(entity_id, degree, types, kinds, sources, outgoing): what each entity is tied to.

        Types, kinds and sources are few, so an entity has few combinations of them however many edges it has: those
        are counted first, and the sets are made of them.
        """
        out = self.ends.select(F.col("src").alias("entity_id"), F.col("dst_type").alias("type"), "kind", "source_name", F.lit(1).alias("out"))
        both = out.unionByName(self.ends.select(F.col("dst").alias("entity_id"), F.col("src_type").alias("type"), "kind", "source_name", F.lit(0).alias("out")))
        few = both.groupBy("entity_id", "type", "kind", "source_name").agg(F.count(F.lit(1)).alias("n"), F.max("out").alias("out"))
        sets = {"types": "type", "kinds": "kind", "sources": "source_name"}
        return stored(few.groupBy("entity_id").agg(F.sum("n").alias("degree"), *[F.collect_set(c).alias(name) for name, c in sets.items()], F.max("out").alias("outgoing")), "profile")


def related_edges(edges: DataFrame, entity_id: str, direction: str = "out", kind: str | None = None) -> DataFrame:
    """The edges out of (or, for ``in``, into) an entity, of one kind if it is given."""
    found = edges.where(F.col("src" if direction == "out" else "dst") == entity_id)
    return found if kind is None else found.where(F.col("kind") == kind)


@dataclass(frozen=True)
class Rule:
    """What a marker weighs and the least confidence, support and number of sources it needs."""

    category: str
    weight: int
    least_confidence: float
    least_support: int
    least_sources: int = 1
    enabled: bool = True


#: Fixed values.
CONFIG = {
    "shared_address_businesses": Rule("address", 18, 0.65, 2),
    "mailbox_address_cluster": Rule("address", 16, 0.6, 2),
    "mailing_address_reuse": Rule("address", 14, 0.6, 2),
    "business_mailing_address_cluster": Rule("address", 17, 0.65, 2),
    "shared_phone": Rule("communication", 14, 0.65, 2),
    "shared_email": Rule("communication", 12, 0.65, 2),
    "shared_website": Rule("communication", 10, 0.65, 2),
    "similar_business_names": Rule("business", 11, 0.55, 2),
    "arcgis_owner_in_business_records": Rule("cross_source", 20, 0.7, 1, 2),
    "county_clerk_party_in_business_records": Rule("cross_source", 18, 0.7, 1, 2),
    "officer_controls_many_businesses": Rule("control", 18, 0.7, 3),
    "registered_agent_dense_network": Rule("network", 18, 0.7, 3),
    "dense_entity_cluster": Rule("network", 12, 0.55, 4),
    "bridge_entity": Rule("network", 15, 0.6, 3, 2),
    "business_cluster_compound": Rule("compound", 24, 0.75, 2),
}
CROSS_SOURCE_WEIGHTS = {
    "cross_source_multi_source_address": 18, "cross_source_shared_identifier": 16, "cross_source_property_business_address": 20, "cross_source_owner_business": 20,
    "cross_source_owner_person": 22, "cross_source_clerk_business": 20, "cross_source_multi_source_cluster": 24,
}
CROSS_SOURCE_MARKERS = {
    "exact_canonical_address": "cross_source_multi_source_address", "exact_canonical_phone": "cross_source_shared_identifier", "exact_canonical_email": "cross_source_shared_identifier",
    "exact_canonical_website": "cross_source_shared_identifier", "property_situs_matches_business_address": "cross_source_property_business_address",
    "property_mailing_matches_business_address": "cross_source_property_business_address", "parcel_owner_matches_business_name": "cross_source_owner_business",
    "parcel_owner_matches_person_with_secondary": "cross_source_owner_person", "clerk_party_matches_business_person_with_secondary": "cross_source_clerk_business",
}
PLACES = ("LOCATED_AT", "BUSINESS_LOCATED_AT", "BUSINESS_PRINCIPAL_ADDRESS")
AGENT_PLACES = ("REGISTERED_AGENT_AT_ADDRESS", "REGISTERED_AGENT_ASSOCIATED_WITH_ADDRESS")
PEOPLE_AND_FIRMS = ("business", "owner", "officer", "person", "registered_agent")
COMPONENTS = ("shared_address_businesses", "shared_phone", "shared_email", "shared_website", "similar_business_names")
CLERK = "county_clerk_local_file"

MARKERS: dict[str, Callable[[Graph], DataFrame]] = {}


def marker(name: str) -> Callable:
    def register(rule: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        MARKERS[name] = rule
        return rule

    return register


def with_config(changes: Mapping[str, Mapping[str, object]] | None = None) -> dict[str, Rule]:
    """The rules with some of their values changed, by marker and field."""
    return {name: Rule(**{**vars(rule), **(changes or {}).get(name, {})}) for name, rule in CONFIG.items()}


def all_tokens(sources: Column) -> Column:
    """Aggregate: the distinct tokens of a source column, sorted. Sources are few, so this stays small in any group."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(sources), tokens))))


@dataclass(frozen=True)
class Shared:
    """A rule over what several entities share: which edges count, the score by their number, and whether it flags them or what they share."""

    edges: Callable[[], Column]
    base: float
    step: float
    cap: float
    flags_target: bool = False


def _kind(*kinds: str, src: str = "", dst: str = "") -> Callable[[], Column]:
    ends = [(c, t) for c, t in (("src_type", src), ("dst_type", dst)) if t]
    return lambda: reduce(lambda a, b: a & b, [F.col(c) == t for c, t in ends], F.col("kind").isin(*kinds))


SHARED = {
    "shared_address_businesses": Shared(_kind(*PLACES, src="business", dst="address"), 0.55, 0.08, 0.95),
    "mailbox_address_cluster": Shared(lambda: (F.col("kind").contains("ADDRESS") | (F.col("kind") == "LOCATED_AT")) & (F.col("dst_type") == "address") & F.col("dst_mailbox"), 0.6, 0.05, 0.92, True),
    "mailing_address_reuse": Shared(_kind("PROPERTY_HAS_MAILING_ADDRESS"), 0.58, 0.06, 0.88, True),
    "business_mailing_address_cluster": Shared(_kind("BUSINESS_MAILING_ADDRESS", src="business", dst="address"), 0.62, 0.06, 0.94),
    "shared_phone": Shared(_kind("USES_PHONE", dst="phone"), 0.6, 0.07, 0.93),
    "shared_email": Shared(_kind("USES_EMAIL", dst="email"), 0.6, 0.07, 0.93),
    "shared_website": Shared(_kind("HAS_WEBSITE", dst="website"), 0.6, 0.07, 0.93),
}


def shared_by_several(graph: Graph, names: Sequence[str]) -> DataFrame:
    """The rows of several rules of ``SHARED`` at once: (marker, entity_id, support, score, sources, related).

    Counts are aggregated and joined back, so a target that most edges share isn't collected.
    """
    tags = F.array_compact(F.array(*[F.when(SHARED[n].edges(), F.lit(n)) for n in names]))
    pairs = graph.ends.select(F.explode(tags).alias("marker"), "dst", "src", "src_source").distinct()
    groups = pairs.groupBy("marker", "dst").agg(F.count(F.lit(1)).alias("support"), all_tokens(F.col("src_source")).alias("sources"), F.min("src").alias("first")).where("support >= 2")
    by_target = [n for n in names if SHARED[n].flags_target]
    members = pairs.where(~F.col("marker").isin(by_target)).select("marker", "dst", F.col("src").alias("entity_id")).join(groups.drop("first"), ["marker", "dst"]).withColumnRenamed("dst", "related")
    targets = groups.where(F.col("marker").isin(by_target)).withColumnsRenamed({"dst": "entity_id", "first": "related"})
    score = reduce(lambda out, n: F.when(F.col("marker") == n, scores.capped(SHARED[n].base, SHARED[n].step, F.col("support"), SHARED[n].cap)).otherwise(out), names, F.lit(None).cast("double"))
    return members.unionByName(targets).select("marker", "entity_id", "support", score.alias("score"), "sources", "related")


for _name in SHARED:
    MARKERS[_name] = lambda graph, name=_name: shared_by_several(graph, [name]).drop("marker")


@marker("similar_business_names")
def similar_names(graph: Graph, least: float = 0.86) -> DataFrame:
    """Businesses at one address whose names are alike: each is the left end of a cluster with those after it that are.

    An entity may be in several clusters, and has a row for each.
    """
    at = graph.ends.where(F.col("kind").isin(*PLACES) & (F.col("src_type") == "business") & (F.col("dst_type") == "address")).select("dst", F.col("src").alias("entity_id")).distinct()
    names = graph.entities.select("entity_id", F.coalesce(F.nullif("normalized_value", F.lit("")), "display_name").alias("name"), "source_name")
    pairs = alike(at.join(names, "entity_id"), "dst", "entity_id", "name", least).select("dst", "left_id", "right_id")
    lefts = pairs.select("dst", "left_id").distinct().select("dst", "left_id", F.col("left_id").alias("entity_id"))
    members = stored(pairs.select("dst", "left_id", F.col("right_id").alias("entity_id")).unionByName(lefts), "alike")
    clusters = members.join(names.select("entity_id", "source_name"), "entity_id").groupBy("dst", "left_id").agg(F.count(F.lit(1)).alias("support"), all_tokens(F.col("source_name")).alias("sources"))
    return members.join(clusters, ["dst", "left_id"]).select("entity_id", "support", F.lit(0.62).alias("score"), "sources", F.col("dst").alias("related"))


def _elsewhere(ours: DataFrame, others: DataFrame, base: float, cap: float) -> DataFrame:
    """Entities whose normalised name others have too. Others are counted by name, so no pair is made."""
    named = others.where(F.trim("normalized_value") != "").groupBy("normalized_value").agg(F.count(F.lit(1)).alias("support"), all_tokens(F.col("source_name")).alias("theirs"), F.min("entity_id").alias("related"))
    rows = ours.join(named, "normalized_value")
    return rows.select("entity_id", "support", scores.capped(base, 0.05, F.col("support"), cap).alias("score"), F.array_sort(F.array_union(tokens(F.col("source_name")), "theirs")).alias("sources"), "related")


@marker("arcgis_owner_in_business_records")
def owners_in_business_records(graph: Graph) -> DataFrame:
    mapped = has_token(F.col("source_type"), "arcgis")
    return _elsewhere(graph.entities.where((F.col("entity_type") == "owner") & mapped), graph.entities.where(F.col("entity_type").isin(*PEOPLE_AND_FIRMS) & ~mapped), 0.72, 0.96)


@marker("county_clerk_party_in_business_records")
def clerk_parties_in_business_records(graph: Graph) -> DataFrame:
    clerk = has_token(F.col("source_name"), CLERK)
    return _elsewhere(graph.entities.where(F.col("entity_type").isin("person", "business", "owner") & clerk), graph.entities.where(F.col("entity_type").isin(*PEOPLE_AND_FIRMS) & ~clerk), 0.7, 0.94)


def _own_source(rows: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    return rows.join(entities.where(F.col("entity_type") == kind).select("entity_id", F.col("source_name").alias("own")), "entity_id")


@marker("officer_controls_many_businesses")
def controls_many(graph: Graph) -> DataFrame:
    held = graph.ends.where("kind = 'OFFICER_OF' AND trim(dst) <> ''").select(F.col("src").alias("entity_id"), "dst", "dst_source").distinct()
    rows = held.groupBy("entity_id").agg(F.count(F.lit(1)).alias("support"), all_tokens(F.col("dst_source")).alias("theirs"), F.min("dst").alias("related"))
    rows = _own_source(rows, graph.entities, "officer")
    return rows.select("entity_id", "support", scores.capped(0.68, 0.04, F.col("support"), 0.96).alias("score"), F.array_sort(F.array_union(tokens(F.col("own")), "theirs")).alias("sources"), "related")


@marker("registered_agent_dense_network")
def agent_density(graph: Graph) -> DataFrame:
    """Agents for several businesses that something else ties too: other links, or more than one link to an address."""
    outgoing = graph.ends.join(graph.entities.where("entity_type = 'registered_agent'").select(F.col("entity_id").alias("src")), "src", "left_semi")
    firms = outgoing.where("kind = 'REGISTERED_AGENT_FOR'").select(F.col("src").alias("entity_id"), "dst", "dst_source").distinct()
    firms = firms.groupBy("entity_id").agg(F.count(F.lit(1)).alias("support"), all_tokens(F.col("dst_source")).alias("theirs"), F.min("dst").alias("related"))
    place = F.col("kind").isin(*AGENT_PLACES)
    links = outgoing.groupBy(F.col("src").alias("entity_id")).agg(F.count_if(place).alias("places"), F.count_if(~place & (F.col("kind") != "REGISTERED_AGENT_FOR")).alias("other"))
    rows = _own_source(firms.join(links, "entity_id").where("other > 0 OR places > 1"), graph.entities, "registered_agent")
    score = F.least(0.66 + 0.05 * F.col("support") + 0.02 * F.col("places"), F.lit(0.97))
    return rows.select("entity_id", "support", score.alias("score"), F.array_sort(F.array_union(tokens(F.col("own")), "theirs")).alias("sources"), "related")


@marker("dense_entity_cluster")
def dense_cluster(graph: Graph) -> DataFrame:
    """Entities with many edges, one outgoing at least, to entities of two types or more."""
    rows = graph.profile.where((F.col("degree") >= 4) & (F.size("types") >= 2) & (F.col("outgoing") == 1))
    rows = rows.join(graph.entities.select("entity_id", F.col("source_name").alias("own")), "entity_id", "left")
    return rows.select("entity_id", F.col("degree").alias("support"), scores.capped(0.5, 0.03, F.col("degree"), 0.9).alias("score"), tokens(F.col("own")).alias("sources"), F.array_join(F.array_sort("types"), "|").alias("related"))


@marker("bridge_entity")
def bridge(graph: Graph) -> DataFrame:
    """Entities that tie several types by several kinds of edges from several sources."""
    rows = graph.profile.join(graph.entities.select("entity_id"), "entity_id", "left_semi")
    rows = rows.withColumn("sources", F.array_sort(F.array_distinct(F.flatten(F.transform("sources", tokens)))))
    rows = rows.where((F.col("degree") >= 3) & (F.size("sources") >= 2) & (F.size("types") >= 2) & (F.size("kinds") >= 2))
    score = F.least(0.58 + 0.04 * F.size("types") + 0.03 * F.size("sources"), F.lit(0.91))
    return rows.select("entity_id", F.col("degree").alias("support"), score.alias("score"), "sources", F.array_join(F.array_sort("types"), "|").alias("related"))


def compound(fired: DataFrame) -> DataFrame:
    """Entities that two or more of the component markers flag."""
    rows = fired.where(F.col("marker").isin(*COMPONENTS)).groupBy("entity_id").agg(F.collect_set("marker").alias("names"), all_tokens(F.col("sources")).alias("sources"))
    rows = rows.withColumn("support", F.size("names").cast("long"))
    return rows.select(F.lit("business_cluster_compound").alias("marker"), "entity_id", "support", scores.capped(0.72, 0.06, F.col("support"), 0.97).alias("score"), "sources", F.array_join(F.array_sort("names"), "|").alias("related"))


RECORD = ("entity_id", "marker", "category", "support", "confidence", "confidence_label", "risk", "raw_risk", "adjustment", "rarity", "rarity_level", "sources", "source_count", "related")


def gate(rows: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Rows (marker, entity_id, support, score, sources, related) that have the support, sources and confidence their markers need, as records without statistics."""
    of = lambda field: F.element_at(F.create_map(*[F.lit(x) for n, r in rules.items() for x in (n, getattr(r, field))]), F.col("marker"))
    kept = rows.where((F.col("support") >= of("least_support")) & (F.size("sources") >= of("least_sources")) & (F.col("score") >= of("least_confidence").cast("double")))
    return kept.select(
        "entity_id", "marker", of("category").alias("category"), F.col("support").cast("long").alias("support"), F.round("score", 4).alias("confidence"), scores.banded(F.col("score"), scores.CONFIDENCE_BANDS, "Unknown").alias("confidence_label"),
        of("weight").cast("long").alias("raw_risk"), F.array_join("sources", "|").alias("sources"), F.size("sources").cast("long").alias("source_count"), "related",
    )


def with_statistics(records: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Records with the adjusted weight, the rarity and the level of (entity_id, marker, adjusted, adjustment, rarity, level)."""
    if statistics is None:
        blank = {"adjusted": F.col("raw_risk"), "adjustment": F.lit(0), "rarity": F.lit(0.0), "level": F.lit("")}
        out = records.withColumns(blank)
    else:
        out = records.join(statistics.select("entity_id", "marker", "adjusted", "adjustment", "rarity", "level"), ["entity_id", "marker"], "left")
        out = out.withColumn("adjusted", F.coalesce("adjusted", "raw_risk")).na.fill({"adjustment": 0, "rarity": 0.0, "level": ""})
    out = out.withColumns({"risk": F.col("adjusted").cast("long"), "adjustment": F.col("adjustment").cast("long"), "rarity_level": F.col("level")})
    return out.select(*RECORD)


def _rows(graph: Graph, name: str) -> DataFrame:
    return MARKERS[name](graph).select(F.lit(name).alias("marker"), "entity_id", "support", "score", "sources", "related")


def fire(graph: Graph, name: str, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """One marker's records."""
    return with_statistics(gate(_rows(graph, name), rules or CONFIG))


def run_markers(graph: Graph, rules: Mapping[str, Rule] | None = None, statistics: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """All enabled markers' records, the compound one over them, and those of cross-source ``matches``.

    Rules over what is shared are one pass over the edges. The rows are stored once: the compound marker, summaries and
    risk read them without firing the rules again.
    """
    rules = rules or CONFIG
    names = [n for n, r in rules.items() if r.enabled and n in MARKERS]
    parts = [_rows(graph, n) for n in names if n not in SHARED]
    if shared := [n for n in names if n in SHARED]:
        parts.append(shared_by_several(graph, shared))
    some = stored(gate(reduce(DataFrame.unionByName, parts), rules), "markers")
    last = "business_cluster_compound"
    every = some.unionByName(gate(compound(some), rules)) if rules[last].enabled else some
    every = with_statistics(every, statistics)
    return every if matches is None else every.unionByName(cross_source_records(matches, statistics))


def cross_source_records(matches: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """A record for each match that counts and has two real sources; these pass no gate."""
    kept = matches.where("decision = 'AUTO_MATCH' AND real_sources >= 2")
    by_method = F.create_map(*[F.lit(x) for pair in CROSS_SOURCE_MARKERS.items() for x in pair])
    by_marker = F.create_map(*[F.lit(x) for pair in CROSS_SOURCE_WEIGHTS.items() for x in pair])
    named = kept.withColumn("marker", F.coalesce(F.try_element_at(by_method, F.col("method")), F.lit("cross_source_multi_source_cluster")))
    sources = F.array_distinct(F.concat(tokens(F.col("left_source")), tokens(F.col("right_source"))))
    rows = named.select(
        F.col("canonical_id").alias("entity_id"), "marker", F.lit("cross_source").alias("category"), F.col("real_sources").cast("long").alias("support"), F.round("confidence", 4).alias("confidence"), scores.banded(F.col("confidence"), scores.CONFIDENCE_BANDS, "Unknown").alias("confidence_label"),
        F.try_element_at(by_marker, F.col("marker")).cast("long").alias("raw_risk"), F.array_join(sources, "|").alias("sources"), F.size(sources).cast("long").alias("source_count"), F.col("match_id").alias("related"),
    )
    return with_statistics(rows, statistics)


def marker_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("marker", "category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities"), F.round(F.avg("risk"), 4).alias("mean_risk"), F.round(F.avg("support"), 4).alias("mean_support"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(F.avg("rarity"), 4).alias("mean_rarity")
    )


def anomaly_view(rows: DataFrame) -> DataFrame:
    """Records under the names of the older report: score, level, rule, entities and the addresses and phones among them."""
    ids = F.array_distinct(F.filter(F.array("entity_id", "related"), lambda x: x != ""))
    of = lambda prefix: F.array_join(F.filter(ids, lambda x: x.startswith(prefix)), "|")
    return rows.select(
        F.col("risk").alias("risk_score"), scores.banded(F.col("risk"), scores.RISK_BANDS, "None").alias("risk_level"), F.col("marker").alias("rule"), F.array_join(ids, "|").alias("entity_ids"),
        of("a:").alias("addresses"), of("ph:").alias("phones"), F.col("category").alias("source_table"), F.col("sources").alias("source_name"),
    )


def entity_risk(graph: Graph, rows: DataFrame) -> DataFrame:
    """Per entity: its markers' risk, up to 20 for edges, 5 for three sources, up to 10 for confidence; at most 100, with a band."""
    said = F.when(F.col("confidence_label") == "Very High", 1.0).when(F.col("confidence_label") == "High", 0.85).when(F.col("confidence_label") == "Medium", 0.65).when(F.col("confidence_label") == "Low", 0.45).otherwise(0.25)
    by_marker = rows.withColumn("said", said).groupBy("entity_id").agg(
        F.sum("risk").alias("marker_risk"), F.count(F.lit(1)).alias("markers"), F.round(F.avg("said"), 6).alias("mean_confidence"), all_tokens(F.col("sources")).alias("theirs"),
        F.array_join(F.array_sort(F.collect_set("marker")), "|").alias("rules"), F.max(F.struct("risk", "confidence", "marker"))["marker"].alias("top_marker"),
    )
    by_edge = graph.profile.select("entity_id", "degree")
    out = graph.entities.join(by_marker, "entity_id", "left").join(by_edge, "entity_id", "left").na.fill(0, ["marker_risk", "markers", "degree"]).na.fill(0.0, ["mean_confidence"]).na.fill("", ["rules", "top_marker"])
    out = out.withColumn("all_sources", F.array_sort(F.array_union(tokens(F.col("source_name")), F.coalesce("theirs", F.array().cast("array<string>")))))
    mean = F.col("mean_confidence")
    bonus = F.when(mean >= 0.9, 10).when(mean >= 0.75, 6).when(mean >= 0.55, 3).otherwise(0)
    score = F.least(F.col("marker_risk") + F.least(F.col("degree") * 2, F.lit(20)) + F.when(F.size("all_sources") >= 3, 5).otherwise(0) + bonus, F.lit(100)).cast("long")
    return out.withColumn("risk_score", score).select(
        "entity_id", "entity_type", "display_name", F.array_join("all_sources", "|").alias("source_names"), "source_type", "markers", "degree", F.size("all_sources").cast("long").alias("sources"), "risk_score",
        scores.banded(F.col("risk_score"), scores.RISK_BANDS, "None").alias("risk_level"), scores.banded(mean, scores.CONFIDENCE_BANDS, "Unknown").alias("confidence"), F.round(mean, 4).alias("mean_confidence"), "rules", "top_marker",
    )

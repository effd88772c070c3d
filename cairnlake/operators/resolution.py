"""Entity resolution: block keys, candidate pairs, pair decisions, canonical rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cairnlake.functions import text as X
from cairnlake.functions.sets import merge_tokens, sorted_tokens
from cairnlake.operators.graph import connected_components
from cairnlake.sources.scratch import stored

MAXIMUM_BLOCK = 200
#: Entity types whose equal names need shared evidence to merge, and those of persons.
NEED_EVIDENCE = ("person", "registered_agent", "officer", "business", "owner")
PERSONS = ("person", "owner", "registered_agent", "officer")
#: Name ratios from which shared evidence makes a pair one for review (persons, others), and from which names are alike.
PERSON_RATIO, OTHER_RATIO, ALIKE_RATIO = 0.92, 0.9, 0.75


#: Kinds of values that count as secondary evidence, in the order in which they are named.
EVIDENCE_KINDS = ("address", "phone", "email", "website", "property")


def with_normalized(entities: DataFrame) -> DataFrame:
    """Entities with ``n``, their normalised value and keys by kind."""
    return entities.withColumn("n", X.normalized(F.col("entity_type"), F.col("display_name"), F.col("entity_id")))


def secondary_evidence(normalized: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, related_type, value): both ends of an edge have each other's normalised value as evidence."""
    side = lambda c: normalized.select(F.col("entity_id").alias(c), F.col("entity_type").alias(f"{c}_type"), F.col("n.value").alias(f"{c}_value"))
    both = edges.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst")
    of = lambda a, b: both.select(F.col(a).alias("entity_id"), F.col(f"{b}_type").alias("related_type"), F.col(f"{b}_value").alias("value"))
    return of("src", "dst").unionByName(of("dst", "src")).where("value IS NOT NULL").distinct()


def block_keys(kind: Column, n: Column) -> Column:
    """The block keys of an entity from its kind and what ``text.normalized`` gives; none for a blank value."""
    value = n["value"]
    words = F.split(value, " ")
    human = kind.isin("person", "officer", "registered_agent") & n["surname_prefix"].isNotNull()
    firm = kind.isin("business", "owner") & n["name_prefix"].isNotNull()
    key = lambda when, *parts: F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    keys = F.array(
        key(value.isNotNull(), "exact:", value),
        key(kind == "address", "building:", n["building"]),
        key(kind == "address", "zipnum:", n["zip"], ":", n["house_number"]),
        key(kind == "phone", "phone:", n["phone_prefix"]),
        key(kind == "email", "domain:", n["domain"]),
        key(firm, "name:", n["name_prefix"]),
        key(human, "surname:", n["surname_prefix"]),
        key(firm | human, "fuzzy-name:", F.substring(value, 1, 3)),
        key(human & (F.size(words) >= 2), "fuzzy-person:", F.substring(value, 1, 1), ":", F.substring(F.element_at(words, -1), 1, 2)),
    )
    return F.when(value.isNotNull(), F.array_compact(keys)).otherwise(F.array().cast("array<string>"))


def blocks(normalized: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, key): each entity's blocks, its kind first; names also block with each piece of evidence they have."""
    kind = F.col("entity_type")
    own = normalized.select("entity_id", kind, F.explode(block_keys(kind, F.col("n"))).alias("block"))
    prefixes = F.array_compact(F.array(F.when(kind.isin("business", "owner"), F.col("n.name_prefix")), F.when(kind.isin("person", "registered_agent", "officer", "owner"), F.col("n.surname_prefix"))))
    named = normalized.where("n.value IS NOT NULL").select("entity_id", kind, F.explode(prefixes).alias("prefix"))
    compound = named.join(evidence.where(F.col("related_type").isin(*EVIDENCE_KINDS)), "entity_id")
    compound = compound.select("entity_id", kind, F.concat_ws(":", F.lit("compound"), "prefix", "related_type", "value").alias("block"))
    return own.unionByName(compound).select("entity_id", F.concat_ws("|", "entity_type", "block").alias("key")).distinct()


def candidate_pairs(rows: DataFrame, key: Sequence[str], id_col: str, most: int = MAXIMUM_BLOCK) -> DataFrame:
    """(left_id, right_id), left < right, of rows that share a block. Blocks of one row or of over ``most`` rows give none.

    Blocks beyond the limit are skipped whole, which is what the rule asks for and what bounds the join.
    """
    distinct = rows.select(*key, F.col(id_col).alias("id")).distinct()
    sizes = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most)).drop("n")
    kept = distinct.join(sizes, list(key))
    right = kept.withColumnRenamed("id", "right_id")
    return kept.withColumnRenamed("id", "left_id").join(right, list(key)).where("left_id < right_id").select("left_id", "right_id").distinct()


def decide(same_name: Column, shared_evidence: Column, needs_evidence: Column) -> Column:
    """struct(method, score, decision) of a pair by its names and shared secondary evidence."""
    row = lambda method, score, decision: F.struct(F.lit(method).alias("method"), F.lit(score).alias("score"), F.lit(decision).alias("decision"))
    return (
        F.when(same_name & shared_evidence, row("exact_name_plus_secondary", 0.97, "AUTO_MERGE"))
        .when(same_name & ~needs_evidence, row("exact_name", 0.96, "AUTO_MERGE"))
        .when(same_name, row("exact_name_requires_secondary_review", 0.82, "REVIEW"))
        .otherwise(row("candidate_only", 0.0, "NO_MERGE"))
    )


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([0.0 if not a or not b else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)])


def similarity(left: str, right: str) -> Column:
    """Ratcliff-Obershelp ratio of two texts; it depends on which is left."""
    return F.pandas_udf(_ratios, DoubleType())(left, right)


def block_pairs(rows: DataFrame, key: Sequence[str], id_col: str, part: int = MAXIMUM_BLOCK, keep_key: bool = False) -> DataFrame:
    """(left_id, right_id), left < right, of all rows that share a block, however many those are; with ``keep_key`` once for each block.

    A block's rows are dealt into parts of ``part`` rows about, and each pair of parts is joined by itself.
    """
    distinct = rows.select(*key, F.col(id_col).alias("id")).distinct()
    parts = distinct.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = distinct.join(parts, list(key)).withColumn("own", own)
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    dealt = dealt.withColumn("cell", F.explode(cells)).select(*key, "cell.i", "cell.j", "own", "id")
    left, right = dealt.withColumnsRenamed({"id": "left_id", "own": "left_own"}), dealt.withColumnsRenamed({"id": "right_id", "own": "right_own"})
    both = left.join(right, [*key, "i", "j"]).where("left_id < right_id AND (i = j OR left_own <> right_own)")
    return both.select(*(key if keep_key else ()), "left_id", "right_id").distinct()


def alike_names(pairs: DataFrame, names: DataFrame, id_col: str, name: str, least: float) -> DataFrame:
    """``pairs`` with the ``ratio`` of their names, those that reach ``least``.

    Equal names need no comparison, nor do those whose lengths alone keep them below: a ratio is twice what is common
    over both lengths.
    """
    side = lambda x: names.select(F.col(id_col).alias(f"{x}_id"), F.col(name).alias(x)).distinct()
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    same = F.col("left") == F.col("right")
    a, b = F.length("left"), F.length("right")
    both = both.where(same | (2 * F.least(a, b) >= least * (a + b)))
    both = both.withColumn("l", F.when(~same, F.col("left"))).withColumn("ratio", F.when(same & (F.col("left") != ""), 1.0).otherwise(similarity("l", "right")))
    return both.where(F.col("ratio") >= least).select(*pairs.columns, F.round("ratio", 4).alias("ratio"))


def fuzzy_pairs(rows: DataFrame, key: Sequence[str], id_col: str, name: str, least: float, most: int = MAXIMUM_BLOCK) -> DataFrame:
    """Candidate pairs whose names are alike enough: (left_id, right_id, ratio). Only pairs of one block are compared."""
    return alike_names(candidate_pairs(rows, key, id_col, most), rows, id_col, name, least)


def canonical(members: DataFrame) -> DataFrame:
    """One row per cluster from (cluster, entity_id, entity_type, name, source_name[, display_name, basis, is_synthetic]): representative, counts, sources, stable id.

    The id comes from the first basis in order, the display from the first name, the longest of its displays; blanks
    come last. A cluster is synthetic if all of its members are.
    """
    has = lambda c, other: F.col(c) if c in members.columns else F.col(other)
    last = lambda c: F.when(F.trim(c) == "", "~").otherwise(F.coalesce(c, F.lit("~")))
    display, basis = has("display_name", "name"), has("basis", "name")
    by_basis = F.struct(last(basis), last(F.col("name")), F.upper(display), "source_name", "entity_id")
    by_name = F.struct(last(F.col("name")), -F.length(display), F.upper(display), "entity_id")
    extra = [F.bool_and(X.parse_bool(F.col("is_synthetic"))).alias("is_synthetic")] if "is_synthetic" in members.columns else []
    out = members.groupBy("cluster").agg(
        F.min("entity_type").alias("entity_type"),
        F.min_by(display, by_name).alias("display_name"),
        F.min_by(basis, by_basis).alias("basis"),
        F.count(F.lit(1)).alias("aliases"),
        F.countDistinct("source_name").alias("sources"),
        sorted_tokens(F.col("source_name")).alias("source_names"),
        *extra,
    )
    # Clusters of one name that did not merge have one canonical id; ``cluster`` tells them apart.
    return out.withColumn("canonical_id", F.concat(F.lit("canonical:"), F.col("entity_type"), F.lit(":"), F.substring(F.sha1(F.concat_ws("|", "entity_type", "basis").cast("binary")), 1, 16))).drop("basis")


def canonical_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, confidence, source) between canonical ids of (entity_id, canonical_id): unmapped ends and loops go, repeats merge."""
    side = lambda c: mapping.select(F.col("entity_id").alias(c), F.col("canonical_id").alias(f"c_{c}"))
    mapped = edges.join(side("src"), "src").join(side("dst"), "dst").where("c_src <> c_dst")
    return mapped.groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), "kind").agg(F.max("confidence").alias("confidence"), sorted_tokens(F.col("source")).alias("sources"))


def merge_rows(rows: DataFrame, keys: Sequence[str], order: str, merged: Sequence[str], first: Sequence[str]) -> DataFrame:
    """One row per key: ordered-distinct unions of token columns, first values of the others."""
    aggs = [merge_tokens(F.col(c), F.col(order)).alias(c) for c in merged] + [F.min_by(c, order).alias(c) for c in first]
    return rows.groupBy(*keys).agg(*aggs)


def ladder(kind: Column, left: Column, right: Column, same_parcel: Column, shared: Column, ratio: Column) -> Column:
    """struct(method, score, decision) of a pair of one type: identifiers, addresses, then names."""
    row = lambda method, score, decision: F.struct(method.alias("method"), F.lit(score).alias("score"), F.lit(decision).alias("decision"))
    exact = F.coalesce((F.trim(left) != "") & (left == right), F.lit(False))
    a, b = X.address_key(left), X.address_key(right)
    other_unit = F.coalesce((a["building"] != "") & (a["building"] == b["building"]) & (a["unit"] != b["unit"]), F.lit(False))
    enough = F.when(kind.isin(*PERSONS), PERSON_RATIO).otherwise(OTHER_RATIO)
    return (
        F.when(kind.isin("phone", "email", "website") & exact, row(F.concat(F.lit("exact_"), kind), 1.0, "AUTO_MERGE"))
        .when((kind == "property") & same_parcel, row(F.lit("exact_property_parcel"), 1.0, "AUTO_MERGE"))
        .when((kind == "address") & exact, row(F.lit("exact_address"), 0.99, "AUTO_MERGE"))
        .when((kind == "address") & other_unit, row(F.lit("shared_building_different_unit"), 0.3, "NO_MERGE"))
        .when(kind == "address", row(F.lit("candidate_only"), 0.0, "NO_MERGE"))
        .when(~exact & (ratio >= enough) & shared, row(F.lit("fuzzy_name_plus_secondary"), 0.86, "REVIEW"))
        .when(~exact & (ratio >= ALIKE_RATIO), row(F.lit("fuzzy_name_only"), 0.45, "NO_MERGE"))
        .otherwise(decide(exact, shared, kind.isin(*NEED_EVIDENCE)))
    )


def shared_evidence(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(left_id, right_id, shared): what both of a pair have as evidence, the first value of each kind, kinds in order.

    Evidence is looked up for the pairs alone, so a value that many entities have makes no pairs of its own.
    """
    kind = F.col("related_type") if "related_type" in evidence.columns else F.lit("address")
    known = evidence.select("entity_id", kind.alias("kind"), "value")
    left = pairs.select("left_id", "right_id").join(known.withColumnRenamed("entity_id", "left_id"), "left_id")
    both = left.join(known.withColumnRenamed("entity_id", "right_id"), ["right_id", "kind", "value"])
    order = F.array_position(F.array(*[F.lit(k) for k in EVIDENCE_KINDS]), F.col("kind"))
    first = both.where(order > 0).groupBy("left_id", "right_id", "kind").agg(F.min("value").alias("value"))
    said = F.struct(order.alias("o"), F.concat_ws("=", "kind", "value").alias("v"))
    return first.groupBy("left_id", "right_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["v"]), ", ").alias("shared"))


def match_decisions(entities: DataFrame, keys: DataFrame, evidence: DataFrame) -> DataFrame:
    """(match_id, left_id, right_id, entity_type, method, score, decision, shared) of the pairs of one type that share a block.

    The tables are those of ``resolve``. Names are compared letter by letter only where nothing before decides.
    """
    has_parcel = "parcel" in entities.columns
    pairs = candidate_pairs(keys.withColumnRenamed("entity_id", "id"), ["key"], "id")
    side = lambda x: entities.select(F.col("entity_id").alias(f"{x}_id"), F.col("entity_type").alias(f"{x}_type"), F.col("name").alias(f"{x}_name"), (F.col("parcel") if has_parcel else F.lit(None).cast("string")).alias(f"{x}_parcel"))
    rows = stored(pairs.join(side("left"), "left_id").join(side("right"), "right_id").where("left_type = right_type"), "pairs")
    rows = rows.join(shared_evidence(rows, evidence), ["left_id", "right_id"], "left")
    same_parcel = F.coalesce((F.trim("left_parcel") != "") & (F.col("left_parcel") == F.col("right_parcel")), F.lit(False))
    rows = rows.withColumn("same_parcel", same_parcel)
    undecided = (F.col("left_type") != "address") & (F.col("left_name") != F.col("right_name")) & ~F.col("same_parcel")
    rows = rows.withColumn("l", F.when(undecided, F.col("left_name"))).withColumn("ratio", similarity("l", "right_name"))
    decision = ladder(F.col("left_type"), F.col("left_name"), F.col("right_name"), F.col("same_parcel"), F.col("shared").isNotNull(), F.col("ratio"))
    out = rows.select("left_id", "right_id", F.col("left_type").alias("entity_type"), decision.alias("d"), "shared").select("left_id", "right_id", "entity_type", "d.*", "shared")
    return out.withColumn("match_id", X.stable_id("match", F.concat_ws("|", "left_id", "right_id"), F.col("method")))


def clusters_of(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """Entities with ``cluster``, the smallest id that merging pairs tie them to."""
    merged = matches.where("decision = 'AUTO_MERGE'").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))
    found = connected_components(entities.select(F.col("entity_id").alias("id")), merged)
    return entities.join(found.withColumnsRenamed({"id": "entity_id", "component": "cluster"}), "entity_id")


def resolve(entities: DataFrame, keys: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entities with their clusters: block, decide, join what merges.

    ``entities`` (entity_id, entity_type, name, source_name); ``keys`` (entity_id, key) are block keys; ``evidence``
    (entity_id, value, and the value's kind as related_type) secondary values; entities may have a ``parcel``, which
    properties merge on. Returns entities with ``cluster``, the smallest id of each cluster.
    """
    return clusters_of(entities, match_decisions(entities, keys, evidence))


def aliases(members: DataFrame, matches: DataFrame) -> DataFrame:
    """(entity_id, cluster, canonical_id, name, source_name, method, confidence), a row per member of (entity_id, cluster, canonical_id, name, source_name).

    A cluster's method is the methods of the pairs that merged it, its confidence the best of them; one alone is itself.
    """
    of = members.select(F.col("entity_id").alias("left_id"), "cluster")
    merged = matches.where("decision = 'AUTO_MERGE'").join(of, "left_id")
    by = merged.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("method")), "|").alias("method"), F.max("score").alias("confidence"))
    out = members.join(by, "cluster", "left")
    return out.select("entity_id", "cluster", "canonical_id", "name", "source_name", F.coalesce("method", F.lit("identity")).alias("method"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


@dataclass(frozen=True)
class Resolution:
    """What resolving gives: canonical entities, aliases, pair decisions and canonical edges."""

    canonical: DataFrame
    aliases: DataFrame
    matches: DataFrame
    edges: DataFrame


def implicit_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, entity_type, display_name, source_name) of edge ends that have no entity: the type and the name are what stands around the first colon of the id; the first edge names the source."""
    ends = edges.select(F.col("src").alias("entity_id"), "source_name", F.struct("src", "dst", "kind").alias("o")).unionByName(edges.select(F.col("dst").alias("entity_id"), "source_name", F.struct("src", "dst", "kind").alias("o")))
    lone = ends.join(entities.select("entity_id"), "entity_id", "left_anti").groupBy("entity_id").agg(F.min_by("source_name", "o").alias("source_name"))
    named = F.col("entity_id").contains(":")
    kind = F.when(named, F.substring_index("entity_id", ":", 1)).otherwise("unknown")
    display = F.when(named, F.regexp_replace("entity_id", "^[^:]*:", "")).otherwise(F.col("entity_id"))
    return lone.select("entity_id", kind.alias("entity_type"), display.alias("display_name"), "source_name")


def resolve_graph(entities: DataFrame, edges: DataFrame) -> Resolution:
    """Entities (entity_id, entity_type, display_name, source_name) and edges (src, dst, kind, confidence, source_name) resolved whole."""
    columns = ["entity_id", "entity_type", "display_name", "source_name"]
    every = entities.select(columns).unionByName(implicit_entities(entities, edges))
    normalized = stored(with_normalized(every), "normalized")
    evidence = stored(secondary_evidence(normalized, edges), "evidence")
    rows = normalized.select("entity_id", "entity_type", F.coalesce("n.value", F.lit("")).alias("name"), "source_name", F.col("n.parcel").alias("parcel"), "display_name", F.col("n.basis").alias("basis"))
    matches = stored(match_decisions(rows, blocks(normalized, evidence), evidence), "matches")
    members = stored(clusters_of(rows, matches), "clusters")
    made = canonical(members)
    mapping = members.join(made.select("cluster", "canonical_id"), "cluster")
    merged = canonical_edges(edges.withColumnRenamed("source_name", "source"), mapping.select("entity_id", "canonical_id"))
    return Resolution(made, aliases(mapping, matches), matches, merged)

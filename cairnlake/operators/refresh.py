"""Resolution again after some rows have changed: only blocks that changed rows touch are compared.

Rows, block keys and evidence are made for all entities - that is one pass of built-in functions - and held against those
of the last run. Entities that differ in any of them have changed; the members of all blocks that a changed entity is or
was in are affected, since a block that grows or shrinks past its limit changes the pairs of all its members. Pairs with an
end that isn't affected stay as they were decided. Clusters without an affected member keep their labels; the members of
the others are connected anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.graph import connected_components
from cairnlake.operators.resolution import blocks, implicit_entities, match_decisions, secondary_evidence, with_normalized
from cairnlake.sources.scratch import stored

ROW = ("entity_id", "entity_type", "name", "source_name", "parcel")


@dataclass(frozen=True)
class Run:
    """What a run keeps: rows, (entity_id, key), (entity_id, related_type, value), pair decisions, (entity_id, cluster)."""

    rows: DataFrame
    keys: DataFrame
    evidence: DataFrame
    matches: DataFrame
    labels: DataFrame


def _prepared(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    columns = ["entity_id", "entity_type", "display_name", "source_name"]
    every = entities.select(columns).unionByName(implicit_entities(entities, edges))
    normalized = stored(with_normalized(every), "normalized")
    evidence = stored(secondary_evidence(normalized, edges), "evidence")
    rows = stored(normalized.select("entity_id", "entity_type", F.coalesce("n.value", F.lit("")).alias("name"), "source_name", F.col("n.parcel").alias("parcel")), "rows")
    return rows, stored(blocks(normalized, evidence), "keys"), evidence


def _labels(ids: DataFrame, matches: DataFrame) -> DataFrame:
    merged = matches.where("decision = 'AUTO_MERGE'").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))
    return connected_components(ids.select(F.col("entity_id").alias("id")), merged).withColumnsRenamed({"id": "entity_id", "component": "cluster"})


def first_run(entities: DataFrame, edges: DataFrame) -> Run:
    rows, keys, evidence = _prepared(entities, edges)
    matches = stored(match_decisions(rows, keys, evidence), "matches")
    return Run(rows, keys, evidence, matches, stored(_labels(rows, matches), "labels"))


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ids of rows that only one of both has."""
    told = lambda df, x: df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(x))
    both = told(old, 0).unionByName(told(new, 1))
    return both.groupBy(*old.columns).agg(F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(-F.col("n"))).alias("d")).where("d <> 0").select("entity_id")


def refresh(old: Run, entities: DataFrame, edges: DataFrame) -> tuple[Run, DataFrame]:
    """The run over the tables as they are now, and one row that counts what was looked at."""
    rows, keys, evidence = _prepared(entities, edges)
    changed = _differing(old.rows.select(*ROW), rows.select(*ROW)).unionByName(_differing(old.keys, keys)).unionByName(_differing(old.evidence, evidence))
    changed = stored(changed.distinct(), "changed")
    every_key = old.keys.unionByName(keys)
    touched = stored(every_key.join(changed, "entity_id", "left_semi").select("key").distinct(), "touched")
    affected = stored(every_key.join(touched, "key", "left_semi").select("entity_id").unionByName(changed).distinct(), "affected")
    ours = stored(rows.join(affected, "entity_id", "left_semi"), "affected-rows")
    # Whole blocks, whose sizes count; of their pairs those with two affected ends are decided.
    near = keys.join(keys.join(affected, "entity_id", "left_semi").select("key").distinct(), "key", "left_semi").select("entity_id", "key")
    decided = stored(match_decisions(ours, near, evidence), "decided")
    end = lambda x: affected.select(F.col("entity_id").alias(x), F.lit(True).alias(f"{x}_affected"))
    kept = old.matches.join(end("left_id"), "left_id", "left").join(end("right_id"), "right_id", "left").where("left_id_affected IS NULL OR right_id_affected IS NULL").select(*old.matches.columns)
    kept = stored(kept, "kept-matches")
    matches = kept.unionByName(decided.select(*kept.columns))
    open_clusters = old.labels.join(affected, "entity_id", "left_semi").select("cluster").distinct()
    still = old.labels.join(open_clusters, "cluster", "left_anti")
    region = stored(rows.select("entity_id").join(still, "entity_id", "left_anti"), "region")
    inside = matches.join(region.select(F.col("entity_id").alias("left_id")), "left_id", "left_semi")
    labels = stored(still.select("entity_id", "cluster").unionByName(_labels(region, inside).select("entity_id", "cluster")), "labels")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    report = n(rows, "entities")
    for part in (n(changed, "changed"), n(affected, "affected"), n(touched, "touched_blocks"), n(decided, "decided"), n(kept, "kept"), n(region, "relabelled")):
        report = report.join(F.broadcast(part), how="cross")  # a row each
    return Run(rows, keys, evidence, matches, labels), report

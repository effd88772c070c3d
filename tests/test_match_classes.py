"""Counts of match classes against the pairs themselves."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import candidates, cross_source, match_classes

ENTITIES = "entity_id string, entity_type string, normalized_value string, source_name string, source_type string"
EDGES = "src string, dst string, kind string, source_name string, source_type string, record string"
ALIASES = "canonical_id string, entity_type string, entity_id string, source_name string, source_type string, record string, method string"


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(11)
    sources = [("a", "api"), ("b", "arcgis"), ("c", "synthetic"), ("d", "local file"), ("a", "unknown")]
    kinds = ["PROPERTY_HAS_SITUS_ADDRESS", "PROPERTY_HAS_MAILING_ADDRESS", "LOCATED_AT"]
    types = ["business", "owner", "person", "registered_agent", "officer", "property", "case"]
    entities = [(f"e{i:03}", draw.choice(types), f"name {draw.randint(0, 5)}" if i % 9 else "", *draw.choice(sources)) for i in range(170)]
    entities += [(f"a{i}", "address", f"addr {i}", "a", "api") for i in range(4)]
    edges = [(f"e{draw.randint(0, 169):03}", f"a{draw.randint(0, 3)}", draw.choice(kinds), *draw.choice(sources), draw.choice(["", "", "r1", "r2"])) for _ in range(260)]
    edges += [(f"e{draw.randint(0, 169):03}", f"e{draw.randint(0, 20):03}", "OFFICER_OF", *draw.choice(sources), "") for _ in range(60)]
    aliases = [(f"k{draw.randint(0, 5)}", draw.choice(["business"] * 4 + ["person"]), f"e{draw.randint(0, 169):03}", *draw.choice(sources), draw.choice(["", "", "r1", "r2"]), draw.choice(["exact", "exact_name_plus_secondary"])) for _ in range(90)]
    return spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(aliases, ALIASES)


def counted(matches):
    return Counter((r["method"], r["decision"], r["confidence"]) for r in matches.select("method", "decision", "confidence").collect())


def summed(classes):
    out = Counter()
    for r in classes.collect():
        out[r["method"], r["decision"], r["confidence"]] += r["links"]
    return out


def test_links_are_those_of_all_pairs(made):
    entities, edges, aliases = made
    pairs = lambda rows: counted(cross_source.identified(rows))
    assert summed(match_classes.address_classes(entities, edges)) == pairs(cross_source.address_pairs(entities, edges))
    assert summed(match_classes.name_classes(entities, edges)) == pairs(cross_source.name_pairs(entities, edges))
    assert summed(match_classes.alias_classes(aliases)) == pairs(cross_source.alias_pairs(aliases))


def test_diagnostics_and_canonical_ids(made):
    entities, edges, aliases = made
    matches = cross_source.cross_source_matches(entities, edges, aliases).collect()
    ids = match_classes.canonical_ids(entities, edges, aliases)
    real = {m["canonical_id"] for m in matches if m["decision"] == "AUTO_MATCH" and m["real_sources"] >= 2}
    assert {r["canonical_id"] for r in ids.collect()} == real and len(real) > 10
    got = {r["metric"]: r["value"] for r in cross_source.diagnostics(entities, edges, aliases, match_classes.all_classes(entities, edges, aliases), ids).collect()}
    decisions = Counter(m["decision"] for m in matches)
    assert int(got["auto_matches"]) == decisions["AUTO_MATCH"] and int(got["reviews"]) == decisions["REVIEW"] and int(got["real_entities"]) == len(real)
    assert int(got["rejected"]) == sum(n for d, n in decisions.items() if d.startswith("REJECTED")) and int(got["exact_candidates"]) == sum(m["method"].startswith("exact_") for m in matches)
    assert got["source_names"] == "a|b|c|d" and got["inconsistent_labels"] == "a"


def test_a_hot_address_has_few_rows(spark):
    entities = spark.range(4000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "property").otherwise("business").alias("entity_type"), F.lit("").alias("normalized_value"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("source_name"), F.lit("api").alias("source_type"))
    edges = entities.select(F.col("entity_id").alias("src"), F.lit("hot").alias("dst"), F.lit("PROPERTY_HAS_SITUS_ADDRESS").alias("kind"), "source_name", "source_type", F.lit("").alias("record"))
    entities = entities.unionByName(spark.createDataFrame([("hot", "address", "x", "p", "api")], ENTITIES))
    (row,) = match_classes.address_classes(entities, edges).collect()
    assert (row["key"], row["links"], row["decision"], row["source_pair"]) == ("hot", 4_000_000, "AUTO_MATCH", "p|q")


def test_pairs_come_once_however_their_keys_are_dealt(made, monkeypatch):
    entities, edges, aliases = made
    rows = lambda: sorted(tuple(r) for r in cross_source.cross_source_matches(entities, edges, aliases).select("canonical_id", "left_record", "right_record", "method", "match_id", "left_id", "right_id", "decision", "confidence", "evidence").collect())
    whole = rows()
    monkeypatch.setattr(cross_source, "CELL", 3)
    assert rows() == whole and len({r[:4] for r in whole}) == len(whole) > 500


def test_tasks_share_the_pairs_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(cross_source, "CELL", 100, raising=False)
    entities = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "property").otherwise("business").alias("entity_type"), F.lit("n").alias("normalized_value"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("source_name"), F.lit("api").alias("source_type"))
    edges = entities.select(F.col("entity_id").alias("src"), F.lit("hot").alias("dst"), F.lit("PROPERTY_HAS_SITUS_ADDRESS").alias("kind"), "source_name", "source_type", F.lit("").alias("record"))
    aliases = entities.select(F.lit("k").alias("canonical_id"), F.lit("business").alias("entity_type"), "entity_id", "source_name", "source_type", F.lit("").alias("record"), F.lit("exact").alias("method"))
    entities = entities.unionByName(spark.createDataFrame([("hot", "address", "x", "p", "api")], ENTITIES))
    for pairs, n in ((cross_source.address_pairs(entities, edges), 250_000), (cross_source.alias_pairs(aliases), 499_500)):
        per_task = [r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(per_task) == n and max(per_task) < 0.6 * n


def test_what_matches_say_is_that_of_all_pairs(made):
    entities, edges, _ = made
    # Some entities have a second row, of another source, type or name.
    more = entities.where("substr(entity_id, 4, 1) = '7' AND normalized_value <> ''").withColumns({"source_name": F.lit("e"), "source_type": F.lit("api"), "entity_type": F.lit("owner"), "normalized_value": F.lit("name 1")})
    says = ["canonical_id", "entity_type", "sources", "contains_synthetic", "confidence", "evidence"]
    sources = F.array_join(F.array_sort(F.split("sources", "[|]")), "|")
    rows = lambda df: sorted(tuple(r) for r in df.withColumn("sources", sources).groupBy(*says).agg(F.sum("n")).collect())
    for every in (entities, entities.unionByName(more)):
        got = rows(match_classes.said_by_names(every, edges))
        assert got == rows(candidates.said(cross_source.identified(cross_source.name_pairs(every, edges)))) and len(got) > 20 and any(r[5] for r in got)


def test_leads_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(cross_source, "_met", None)
    entities = spark.range(4000).select(F.concat(F.lit("e"), F.lpad("id", 4, "0")).alias("entity_id"), F.when(F.col("id") % 2 == 0, "owner").otherwise("business").alias("entity_type"), F.lit("hot").alias("normalized_value"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("source_name"), F.lit("api").alias("source_type"))
    properties = entities.select(F.concat(F.lit("p"), "entity_id").alias("entity_id"), F.lit("property").alias("entity_type"), F.lit("").alias("normalized_value"), F.lit("r").alias("source_name"), "source_type")
    at = lambda rows: rows.select(F.col("entity_id").alias("src"), F.lit("hot").alias("dst"), F.lit("PROPERTY_HAS_SITUS_ADDRESS").alias("kind"), "source_name", "source_type", F.lit("").alias("record"))
    every = entities.unionByName(properties).unionByName(spark.createDataFrame([("hot", "address", "x", "p", "api")], ENTITIES))
    found = {r["canonical_id"]: r["n"] for r in match_classes.said(every, at(entities).unionByName(at(properties))).collect()}
    assert found.pop("hot") == 2000 * 4000 and sum(found.values()) == 2000 * 2000 and found["e0000"] == 2000 and found["e3998"] == 1 and "e3999" not in found


def test_tasks_share_the_pairs_of_records_with_several_rows(spark):
    entities = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "property").otherwise("business").alias("entity_type"), F.lit("n").alias("normalized_value"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("source_name"), F.lit("api").alias("source_type"))
    kinds = F.explode(F.array(F.lit("PROPERTY_HAS_SITUS_ADDRESS"), F.lit("PROPERTY_HAS_MAILING_ADDRESS")))
    edges = entities.where("entity_type = 'property'").select(F.col("entity_id").alias("src"), F.lit("hot").alias("dst"), kinds.alias("kind"), "source_name", "source_type", F.lit("").alias("record"))
    edges = edges.unionByName(entities.where("entity_type = 'business'").select(F.col("entity_id").alias("src"), F.lit("hot").alias("dst"), F.lit("LOCATED_AT").alias("kind"), "source_name", "source_type", F.lit("").alias("record")))
    entities = entities.unionByName(spark.createDataFrame([("hot", "address", "x", "p", "api")], ENTITIES))
    per_task = [r["n"] for r in cross_source.address_pairs(entities, edges).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_task) == 500_000 and max(per_task) < 0.9 * 500_000

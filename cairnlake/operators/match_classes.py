"""Matches across sources without their pairs: classes of records that no rule tells apart, and how many links they have.

Rules read only sources, types and kinds. Records of a key (an address, a name, a canonical entity) that have the same of
these are one class, so a key has few classes however many records it has, and an address of 100,000 properties and
100,000 parties a few rows instead of 10,000,000,000. A pair of classes is judged by the rules of ``cross_source`` and has
as many links as its records have pairs; ``cross_source`` makes the pairs of the keys that are looked at. Where evidence
decides, records are classed by the evidence that others of their name have too, and only classes that share some meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.operators import candidates, cross_source
from cairnlake.sources.scratch import stored

COLUMNS = ("key", "method", "decision", "confidence", "source_pair", "real_sources", "links")


def _members(rows: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """(key, record, traits): all that a record's rows say, as one value."""
    return rows.groupBy(*key, "record").agg(F.sort_array(F.collect_set(F.struct(*attributes))).alias("traits"))


def _classes(members: DataFrame, key: list[str], *more: str) -> DataFrame:
    return members.groupBy(*key, "traits", *more).agg(F.count(F.lit(1)).alias("n"), F.max("record").alias("greatest"))


def _sides(classes: DataFrame, x: str, key: list[str]) -> DataFrame:
    return classes.select(*key, *[F.col(c).alias(f"{x}_{c}") for c in classes.columns if c not in key])


def _traits(pairs: DataFrame, attributes: list[str]) -> DataFrame:
    """Each pair of classes once for every combination of their rows' traits, as the columns that rules read."""
    out = pairs.withColumn("l", F.explode("left_traits")).withColumn("r", F.explode("right_traits"))
    return out.withColumns({f"{x}_{a}": F.col(f"{x[0]}.{a}") for x in ("left", "right") for a in attributes}).drop("l", "r")


def _best(judged: DataFrame, by: list[str]) -> DataFrame:
    """Of the judgements of one pair and method, the first by decision and confidence."""
    pair = F.array_join(F.array_sort(F.array_distinct(F.array("left_source", "right_source"))), "|")
    order = F.struct("decision", (-F.col("confidence")).alias("c"), pair.alias("p"))
    row = F.struct("decision", "confidence", pair.alias("source_pair"), F.col("real_sources").cast("long").alias("real_sources"))
    return judged.groupBy(*by, "method").agg(F.min_by(row, order).alias("r"), F.first("links").alias("links")).select(*by, "method", "r.*", "links")


def _links() -> Column:
    n, m = F.col("left_n"), F.col("right_n")
    return F.when(F.col("same_class"), n * (n - 1) / 2).otherwise(n * m).cast("long")


def _unordered(classes: DataFrame, key: list[str], name: Column) -> DataFrame:
    """Pairs of a key's classes, and each class with itself, with the number of pairs of their records."""
    told = classes.withColumn("class", name)
    both = _sides(told, "left", key).join(_sides(told, "right", key), key).where("left_class <= right_class")
    return both.withColumn("same_class", F.col("left_class") == F.col("right_class")).withColumn("links", _links()).where("links > 0")


def _within(rows: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Pairs of the rows of one record; those are few."""
    columns = ["id", *attributes]
    side = lambda x: rows.select(*key, "record", *[F.col(c).alias(f"{x}_{c}") for c in columns])
    order = lambda x: F.struct(f"{x}_id", f"{x}_source")
    return side("left").join(side("right"), [*key, "record"]).where(order("left") < order("right")).withColumn("links", F.lit(1).cast("long"))


def _done(judged: DataFrame, key: str) -> DataFrame:
    return judged.groupBy(F.col(key).alias("key"), "method", "decision", "confidence", "source_pair", "real_sources").agg(F.sum("links").alias("links")).select(*COLUMNS)


def address_classes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The matches of ``cross_source.address_pairs``, counted."""
    attributes, key = ["source", "source_type", "type", "kind"], ["canonical_id"]
    rows = cross_source.address_rows(entities, edges)
    of = lambda condition, x: _sides(_classes(_members(rows.where(condition), key, attributes), key), x, key)
    both = of("type = 'property'", "left").join(of("type IN ('business', 'person', 'case')", "right"), key).withColumn("links", F.col("left_n") * F.col("right_n"))
    return _done(_best(cross_source.judged_addresses(_traits(both, attributes)), [*key, "left_traits", "right_traits"]), "canonical_id")


def alias_classes(aliases: DataFrame) -> DataFrame:
    """The matches of ``cross_source.alias_pairs``, counted."""
    attributes, key = ["source", "source_type"], ["canonical_id", "entity_type"]
    rows = cross_source.alias_rows(aliases)
    methods = rows.groupBy("canonical_id").agg(F.min("method").alias("first_method"))
    rows = rows.drop("method").distinct()
    judged = lambda pairs: cross_source.judged_aliases(pairs.join(methods, "canonical_id"))
    across = _traits(_unordered(_classes(_members(rows, key, attributes), key), key, F.to_json("traits")), attributes)
    out = _best(judged(across), [*key, "left_class", "right_class"]).drop("left_class", "right_class")
    return _done(out.unionByName(_best(judged(_within(rows, key, attributes)), [*key, "record"]).drop("record")), "canonical_id")


def name_classes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The matches of ``cross_source.name_pairs``, counted."""
    attributes, key = ["source", "source_type", "type"], ["normalized_value"]
    rows, members = _named(entities, key, attributes)
    methods = lambda pairs: cross_source.name_methods(_traits(pairs, attributes))
    judged = lambda pairs, by, evidence: _best(cross_source.judged_names(pairs.withColumn("evidence", evidence)), [*key, *by])
    classes = ["left_class", "right_class"]
    total = judged(methods(_unordered(_classes(members, key), key, F.to_json("traits"))), classes, F.lit(None).cast("string"))
    # What shares evidence is counted apart; the rest of a method that asks for it lacks it.
    together = judged(_sharing(members, entities, edges, key).transform(methods), ["left_class", "right_class", "pair"], F.lit("shared")).where(F.col("method").contains("secondary"))
    together = stored(together.drop("pair"), "sharing")
    found = together.groupBy(*key, *classes, "method").agg(F.sum("links").alias("found"))
    rest = total.join(found, [*key, *classes, "method"], "left").withColumn("links", F.col("links") - F.coalesce("found", F.lit(0))).drop("found").where("links > 0")
    alone = _within(rows, key, attributes).transform(cross_source.name_methods)
    has_context = cross_source.secondary_context(entities, edges).select(F.col("entity_id").alias("record"), F.lit("own").alias("evidence")).distinct()
    alone = _best(cross_source.judged_names(alone.join(has_context, "record", "left")), [*key, "record"])
    return _done(rest.drop(*classes).unionByName(together.drop(*classes)).unionByName(alone.drop("record")), "normalized_value")


def _named(entities: DataFrame, key: list[str], attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = cross_source.name_rows(entities).distinct()
    return rows, stored(_members(rows, key, attributes), "named")


def _sharing(members: DataFrame, entities: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of classes of one name that share a piece of evidence, told by both classes and their evidence."""
    context = cross_source.secondary_context(entities, edges).withColumnRenamed("entity_id", "record")
    told = stored(members.select(*key, "record").join(context, "record"), "told")
    common = told.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    values = told.join(common, [*key, "value"]).groupBy(*key, "record").agg(F.sort_array(F.collect_set("value")).alias("values"))
    groups = _classes(members.join(values, [*key, "record"]), key, "values").withColumn("class", F.to_json("traits")).withColumn("group", F.concat_ws("|", "class", F.sha1(F.to_json("values").cast("binary"))))
    groups = stored(groups, "groups")
    by_value = groups.select(*key, "group", F.explode("values").alias("value"))
    met = by_value.withColumnRenamed("group", "left_group").join(by_value.withColumnRenamed("group", "right_group"), [*key, "value"]).where("left_group <= right_group").select(*key, "left_group", "right_group").distinct()
    side = lambda x: _sides(groups.drop("values"), x, key)
    both = met.join(side("left"), [*key, "left_group"]).join(side("right"), [*key, "right_group"])
    return both.withColumn("same_class", F.col("left_group") == F.col("right_group")).withColumn("links", _links()).where("links > 0").withColumn("pair", F.concat_ws("#", "left_group", "right_group"))


def all_classes(entities: DataFrame, edges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, method, decision, confidence, source_pair, real_sources, links) of all three kinds of matches."""
    out = address_classes(entities, edges).unionByName(name_classes(entities, edges))
    return out if aliases is None else out.unionByName(alias_classes(aliases))


def canonical_ids(entities: DataFrame, edges: DataFrame, aliases: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """The distinct canonical ids of the matches that count and have two real sources.

    With ``classes``, what ``all_classes`` gave for the same tables, those of addresses and aliases are not made again.

    The match of two names is told by the lesser of both ids: an entity is that of one if a class that its own class
    matches has a greater id.
    """
    counts = (F.col("decision") == "AUTO_MATCH") & (F.col("real_sources") >= cross_source.LEAST_REAL)
    if classes is None:
        keyed = address_classes(entities, edges)
        keyed = keyed if aliases is None else keyed.unionByName(alias_classes(aliases))
    else:
        keyed = classes.where(~F.col("method").isin(*cross_source.NAME_METHODS))
    out = keyed.where(counts).select(F.col("key").alias("canonical_id"))
    attributes, key = ["source", "source_type", "type"], ["normalized_value"]
    _, members = _named(entities, key, attributes)
    methods = lambda pairs: cross_source.name_methods(_traits(pairs, attributes))
    plain = methods(_unordered(_classes(members, key), key, F.to_json("traits"))).where(~F.col("method").contains("secondary") & (F.col("real_sources") >= cross_source.LEAST_REAL))
    reach = lambda pairs, name: pairs.select(*key, F.col(f"left_{name}").alias("told"), F.col("right_greatest").alias("upto")).unionByName(pairs.select(*key, F.col(f"right_{name}").alias("told"), F.col("left_greatest").alias("upto"))).groupBy(*key, "told").agg(F.max("upto").alias("upto"))
    simple = members.withColumn("told", F.to_json("traits")).join(reach(plain, "class"), [*key, "told"]).where("record < upto")
    backed = methods(_sharing(members, entities, edges, key)).where(F.col("method").contains("secondary") & (F.col("real_sources") >= cross_source.LEAST_REAL))
    context = cross_source.secondary_context(entities, edges).withColumnRenamed("entity_id", "record")
    told = members.select(*key, "record", "traits").join(context, "record")
    common = told.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    grouped = told.join(common, [*key, "value"]).groupBy(*key, "record", "traits").agg(F.sort_array(F.collect_set("value")).alias("values"))
    grouped = grouped.withColumn("told", F.concat_ws("|", F.to_json("traits"), F.sha1(F.to_json("values").cast("binary"))))
    shared = grouped.join(reach(backed, "group"), [*key, "told"]).where("record < upto")
    return out.unionByName(simple.select(F.col("record").alias("canonical_id"))).unionByName(shared.select(F.col("record").alias("canonical_id"))).distinct()


def _above(asks: DataFrame, tells: DataFrame, key: list[str]) -> DataFrame:
    """``asks`` with ``n``, how many of ``tells`` of their key have a greater id. Ranges of ids are counted apart, so no task holds all rows of a key."""
    both = asks.withColumn("tells", F.lit(0)).unionByName(tells.withColumn("tells", F.lit(1)), allowMissingColumns=True)
    held = stored(both.repartitionByRange(*key, "id").withColumn("part", F.spark_partition_id()), "ranged")
    sums = held.groupBy("part", *key).agg(F.sum("tells").alias("told"))
    later = F.sum("told").over(W.partitionBy(*key).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1))  # over parts, not rows
    within = F.sum("tells").over(W.partitionBy("part", *key).orderBy(F.desc("id")).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = held.withColumn("within", within).where("tells = 0").join(sums.select("part", *key, later.alias("later")), ["part", *key])
    return out.withColumn("n", F.col("within") + F.coalesce("later", F.lit(0))).drop("part", "tells", "within", "later").where("n > 0")


def said_by_names(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """What ``candidates.said`` gives of ``cross_source.name_pairs``.

    A match is told by the lesser of both ids: an entity has as many as greater ids stand in the classes that its own
    class matches, and where evidence decides, in the classes of those that share the same first piece with it. Of the
    records that have several rows, pairs are made.
    """
    key, kind = ["normalized_value"], ["type", "source", "source_type"]
    rows = cross_source._with_alone(cross_source.name_rows(entities), [], "name-rows")
    once = rows.where("alone")
    side = lambda rows, x, *more: rows.select(*key, *more, *[F.col(c).alias(f"{x}_{c}") for c in kind])
    matched = lambda left, right, by: cross_source.name_methods(left.join(right, by)).where(F.col("real_sources") >= cross_source.LEAST_REAL)
    says = [F.col("left_type").alias("entity_type"), F.concat_ws("|", "left_source", "right_source").alias("sources")]
    kinds = once.select(*key, *kind).distinct()
    met = stored(matched(side(kinds, "left"), side(kinds, "right"), key), "met")
    asked = F.col("method").contains("secondary")
    # Methods without evidence: whole classes meet.
    named = lambda x: F.to_json(F.struct(*[F.col(f"{x}{c}").alias(c) for c in kind])).alias("group")
    plain = met.where(~asked)
    asks = plain.select(*key, *[F.col(f"left_{c}").alias(c) for c in kind], named("right_"), *says, F.lit("").alias("evidence")).join(once.select(*key, *kind, "id"), [*key, *kind]).drop(*kind)
    tells = once.select(*key, named(""), "id").join(plain.select(*key, named("right_")).distinct(), [*key, "group"])
    # Methods with evidence: classes of those that have the same of what others of their name have too.
    needed = stored(once.select(*key, *kind, "id").join(met.where(asked).select(*key, *[F.col(f"left_{c}").alias(c) for c in kind]).distinct(), [*key, *kind]), "needed")
    context = cross_source.secondary_context(entities, edges.join(needed.select(F.col("id").alias("src")), "src", "left_semi")).withColumnRenamed("entity_id", "id")
    told = stored(needed.join(context, "id"), "told")
    common = told.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    grouped = told.join(common, [*key, "value"]).groupBy(*key, *kind, "id").agg(F.sort_array(F.collect_set("value")).alias("values"))
    grouped = stored(grouped.withColumn("group", F.concat_ws("|", named(""), F.sha1(F.to_json("values").cast("binary")))), "groups")
    by_value = stored(grouped.select(*key, *kind, "group", "values").distinct().withColumn("value", F.explode("values")).drop("values"), "values")
    met = matched(side(by_value, "left", "value", F.col("group").alias("left_group")), side(by_value, "right", "value", F.col("group").alias("right_group")), [*key, "value"])
    met = stored(met.where(asked).groupBy(*key, "left_group", "right_group", *says).agg(F.min("value").alias("evidence")), "met-groups")
    members = grouped.select(*key, "group", "id")
    asks = asks.unionByName(met.withColumnRenamed("left_group", "group").join(members, [*key, "group"]).drop("group").withColumnRenamed("right_group", "group"))
    tells = tells.unionByName(members.join(met.select(*key, F.col("right_group").alias("group")).distinct(), [*key, "group"]))
    counted = _above(asks, tells, [*key, "group"]).groupBy(F.col("id").alias("canonical_id"), "entity_type", "sources", "evidence").agg(F.sum("n").alias("n"))
    out = counted.withColumns({"contains_synthetic": F.lit(False), "confidence": F.lit(cross_source.COMPOUND)})
    if rows.where("NOT alone").isEmpty():
        return out
    return out.unionByName(candidates.said(cross_source.identified(cross_source.name_pairs(entities, edges, alone=False))))


def said(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """What ``candidates.said`` gives of ``cross_source.cross_source_matches``, but that no pair of an address is made to be counted.

    Of a record's rows that match alike, the class tells the first pair of sources, the pair that of the first ids.
    """
    counts = (F.col("decision") == "AUTO_MATCH") & (F.col("real_sources") >= cross_source.LEAST_REAL)
    at = address_classes(entities, edges).where(counts).groupBy(F.col("key").alias("canonical_id"), F.col("source_pair").alias("sources"), "confidence").agg(F.sum("links").alias("n"))
    # Both sources are real, so neither is synthetic.
    at = at.withColumns({"entity_type": F.lit("address"), "evidence": F.col("canonical_id"), "contains_synthetic": F.lit(False)})
    return at.unionByName(said_by_names(entities, edges))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets an exponential key ``-ln(u) / w`` from a uniform hash ``u`` of its id and its quality weight ``w``;
the documents of a source, taken in key order, are a weighted sample without replacement of any size. A source whose
target is ``t`` words out of ``S`` goes in ``floor(t / S)`` complete times, and the rest of the target is the key-order
prefix whose words come nearest to it. Prefix sums are two-level: keys fall into ranges of about ``RANGE_ROWS`` rows,
range sums give the one range in which a source's budget ends, and only that range is sorted, so a source that holds a
third of all rows is neither gathered nor sorted in one task. Rows that are alike in key, id and size are one group
there, and how many of them go in follows from the sums; where that is some of them, they are told apart by their row
numbers, in salted parts.

Defined results: null text has size 0; a null source is a source of its own, last in order; a null id draws its key
from the text; rows that repeat are rows of their own (ties in key go by id, then size); an empty table gives an empty
mix; input columns of any name ride along untouched in ``mix``'s ``doc`` struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Weights of the sources in code point order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
BUDGET_FACTOR = 1.5
MAX_EPOCHS = 2
#: Rows of a key range, about; fewer ranges than ``LEAST_RANGES`` are not made.
RANGE_ROWS, LEAST_RANGES = 20_000, 4096
SALTS = 64
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: nearest 1 where words have six characters (with the blank) on average, as prose has."""
    drift = F.abs(F.length(text).cast("double") / F.nullif(size, F.lit(0)) - 6.0) / 6.0
    return F.coalesce(1.0 / (1.0 + drift), F.lit(1.0))


def rows_to_mix(docs: DataFrame, seed: str = SEED, weight: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, source, size, key, doc): ``doc`` carries the columns named in ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text.cast("binary"))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    sized = docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source"),
        word_count(F.col("text")).alias("size"),
        text.alias("text"),
        ((draw + 0.5) / float(2**52)).alias("u"),
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("doc"),
    )
    w = quality_weight(F.col("text"), F.col("size")) if weight is None else weight
    return sized.select("id", "source", "size", (-F.log("u") / w).alias("key"), "doc")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, budget_factor: float = BUDGET_FACTOR, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The budget is shared by weight; a target stops at ``max_epochs`` times its source's size and the excess is reshared
    until none is above. That is the level L with sum(least(cap, weight * L)) = budget: with the sources in the order of
    cap / weight, it is found by prefix sums. The windows here run over the sources, not over documents.
    """
    in_order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy(F.lit(0))
    before = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * float(budget_factor) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = weighed.withColumn("level", level)
    best = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return levelled.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * best), F.col("cap")).alias("target"))


def mix(rows: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, budget_factor: float = BUDGET_FACTOR, max_epochs: float = MAX_EPOCHS, ranges: int | None = None) -> DataFrame:
    """(id, source, size, doc, source_size, target, copies, taken) for rows as ``rows_to_mix`` gives them."""
    # Stored once: words are counted once, and row numbers stay what they are.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    n_ranges = max(LEAST_RANGES, rows.count() // RANGE_ROWS) if ranges is None else ranges
    bucket = F.least(F.floor((1.0 - F.exp(-F.col("key"))) * n_ranges), F.lit(n_ranges - 1)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_factor, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = sums.withColumn("upto", running).withColumnRenamed("source", "of")
    #: The first range whose sum passes the rest of the budget; ranges below it go in whole, ranges above it not.
    edge = (
        ends.join(targets, ends["of"].eqNullSafe(targets["source"]))
        .groupBy("source", "source_size", "target", "epochs", "rest")
        .agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("edge"))
    )
    edge = stored(edge, "mix-edges").withColumnRenamed("source", "of")
    placed = rows.join(edge, rows["source"].eqNullSafe(edge["of"])).drop("of")
    at = F.coalesce(F.col("edge.bucket"), F.lit(n_ranges))
    sure = placed.where(F.col("bucket") != at).withColumn("extra", (F.col("bucket") < at) & (F.col("size") > 0))
    split = placed.where(F.col("bucket") == at)
    alike = split.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("edge.before").alias("start"))
    upto = F.sum(F.col("n") * F.col("size")).over(W.partitionBy("source").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    alike = alike.withColumn("before", F.col("start") + upto - F.col("n") * F.col("size"))
    # The i-th of n alike rows goes in if the sum is nearer to the rest with it: before + size * (2 * i + 1) / 2 <= rest.
    room = 2 * F.col("rest") - 2 * F.col("before") - F.col("size")
    fit = F.when(F.col("n") == 1, (room >= 0).cast("long")).otherwise(F.least(F.greatest(F.floor(room / F.nullif(2 * F.col("size"), F.lit(0))) + 1, F.lit(0)), F.col("n")))
    alike = alike.select("source", "key", "id", "size", "n", F.when(F.col("size") > 0, fit).otherwise(F.lit(0)).cast("long").alias("fit"))
    ours = ("source", "key", "id", "size")
    named = alike.withColumnsRenamed({c: f"a_{c}" for c in ours})
    told = split.join(named, [split[c].eqNullSafe(named[f"a_{c}"]) for c in ours]).drop(*[f"a_{c}" for c in ours])
    whole = told.where("fit = 0 OR fit = n").withColumn("extra", F.col("fit") > 0).drop("n", "fit")
    some = told.where("fit > 0 AND fit < n").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    parts = some.groupBy(*ours, "salt").agg(F.count(F.lit(1)).alias("k"))
    below = F.sum("k").over(W.partitionBy(*ours).orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("k")
    parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in (*ours, "salt")], below.alias("below"))
    nth = F.row_number().over(W.partitionBy(*ours, "salt").orderBy("row"))
    some = some.withColumn("nth", nth).join(parts, [some[c].eqNullSafe(parts[f"p_{c}"]) for c in (*ours, "salt")])
    some = some.withColumn("extra", F.col("below") + F.col("nth") <= F.col("fit"))
    columns = ["id", "source", "size", "doc", "source_size", "target", "epochs", "extra"]
    out = sure.select(columns).unionByName(whole.select(columns)).unionByName(some.select(columns))
    copies = F.col("epochs") + F.col("extra").cast("long")
    return out.select("id", "source", "size", "doc", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it."""
    picked = mix(rows_to_mix(docs, keep=docs.columns), **options).where(F.col("copies") > 0)
    repeated = picked.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(rows_to_mix(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(text, '') AS text
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln(((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '-' || md5(text))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + abs(length(text)::DOUBLE / nullif(size, 0)::DOUBLE - 6.0::DOUBLE) / 6.0::DOUBLE), 1.0::DOUBLE) AS key
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY (source IS NULL)::INT, source) - 1) % 3 + 1)::INT] AS weight,
    source_size::DOUBLE * 2 AS cap
  FROM sources),
levelled AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0::DOUBLE))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0::DOUBLE)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, (source IS NULL)::INT, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()), cap) AS target FROM levelled),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.size, k.source, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN size > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS taken, source
FROM placed
"""

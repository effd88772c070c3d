"""Peer-group statistics: percentiles, baselines, robust scores, rolling peaks, rarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.sources.scratch import stored


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, v, n): how often each value stands in each group. What follows reads this, so a group costs its distinct values."""
    return df.groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _quantile(value: str, share: float) -> Column:
    return F.expr(f"percentile({value}, {share}D, n)")


def counted_view(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each value of ``value_counts`` with its group's peers, mean, median, quartiles, and its percentile, robust z and IQR score."""
    peers = F.sum("n")
    per = counts.groupBy(*group).agg(peers.alias("peers"), (F.sum(F.col("v") * F.col("n")) / peers).alias("mean"), _quantile("v", 0.5).alias("median"), _quantile("v", 0.25).alias("q1"), _quantile("v", 0.75).alias("q3"))
    near = counts.join(per, list(group))
    spread = near.withColumn("off", F.abs(F.col("v") - F.col("median"))).groupBy(*group).agg(_quantile("off", 0.5).alias("mad"))
    upto = F.sum("n").over(W.partitionBy(*group).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = near.join(spread, list(group)).withColumn("percentile", F.round(upto / F.col("peers"), 4))
    z = F.when(F.col("mad") != 0, 0.6745 * (F.col("v") - F.col("median")) / F.nullif("mad", F.lit(0.0)))
    span = F.col("q3") - F.col("q1")
    iqr = F.when((F.col("peers") >= 4) & (span > 0), (F.col("v") - F.col("q3")) / F.nullif(span, F.lit(0.0)))
    return out.withColumns({"robust_z": z, "iqr_score": iqr})


def _judged(df: DataFrame, group: Sequence[str], value: str, *columns: str | Column) -> DataFrame:
    """Rows with columns of ``counted_view``; rows without a value have none."""
    view = counted_view(value_counts(df.where(F.col(value).isNotNull()), group, value), group).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("v").alias("_v"), *columns)
    meets = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col(value).cast("double") == F.col("_v")]
    return df.join(view, meets, "left").drop("_v", *[f"_{g}" for g in group])


def with_percentile(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds ``percentile``, the share of the peer group whose value is not larger."""
    return _judged(df, group, value, "percentile")


def baselines(df: DataFrame, group: Sequence[str], value: str, least_peers: int = 5) -> DataFrame:
    """Size, mean, median, 90th percentile and extremes of each peer group, and whether it is large enough to judge by."""
    peers = F.sum("n")
    return value_counts(df, group, value).groupBy(*group).agg(
        peers.alias("peers"),
        F.round(F.sum(F.col("v") * F.col("n")) / peers, 4).alias("mean"),
        _quantile("v", 0.5).alias("median"),
        _quantile("v", 0.9).alias("p90"),
        F.max("v").alias("largest"),
        F.min("v").alias("smallest"),
        F.when(peers >= least_peers, "OK").otherwise("INSUFFICIENT_BASELINE").alias("status"),
    )


def robust_scores(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds ``robust_z`` (null where the median deviation is 0) and ``iqr_score`` (null below four peers or without spread)."""
    return _judged(df, group, value, "robust_z", "iqr_score")


def rolling_peaks(df: DataFrame, key: str, ts: str, days: Sequence[int] = (3, 7, 30)) -> DataFrame:
    """The most events that each key has in any trailing window whose first and last event are ``days`` full days apart at most."""
    micros = df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    day = 86_400_000_000
    over = {f"peak_{d}": F.count(F.lit(1)).over(W.partitionBy(key).orderBy("us").rangeBetween(-((d + 1) * day - 1), 0)) for d in days}
    return micros.withColumns(over).groupBy(key).agg(*[F.max(c).alias(c) for c in over])


def rarity_view(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds the Poisson tail against the group's mean, the percentile, the rarity score and the review level."""
    out = _judged(df, group, value, "percentile", F.col("mean").alias("expected"))
    out = out.withColumn("probability", scores.poisson_at_least(F.col(value), F.col("expected")))
    out = out.withColumn("rarity", scores.rarity(F.col("probability"), F.col("percentile"), F.lit(None).cast("double")))
    return out.withColumn("level", scores.review_level(F.col("probability"), F.col("percentile"), F.col("rarity")))


def numbered(df: DataFrame, order: Sequence[Column | str], column: str = "nth") -> DataFrame:
    """Rows with their place in an order, from 1. Ranges of the order are sorted apart and counted, so no task holds all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Partition and place are stored with the rows; the id's lower bits count within a partition.
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = stored(placed, "numbered")
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")  # over partitions, not rows
    return held.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(column, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")

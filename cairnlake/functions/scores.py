"""Scores and their bands as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def capped(base: float, step: float, n: Column, cap: float) -> Column:
    """base + step * n, at most cap."""
    return F.least(F.lit(base) + F.lit(step) * n, F.lit(cap))


def rule_score(base: int, step: int, n: Column, most: int = 5) -> Column:
    """A rule's points: more for each beyond the second, up to ``most``."""
    return F.lit(base) + F.least(n - 2, F.lit(most)) * step


def severity(score: Column) -> Column:
    return F.when(score >= 25, "high").when(score >= 15, "medium").otherwise("low")


def poisson_at_least(k: Column, rate: Column) -> Column:
    """P(X >= k) for a Poisson variable: one less the sum of the terms below k, each from the one before, as logarithms."""
    whole = F.greatest(F.round(k).cast("int"), F.lit(0))
    start = F.named_struct(F.lit("s"), F.lit(0.0), F.lit("t"), -rate)
    step = lambda acc, v: F.named_struct(F.lit("s"), acc["s"] + F.exp(acc["t"]), F.lit("t"), acc["t"] + F.log(rate) - F.log(v + F.lit(1.0)))
    below = F.aggregate(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), start, step)["s"]
    tail = F.least(F.greatest(F.lit(1.0) - below, F.lit(0.0)), F.lit(1.0))
    return F.when(rate <= 0, F.when(whole <= 0, F.lit(1.0))).when(whole <= 0, F.lit(1.0)).otherwise(tail)


def rarity(probability: Column, percentile: Column, z: Column) -> Column:
    """0 to 100: the largest of what the probability, the percentile and the robust z say."""
    by_probability = F.when(probability > 0, F.least(F.greatest(-25 * F.log10(F.greatest(probability, F.lit(1e-9))), F.lit(0.0)), F.lit(100.0)))
    by_percentile = F.greatest((percentile - 0.5) * 200, F.lit(0.0))
    by_z = F.least(F.greatest(z / 6 * 100, F.lit(0.0)), F.lit(100.0))
    return F.greatest(F.coalesce(by_probability, F.lit(0.0)), F.coalesce(by_percentile, F.lit(0.0)), F.coalesce(by_z, F.lit(0.0)))


def review_level(probability: Column, percentile: Column, score: Column) -> Column:
    by_probability = F.when(probability <= 0.001, "EXTREME_OUTLIER").when(probability <= 0.01, "IMMEDIATE_REVIEW").when(probability <= 0.05, "ELEVATED_REVIEW").when(probability <= 0.15, "ROUTINE_REVIEW").otherwise("COMMON")
    by_percentile = F.when(percentile >= 0.999, "EXTREME_OUTLIER").when(percentile >= 0.99, "IMMEDIATE_REVIEW").when(percentile >= 0.95, "ELEVATED_REVIEW").when(score >= 20, "ROUTINE_REVIEW").otherwise("COMMON")
    return F.when(probability.isNotNull(), by_probability).otherwise(by_percentile)


def adjusted(base: Column, adjustment: Column, level: Column) -> Column:
    """A base weight with its context adjustment (within 8 either way) and 2 more from elevated review on; at least 1."""
    more = F.when(level.isin("ELEVATED_REVIEW", "IMMEDIATE_REVIEW", "EXTREME_OUTLIER"), 2).otherwise(0)
    return F.greatest(F.lit(1), base + F.least(F.greatest(adjustment, F.lit(-8)), F.lit(8)) + more)


def banded(score: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first band whose lower bound the score reaches."""
    out = F.when(score >= bands[0][0], bands[0][1])
    for least, name in bands[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(otherwise)


CONFIDENCE_BANDS = ((0.9, "Very High"), (0.75, "High"), (0.55, "Medium"), (0.35, "Low"))
RISK_BANDS = ((70, "High"), (35, "Medium"), (1, "Low"))
PRIORITY_BANDS = ((85, "CRITICAL"), (65, "HIGH"), (45, "MEDIUM"), (20, "LOW"))
MATCH_BANDS = ((0.9, "ACCEPTED_EXACT"), (0.72, "REVIEW_STRONG"), (0.45, "REVIEW_WEAK"))


def weighted_flags(flags: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The sum of the weights of true flags in the weights' order, held within 0 and 1."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.when(F.coalesce(flags[name], F.lit(False)), F.lit(float(weight))).otherwise(F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def explain_flags(flags: Mapping[str, Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()])), "; ")


def completeness(checks: Sequence[tuple[Column, float]]) -> Column:
    """The weighted share of checks that hold, 0 to 100."""
    total = sum(w for _, w in checks)
    got = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in checks), F.lit(0.0))
    return got / total * 100


def capped_sum(terms: Sequence[tuple[Column, float, float]], cap: float = 100.0) -> Column:
    """The sum over (value, most, weight) of weight * 100 * least(value, most) / most, at most ``cap``."""
    total = sum((F.least(v.cast("double"), F.lit(float(m))) / m * 100 * w for v, m, w in terms), F.lit(0.0))
    return F.least(total, F.lit(float(cap)))


def two_smallest_mean(values: Column) -> Column:
    """A careful compound of several scores: the mean of the two smallest (or of the one there is)."""
    least = F.slice(F.array_sort(F.filter(values, lambda x: x.isNotNull())), 1, 2)
    return F.when(F.size(least) > 0, F.aggregate(least, F.lit(0.0), lambda a, x: a + x) / F.size(least))


def binned(score: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the bin (edge, next edge] that holds the score; the last bin has no upper edge."""
    out = F.lit(None).cast("string")
    for low, label in zip(edges, labels, strict=True):
        out = F.when(score > low, F.lit(label)).otherwise(out)
    return out

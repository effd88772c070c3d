"""Sets of tokens that go as bar-separated text, and ordered merging of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Distinct tokens in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[|]"), lambda x: F.trim(x)), lambda x: x != ""))


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def has_token(c: Column, *wanted: str) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*[F.lit(w) for w in wanted]))


def merge_tokens(value: Column, order: Column) -> Column:
    """Aggregate: the union of all rows' tokens, by first appearance in the given order."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: tokens(x["v"]))
    return F.array_join(F.array_distinct(F.flatten(in_order)), "|")


def sorted_tokens(value: Column) -> Column:
    """Aggregate: distinct values, sorted, as bar-separated text."""
    return F.array_join(F.array_sort(F.collect_set(value)), "|")

"""Interactive filters as data: a list of conditions that apply to a frame, saved and replayed as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.sets import has_token

OPERATIONS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "at_least": lambda c, v: c.try_cast("double") >= F.lit(float(v)),
    "at_most": lambda c, v: c.try_cast("double") <= F.lit(float(v)),
    "contains": lambda c, v: F.lower(c.cast("string")).contains(str(v).lower()),
    "matches": lambda c, v: c.cast("string").rlike(f"(?i){v}"),
    "in": lambda c, v: c.isin(list(v)),
    "has_token": lambda c, v: has_token(c.cast("string"), *([v] if isinstance(v, str) else v)),
    "blank": lambda c, v: (F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "") == F.lit(bool(v)),
}


def apply_filters(df: DataFrame, conditions: Iterable[Mapping[str, object]]) -> DataFrame:
    """Rows that meet all of the conditions ({column, op, value}); conditions on None or "" values are off."""
    for c in conditions:
        if c.get("value") is None or c.get("value") == "":
            continue
        df = df.where(OPERATIONS[str(c["op"])](F.col(f"`{c['column']}`"), c["value"]))
    return df


def saved(conditions: Iterable[Mapping[str, object]]) -> str:
    return json.dumps(list(conditions), sort_keys=True)


def replay(df: DataFrame, text: str) -> DataFrame:
    return apply_filters(df, json.loads(text))


def page(df: DataFrame, order: Iterable, size: int, last: bool = False) -> DataFrame:
    """The first rows in an order, or the last ones."""
    keys = list(order)
    if last:
        keys = [F.desc(k) if isinstance(k, str) else k for k in keys]
    return df.orderBy(*keys).limit(size)

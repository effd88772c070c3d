"""Grouping rules as data: what is grouped, what is counted, and scores that a configuration may override.

A finding says how much is shared and what that scores; its members are rows of their own, so a key that very many records
share is no row of unbounded size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ("rule", "key", "n", "score", "level", "description", "evidence", "source_table")


@dataclass(frozen=True)
class Rule:
    """Groups ``table`` by ``key`` and counts rows, or distinct values of ``counted`` where there are some; more than ``threshold`` make a finding.

    The score is ``base`` and ``step`` for each beyond two, five at most; ``levels`` are (least score, name) in order.
    ``evidence`` is told with the count and the key.
    """

    name: str
    table: str
    key: str
    counted: str | None
    base: int
    step: int
    description: str
    evidence: str
    levels: tuple[tuple[int, str], ...] = ((25, "High"), (0, "Medium"))
    threshold: int = 1
    enabled: bool = True


#: The rules' names, scores and texts.
RULES = (
    Rule("shared_address_businesses", "business_entities", "address", None, 25, 5, "Multiple businesses sharing one address", "{n} businesses share address {key}"),
    Rule("shared_address_phones", "business_entities", "address", "phone", 20, 3, "Multiple phone numbers linked to one address", "{n} phone numbers appear at address {key}"),
    Rule("shared_address_websites", "business_entities", "address", "website", 10, 2, "Multiple websites linked to one address", "{n} websites appear at address {key}", ((15, "Medium"), (0, "Low"))),
    Rule("shared_phone_llcs", "business_entities", "phone", "llc_name", 20, 3, "Multiple LLCs sharing one phone", "{n} LLCs share phone {key}"),
    Rule("keyword_frequency", "known_patterns", "keyword", None, 25, 4, "Repeated maternity/postpartum/travel keywords", "Keyword '{key}' appears {n} times"),
)
PATTERN_RULE = Rule("known_pattern_addresses", "known_patterns", "address", None, 15, 0, "Addresses listed in known_patterns", "Known pattern keyword '{keyword}' linked to address {key}", ((15, "Medium"), (0, "Low")))


def configured(config: Mapping[str, Mapping[str, object]], rules: Sequence[Rule] = (*RULES, PATTERN_RULE)) -> list[Rule]:
    """The rules with what the configuration overrides: enabled, threshold, base_score, description. Rules that are off are left out."""
    if unknown := set(config) - {r.name for r in rules}:
        raise ValueError(f"no such rule: {sorted(unknown)}")
    out = []
    for rule in rules:
        said = config.get(rule.name, {})
        out.append(replace(rule, enabled=bool(said.get("enabled", rule.enabled)), threshold=int(said.get("threshold", rule.threshold)), base=int(said.get("base_score", rule.base)), description=str(said.get("description", rule.description))))
    return [r for r in out if r.enabled]


def _level(rule: Rule, score: Column) -> Column:
    return F.coalesce(*[F.when(score >= least, name) for least, name in rule.levels], F.lit(rule.levels[-1][1]))


def _told(text: str, **columns: Column) -> Column:
    out = F.lit(text)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def _rows(rule: Rule, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(key, value, record_id) of the rows that count."""
    rows = tables[rule.table]
    if rule.counted:
        rows = rows.where((F.coalesce(rule.counted, F.lit("")) != "") & (F.lit(True) if rule.key == "address" else F.coalesce(rule.key, F.lit("")) != ""))
    return rows.select(F.col(rule.key).alias("key"), (F.col(rule.counted) if rule.counted else F.lit(None).cast("string")).alias("value"), F.col("record_id").cast("string").alias("record_id"))


def _grouped(rule: Rule, tables: Mapping[str, DataFrame]) -> DataFrame:
    n = F.countDistinct("value") if rule.counted else F.count(F.lit(1))
    return _rows(rule, tables).groupBy("key").agg(n.alias("n")).where((F.col("n") > 1) & (F.col("n") >= rule.threshold + 1))


def _pattern_rows(rule: Rule, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(key, keyword, record_id): the addresses of businesses that a known pattern names."""
    named = tables["business_entities"].where(F.col("address").isNotNull()).select(F.col("business_name").alias("entity_name"), F.col("address").alias("key")).distinct()
    return tables["known_patterns"].join(named, "entity_name").select("key", "keyword", "entity_name", F.col("record_id").cast("string").alias("record_id")).distinct()


def findings(rules: Sequence[Rule], tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row of ``FINDING`` for each key that a rule finds; of known patterns one for each of their records."""
    out = None
    for rule in rules:
        if rule.name == PATTERN_RULE.name:
            rows = _pattern_rows(rule, tables).withColumn("n", F.lit(1).cast("long")).withColumn("score", F.lit(rule.base))
            evidence = _told(rule.evidence, keyword=F.col("keyword"), key=F.col("key"))
        else:
            rows = _grouped(rule, tables)
            rows = rows.withColumn("score", (F.lit(rule.base) + F.least(F.col("n") - 2, F.lit(5)) * rule.step).cast("int"))
            evidence = _told(rule.evidence, n=F.col("n"), key=F.col("key"))
        one = rows.select(F.lit(rule.name).alias("rule"), F.col("key").cast("string").alias("key"), "n", "score", _level(rule, F.col("score")).alias("level"), F.lit(rule.description).alias("description"), evidence.alias("evidence"), F.lit(rule.table).alias("source_table"))
        out = one if out is None else out.unionByName(one)
    return out


def members(rules: Sequence[Rule], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, key, record_id): the records behind each finding."""
    out = None
    for rule in rules:
        rows = _pattern_rows(rule, tables) if rule.name == PATTERN_RULE.name else _rows(rule, tables).join(_grouped(rule, tables).select(F.col("key").alias("found")), F.col("key").eqNullSafe(F.col("found")), "left_semi")
        one = rows.select(F.lit(rule.name).alias("rule"), F.col("key").cast("string").alias("key"), "record_id")
        out = one if out is None else out.unionByName(one)
    return out


def mentions(found: DataFrame) -> DataFrame:
    """(record_id, mentions): how often records are behind findings."""
    return found.groupBy("record_id").agg(F.count(F.lit(1)).alias("mentions"))

"""Readers of CSV and JSON files: tolerant scans, header aliases, envelopes, validation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairnlake.functions.text import first_filled


class ValidationError(ValueError):
    """A source that lacks what it has to have."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything in whatever file system it names."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """A CSV file or folder as text columns; a missing one is an empty frame of ``columns``, and missing columns are blank."""
    if not exists(spark, path):
        return spark.createDataFrame([], text_schema(columns))
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return with_columns(df, columns)


def with_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds the columns that are missing, blank."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit("") for c in missing}) if missing else df


def trimmed(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """All cells stripped, nulls blank; rows whose required cells are all blank go."""
    out = df.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in df.columns])
    if not required:
        return out
    return out.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`") != "" for c in required]))


def validate(df: DataFrame, required: Sequence[str], least_rows: int = 1) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValidationError(f"missing columns: {', '.join(missing)}")
    if least_rows and df.limit(least_rows).count() < least_rows:
        raise ValidationError(f"fewer than {least_rows} rows")
    return df


def bare_header(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def canonical_headers(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per canonical field: the first filled of the source columns that its aliases name."""
    by_bare: dict[str, str] = {}
    for c in df.columns:
        by_bare.setdefault(bare_header(c), c)
    out = {}
    for field, names in aliases.items():
        found = [by_bare[bare_header(n)] for n in (field, *names) if bare_header(n) in by_bare]
        out[field] = F.coalesce(first_filled(*[F.col(f"`{c}`") for c in dict.fromkeys(found)]), F.lit("")) if found else F.lit("")
    return df.select(*[v.alias(k) for k, v in out.items()])


def read_envelopes(spark: SparkSession, path: str, record: StructType, names: Sequence[str] = ("filings", "results", "data", "items", "records", "features")) -> DataFrame:
    """Records of JSON files that are a list, one record, or an envelope with the list under one of ``names`` or under result.*.

    Each file is one value, as API pages are; the records of all files are one frame.
    """
    text = spark.read.option("wholetext", True).text(path)
    many = f"array<{record.simpleString()}>"
    lists = [F.from_json("value", many)]
    for prefix in ("$", "$.result"):
        lists += [F.from_json(F.get_json_object("value", f"{prefix}.{n}"), many) for n in names]
    single = F.array(F.from_json("value", record))
    is_list = F.trim("value").startswith("[")
    found = F.when(is_list, lists[0]).otherwise(F.coalesce(*lists[1:], single))
    return text.select(F.explode(found).alias("r")).select("r.*")


def project(df: DataFrame, field_map: Mapping[str, str | Sequence[str]], sep: str = ", ") -> DataFrame:
    """Canonical fields from source columns (dots reach into structs); several columns join, blanks left out."""

    def value(spec: str | Sequence[str]) -> Column:
        if isinstance(spec, str):
            return F.coalesce(F.col(spec).cast("string"), F.lit(""))
        parts = F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in spec])
        return F.array_join(F.filter(parts, lambda x: x != ""), sep)

    return df.select(*[value(spec).alias(field) for field, spec in field_map.items()])


def inspect(df: DataFrame, rows: int = 5) -> dict:
    """Fields with their types, and some rows."""
    return {"fields": [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "sample": [r.asDict(recursive=True) for r in df.limit(rows).collect()]}

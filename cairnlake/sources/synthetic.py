"""A seeded generator of source tables with planted clusters, as columns over ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(seed: int, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n))


def businesses(spark: SparkSession, records: int, seed: int = 42, clusters: int = 5, cluster_size: int = 4) -> DataFrame:
    """Rows whose first ``clusters * cluster_size`` share an address, phone and website per cluster."""
    cluster = F.when(F.col("id") < clusters * cluster_size, F.floor(F.col("id") / cluster_size))
    own = lambda text, salt, n: F.concat(F.lit(text), F.coalesce(cluster, pick(seed, salt, n) + 1000).cast("string"))
    return spark.range(records).select(
        F.concat(F.lit("B"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("record_id"),
        F.concat(F.lit("Company "), F.col("id").cast("string"), F.element_at(F.array(F.lit(" LLC"), F.lit(" Inc"), F.lit("")), (pick(seed, "form", 3) + 1).cast("int"))).alias("business_name"),
        F.concat(own("", "street", 5000), F.lit(" Main Street, Miami, FL 33101")).alias("address"),
        F.concat(F.lit("305555"), F.lpad(F.coalesce(cluster, pick(seed, "phone", 9000) + 1000).cast("string"), 4, "0")).alias("phone"),
        F.concat(own("https://www.site", "web", 5000), F.lit(".example.com/")).alias("website"),
        F.lit("synthetic").alias("source_type"),
    )

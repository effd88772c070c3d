"""Peer statistics and rolling windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import scores
from cairnlake.operators import stats
from cairnlake.plans.registry import Registry
from cairnlake.sources.tables import table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_PER_CUSTOMER = "per AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"


def _per_customer(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(counts, "c_custkey", "left").na.fill(0, ["n"])


@R.query(f"WITH {_PER_CUSTOMER} SELECT c_custkey, c_nationkey, n, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY n), 4)::DOUBLE AS percentile FROM per")
def peer_percentile(spark, sf_dir):
    return stats.with_percentile(_per_customer(spark, sf_dir), ["c_nationkey"], "n")


@R.query(f"""WITH {_PER_CUSTOMER}
SELECT c_nationkey, count(*) AS peers, round(avg(n), 4)::DOUBLE AS mean, quantile_cont(n::DOUBLE, 0.5) AS median, quantile_cont(n::DOUBLE, 0.9) AS p90, max(n)::DOUBLE AS largest, min(n)::DOUBLE AS smallest,
  CASE WHEN count(*) >= 5 THEN 'OK' ELSE 'INSUFFICIENT_BASELINE' END AS status FROM per GROUP BY c_nationkey""")
def peer_baseline(spark, sf_dir):
    return stats.baselines(_per_customer(spark, sf_dir), ["c_nationkey"], "n")


@R.query("""
WITH c AS (SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT l.l_returnflag, median(abs(l.l_quantity - c.med)) AS mad FROM lineitem l JOIN c USING (l_returnflag) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
  round(CASE WHEN mad <> 0 THEN 0.6745::DOUBLE * (l_quantity - med) / mad END, 6)::DOUBLE AS robust_z, round(CASE WHEN n >= 4 AND q3 > q1 THEN (l_quantity - q3) / (q3 - q1) END, 6)::DOUBLE AS iqr_score
FROM lineitem JOIN c USING (l_returnflag) JOIN m USING (l_returnflag)""")
def robust_z(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    out = stats.robust_scores(rows, ["l_returnflag"], "l_quantity")
    return out.withColumns({c: F.round(c, 6) for c in ("robust_z", "iqr_score")})


@R.query("""
WITH w AS (SELECT user_id,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 345599999999 PRECEDING AND CURRENT ROW) AS p3,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 691199999999 PRECEDING AND CURRENT ROW) AS p7,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 2678399999999 PRECEDING AND CURRENT ROW) AS p30,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7862399999999 PRECEDING AND CURRENT ROW) AS p90,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 31622399999999 PRECEDING AND CURRENT ROW) AS p365
  FROM events)
SELECT user_id, max(p3) AS peak_3, max(p7) AS peak_7, max(p30) AS peak_30, max(p90) AS peak_90, max(p365) AS peak_365 FROM w GROUP BY user_id""")
def rolling_peak(spark, sf_dir):
    return stats.rolling_peaks(table(spark, sf_dir, "events"), "user_id", "ts", (3, 7, 30, 90, 365))


_TAIL = "round(greatest(0::DOUBLE, 1 - coalesce((SELECT sum(exp(-expected + v * ln(expected) - lgamma(v + 1))) FROM range(n) t(v)), 0)), 6)::DOUBLE"


@R.query(f"""WITH {_PER_CUSTOMER}, e AS (SELECT c_nationkey, avg(n) AS expected FROM per GROUP BY 1)
SELECT c_custkey, c_nationkey, n, {_TAIL} AS probability FROM per JOIN e USING (c_nationkey)""")
def poisson_tail(spark, sf_dir):
    rows = _per_customer(spark, sf_dir)
    means = rows.groupBy("c_nationkey").agg(F.avg("n").alias("expected"))
    return rows.join(means, "c_nationkey").select("c_custkey", "c_nationkey", "n", F.round(scores.poisson_at_least(F.col("n"), F.col("expected")), 6).alias("probability"))


@R.query(f"""WITH {_PER_CUSTOMER}, e AS (SELECT c_nationkey, avg(n) AS expected FROM per GROUP BY 1),
p AS (SELECT c_custkey, c_nationkey, n, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY n), 4) AS percentile, {_TAIL} AS probability FROM per JOIN e USING (c_nationkey)),
l AS (SELECT *, CASE WHEN probability <= 0.001 THEN 'EXTREME_OUTLIER' WHEN probability <= 0.01 THEN 'IMMEDIATE_REVIEW' WHEN probability <= 0.05 THEN 'ELEVATED_REVIEW' WHEN probability <= 0.15 THEN 'ROUTINE_REVIEW' ELSE 'COMMON' END AS level FROM p)
SELECT c_custkey, percentile::DOUBLE AS percentile, level, greatest(1, 18 + CASE WHEN n > 15 THEN 4 WHEN n < 5 THEN -6 ELSE 0 END + CASE WHEN level IN ('ELEVATED_REVIEW', 'IMMEDIATE_REVIEW', 'EXTREME_OUTLIER') THEN 2 ELSE 0 END)::INT AS adjusted FROM l""")
def rarity_level(spark, sf_dir):
    rows = stats.rarity_view(_per_customer(spark, sf_dir), ["c_nationkey"], "n")
    context = F.when(F.col("n") > 15, 4).when(F.col("n") < 5, -6).otherwise(0)
    return rows.select("c_custkey", "percentile", "level", scores.adjusted(F.lit(18), context, F.col("level")).cast("int").alias("adjusted"))


@R.query("""
WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT day, event_type, n, round(total, 4)::DOUBLE AS total FROM d""")
def events_per_day(spark, sf_dir):
    day = F.date_trunc("day", "ts").alias("day")
    return table(spark, sf_dir, "events").groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

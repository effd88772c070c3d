"""Runs that go on from earlier ones: resolution after a change, and stages that are taken where they are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import refresh, stages
from cairnlake.plans import entity_queries
from cairnlake.plans.registry import Registry
from cairnlake.sources.scratch import scratch_path

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.query(entity_queries.ORACLE_SQL["resolved_entities"])
def refreshed_entities(spark, sf_dir):
    """What ``resolved_entities`` gives, from a run that lacked a tenth of the people and another after they came."""
    people, phones, edges = entity_queries.people_and_phones(spark, sf_dir)
    late = F.crc32(F.col("entity_id").cast("binary")) % 10 == 0
    before = refresh.first_run(people.where(~late).unionByName(phones), edges.join(people.where(late).select(F.col("entity_id").alias("src")), "src", "left_anti"))
    after, _ = refresh.refresh(before, people.unionByName(phones), edges)
    sizes = after.labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return after.labels.join(sizes, "cluster").where(F.col("entity_id").startswith("x:")).select("entity_id", "cluster", (F.col("n") > 1).alias("merged"))


@R.query("""WITH n AS (SELECT count(*) AS orders FROM orders), c AS (SELECT count(DISTINCT o_custkey) AS customers FROM orders), big AS (SELECT count(*) AS big FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12))
SELECT 'first' AS run, 0 AS nth, 'spent' AS stage, 'PASS' AS status, customers AS rows FROM c UNION ALL SELECT 'first', 1, 'large', 'PASS', big FROM big
UNION ALL SELECT 'second', 0, 'spent', 'REUSED', customers FROM c UNION ALL SELECT 'second', 1, 'large', 'REUSED', big FROM big UNION ALL SELECT 'second', 2, 'counted', 'PASS', 1""")
def stage_profile(spark, sf_dir):
    """Two stages over the orders, and a second run that takes them and adds a third."""
    folder, orders = scratch_path(spark, "stages"), f"{sf_dir}/orders.parquet"
    spent = lambda rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
    for run in ("first", "second"):
        s = stages.Stages(spark, folder, run)
        one = s.stage("spent", spent, [orders])
        two = s.stage("large", lambda rows, least: rows.where(F.col("n") > least), after=[one], params={"least": 12})
        if run == "second":
            s.stage("counted", lambda rows: rows.agg(F.count(F.lit(1)).alias("n")), after=[two])
    return stages.Stages.profiles(spark, folder).select("run", "nth", "stage", "status", "rows")

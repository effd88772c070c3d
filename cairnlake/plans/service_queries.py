"""Rows that come through a paged service, its snapshots and a bulk file; all are made from a table first."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import parsing
from cairnlake.operators import stats
from cairnlake.plans.registry import Registry
from cairnlake.sources import bulk, paged
from cairnlake.sources.scratch import scratch_path, stored
from cairnlake.sources.tables import table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
PAGE = 500
#: Rows of a bulk file before another begins.
FILE_ROWS = 10_000


def _kept_pages(spark, sf_dir):
    """Customers by key on pages of ``PAGE``; each page but the last also has the first customer of the next."""
    rows = stats.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"], "at")
    own = rows.withColumn("page", ((F.col("at") - 1) / (PAGE - 1)).cast("int"))
    again = own.where((F.col("page") > 0) & ((F.col("at") - 1) % (PAGE - 1) == 0)).withColumn("page", F.col("page") - 1)
    folder = scratch_path(spark, "service")
    record = F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("value")
    own.unionByName(again).repartition("page").sortWithinPartitions("page", "at").select("page", record).write.partitionBy("page").text(folder)
    return folder, rows.count()


@R.query(f"""SELECT c_custkey, c_name, c_nationkey, (nth // {PAGE - 1} - CASE WHEN nth > 0 AND nth % {PAGE - 1} = 0 THEN 1 ELSE 0 END)::INT AS page
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS nth FROM customer)""")
def service_snapshots(spark, sf_dir):
    """The pages of a service read in tasks, kept as a snapshot, and the snapshot read back."""
    folder, n = _kept_pages(spark, sf_dir)
    got = paged.read_pages(spark, "c_custkey", fetch="cairnlake.sources.paged:kept_pages", chains=[{"folder": folder}], page_size=PAGE, max_pages=n // (PAGE - 1) + 2, run=4)
    kept = scratch_path(spark, "snapshots")
    paged.write_snapshot(got.records, kept, "first")
    said = paged.read_snapshot(spark, kept, "first").select("page", F.from_json("record", "c_custkey long, c_name string, c_nationkey int").alias("r"))
    return said.select("r.*", "page")


@R.query(f"""WITH n AS (SELECT count(*) AS n FROM customer)
SELECT pages::BIGINT AS pages, n + pages - 1 AS read, pages - 1 AS repeats, least(n, 1200)::BIGINT AS records, n > 1200 AS truncated FROM (SELECT n, ((n - 1) // {PAGE - 1} + 1) AS pages FROM n)""")
def service_report(spark, sf_dir):
    """The same service, asked by token, with a bound on records."""
    folder, n = _kept_pages(spark, sf_dir)
    return paged.read_pages(spark, "c_custkey", 1200, fetch="cairnlake.sources.paged:kept_pages", mode="token", chains=[{"folder": folder}], page_size=PAGE, max_pages=n // (PAGE - 1) + 2).report


#: Providers by customer: every seventh row is of the provider before, states and kinds go round.
_BULK = """SELECT c_custkey, 1000000000 + c_custkey - CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS npi, CASE WHEN c_nationkey % 2 = 0 THEN '2' ELSE '1' END AS kind, c_name AS name, CASE WHEN c_nationkey % 3 = 0 THEN 'FL' ELSE 'GA' END AS state,
  CASE c_custkey % 5 WHEN 0 THEN '' ELSE '336' || lpad(cast(c_custkey % 100 AS string), 2, '0') END AS zip, CASE WHEN c_custkey % 11 = 0 THEN '2024-01-01' ELSE '' END AS closed, c_mktsegment AS segment FROM {customer}"""


def _bulk_file(spark, sf_dir):
    made = spark.sql(_BULK, customer=table(spark, sf_dir, "customer"))
    blank, said = F.lit(""), lambda c: F.col(c).cast("string")
    columns = {bulk.NUMBER: said("npi"), bulk.KIND: said("kind"), bulk.FIRM: F.when(F.col("kind") == "2", F.col("name")).otherwise(blank), bulk.FIRST: F.when(F.col("kind") == "1", "Ann").otherwise(blank), bulk.LAST: F.when(F.col("kind") == "1", F.col("name")).otherwise(blank), bulk.CLOSED: F.col("closed"), bulk.TAXONOMY: F.upper(F.substring("segment", 1, 4)), bulk.TAXONOMY_TEXT: F.col("segment")}
    for purpose in (bulk.MAILING, bulk.PRACTICE):
        columns |= {f"{purpose} {p}": v for p, v in zip(bulk.PARTS, (F.concat(said("c_custkey"), F.lit(" Main St")), blank, F.lit("Tampa"), F.col("state"), F.col("zip")), strict=True)}
    path = scratch_path(spark, "bulk")
    # Files in the order of their names, as ``read_bulk`` takes them; a range of keys each, so no task holds the whole.
    n = 1 + made.count() // FILE_ROWS
    made.repartitionByRange(n, "c_custkey").sortWithinPartitions("c_custkey").select(*[v.alias(k) for k, v in columns.items()]).write.option("header", True).option("emptyValue", "").csv(path)
    return path


@R.query(f"""WITH m AS ({_BULK.format(customer="customer")}), kept AS (SELECT * FROM m WHERE state = 'FL' AND zip LIKE '336%' AND closed = '')
SELECT npi::VARCHAR AS npi, arg_max(kind, c_custkey) AS kind, arg_max(CASE kind WHEN '2' THEN name ELSE 'Ann ' || name END, c_custkey) AS name, arg_max(segment, c_custkey) AS taxonomy FROM kept GROUP BY npi""")
def bulk_providers(spark, sf_dir):
    """Of a bulk file, the active providers of one state and postal area; the last row of each."""
    got = bulk.read_bulk(spark, _bulk_file(spark, sf_dir), {"state": "fl", "postal_prefix": "336", "active_only": True})
    return got.providers.select("npi", "kind", "name", "taxonomy")


@R.query(f"""WITH m AS ({_BULK.format(customer="customer")}), kept AS (SELECT * FROM m ORDER BY c_custkey LIMIT 1000), last AS (SELECT npi, arg_max(kind, c_custkey) AS kind, arg_max(closed, c_custkey) AS closed FROM kept GROUP BY npi)
SELECT count(*) AS providers, count(*) FILTER (kind = '1') AS persons, count(*) FILTER (kind = '2') AS organizations, count(*) AS practice_addresses, count(*) AS mailing_addresses, count(*) AS taxonomies, count(*) FILTER (closed <> '') AS deactivated, 0::BIGINT AS incomplete,
  (SELECT count(*) FROM kept) AS matched, (SELECT count(*) FROM kept) - count(*) AS repeats, (SELECT count(*) FROM kept) >= 1000 AS truncated FROM last""")
def bulk_report(spark, sf_dir):
    """Counts of the first 1,000 rows of a bulk file, which is the bound that its reader was given."""
    return bulk.read_bulk(spark, _bulk_file(spark, sf_dir), {}, 1000).report


@R.query(f"""WITH m AS ({_BULK.format(customer="customer")}), last AS (SELECT npi, arg_max(kind, c_custkey) AS kind, arg_max(segment, c_custkey) AS segment FROM m GROUP BY npi)
SELECT 'provider:nppes:' || npi AS src, 'address:nppes:' || npi || ':practice:1' AS dst, 'PROVIDER_PRACTICES_AT' AS kind FROM last
UNION ALL SELECT 'provider:nppes:' || npi, 'address:nppes:' || npi || ':mailing:1', 'PROVIDER_MAILS_TO' FROM last
UNION ALL SELECT 'provider:nppes:' || npi, 'taxonomy:nppes:' || upper(substr(segment, 1, 4)), 'PROVIDER_HAS_TAXONOMY' FROM last""")
def bulk_provider_edges(spark, sf_dir):
    return bulk.bulk_edges(bulk.read_bulk(spark, _bulk_file(spark, sf_dir)).providers).select("src", "dst", "kind")


#: Filings by customer: every sixth lacks its number, every ninth is that of the customer before; two officers, of which every fourth filing has the same one twice.
_FILING_SQL = """WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'L' || (c_custkey - CASE WHEN c_custkey % 9 = 1 AND c_custkey > 1 AND (c_custkey - 1) % 6 <> 0 THEN 1 ELSE 0 END) END AS number, c_name, c_custkey % 4 = 0 AS twice FROM customer),
kept AS (SELECT * FROM m WHERE number = '' UNION ALL SELECT * FROM m WHERE number <> '' QUALIFY row_number() OVER (PARTITION BY number ORDER BY k) = 1)"""


def _filings(spark, sf_dir):
    """Written as JSON lines, as a service would send them, and read back with the schema of filings."""
    key = F.col("c_custkey")
    before = F.when((key % 9 == 1) & (key > 1) & ((key - 1) % 6 != 0), 1).otherwise(0)
    number = F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("L"), (key - before).cast("string")))
    person = lambda name, title: F.struct(name.alias("name"), F.lit(title).alias("title"), F.lit("").alias("officer_type"), F.lit("").alias("position"), F.lit("").alias("address"))
    first, second = person(F.concat(F.lit("Ann Lee"), key.cast("string")), "MGR"), person(F.concat(F.lit("Bo Wu"), key.cast("string")), "CEO")
    rows = table(spark, sf_dir, "customer").select(
        number.alias("corporation_number"), F.col("c_name").alias("corporation_name"), F.lit("ACTIVE").alias("status"), F.lpad(key.cast("string"), 12, "0").alias("file_date"), F.concat(key.cast("string"), F.lit(" Main Street")).alias("principal_address"), F.lit("").alias("mailing_address"),
        F.struct(F.concat(F.lit("Agent "), (key % 50).cast("string")).alias("name"), F.lit("PO Box 9").alias("address")).alias("registered_agent"), F.when(key % 4 == 0, F.array(second, first, first)).otherwise(F.array(first, second)).alias("officers"),
    )
    path = scratch_path(spark, "filings")
    rows.write.json(path)
    return parsing.filings(spark.read.schema(parsing.FILING).json(path))


@R.query(f"""{_FILING_SQL} SELECT number AS corporation_number, c_name AS corporation_name, k || ' MAIN ST' AS principal_address, 'Agent ' || (k % 50) AS agent, CASE WHEN twice THEN 3 ELSE 2 END AS officers, number = '' AS incomplete, CASE WHEN number = '' THEN 'corporation_number' ELSE '' END AS missing FROM kept""")
def filing_rows(spark, sf_dir):
    return _filings(spark, sf_dir).select("corporation_number", "corporation_name", "principal_address", "agent", F.size("officers").alias("officers"), "incomplete", "missing")


_FINGERPRINT = "substr(sha256({name} || '|{title}||||' || {said}), 1, 16)"
_ANN = _FINGERPRINT.format(name="'ANN LEE' || k", title="MGR", said="'Ann Lee' || k")
_BO = _FINGERPRINT.format(name="'BO WU' || k", title="CEO", said="'Bo Wu' || k")


@R.query(f"""{_FILING_SQL}, numbered AS (SELECT * FROM kept WHERE number <> '')
SELECT number AS corporation_number, 'person:sunbiz_daily:' || number || ':officer:' || {_ANN} || ':1' AS officer_id, 'Ann Lee' || k AS name, 1::BIGINT AS nth FROM numbered
UNION ALL SELECT number, 'person:sunbiz_daily:' || number || ':officer:' || {_ANN} || ':2', 'Ann Lee' || k, 2 FROM numbered WHERE twice
UNION ALL SELECT number, 'person:sunbiz_daily:' || number || ':officer:' || {_BO} || ':1', 'Bo Wu' || k, 1 FROM numbered""")
def filing_officers(spark, sf_dir):
    return parsing.officers(_filings(spark, sf_dir)).select("corporation_number", "officer_id", "name", "nth")


@R.query(f"""{_FILING_SQL}, numbered AS (SELECT * FROM kept WHERE number <> ''), n AS (SELECT count(*) AS n, count(*) FILTER (twice) AS t FROM numbered)
SELECT unnest(['BUSINESS_PRINCIPAL_ADDRESS', 'BUSINESS_LOCATED_AT', 'REGISTERED_AGENT_FOR', 'REGISTERED_AGENT_ASSOCIATED_WITH_ADDRESS', 'REGISTERED_AGENT_AT_ADDRESS', 'OFFICER_OF']) AS kind, unnest([n, n, n, n, n, 2 * n + t]) AS edges, unnest([n, n, n, n, n, 2 * n + t]) AS starts, unnest([n, n, n, 1, 1, n]) AS ends FROM n""")
def filing_edge_kinds(spark, sf_dir):
    """The edges of all filings by kind; every end is an entity."""
    flat = stored(_filings(spark, sf_dir), "filings")
    known = stored(parsing.filing_entities(flat).select("entity_id"), "filing-entities")
    of = lambda end: known.withColumnRenamed("entity_id", end)
    tied = parsing.filing_edges(flat).join(of("src"), "src", "left_semi").join(of("dst"), "dst", "left_semi")
    return tied.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("starts"), F.countDistinct("dst").alias("ends"))

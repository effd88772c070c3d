"""Normalisers, stable ids, blocking, pair decisions, cross-source matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions import parsing as P
from cairnlake.functions import text as X
from cairnlake.functions.sets import sorted_tokens
from cairnlake.operators import correlation, cross_source, markers, resolution, similarity
from cairnlake.plans.registry import Registry
from cairnlake.sources.scratch import stored
from cairnlake.sources.tables import GRAPH_SQL, edges, entities, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.query(r"""
SELECT doc_id, lower(email) AS email, regexp_extract(lower(email), '@(.*)$', 1) AS domain
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS email FROM documents)""")
def email_extract(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", F.explode(found).alias("email")).select("doc_id", X.email_address(F.col("email")).alias("email"))
    return rows.where("email IS NOT NULL").withColumn("domain", X.email_domain(F.col("email")))


@R.query(r"""
SELECT doc_id, regexp_replace(p, '\D', '', 'g') AS phone FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\(\d{3}\) \d{3}-\d{4}')) AS p FROM documents)""")
def phone_normalize(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"(\(\d{3}\) \d{3}-\d{4})"), F.lit(1))
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("(")).select("doc_id", F.explode(found).alias("p"))
    return rows.select("doc_id", X.phone_digits(F.col("p")).alias("phone"))


@R.query(r"""
WITH u AS (SELECT page_id, lower(trim(url)) AS url FROM pages),
p AS (SELECT page_id, regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#]*)', 1) AS host, regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, nullif(host || rtrim(path, '/'), '') AS website, host FROM p""")
def website_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.website_key(F.col("url")).alias("website"), X.website_host(F.col("url")).alias("host"))


@R.query(r"""
WITH n AS (SELECT p_partkey, upper(p_name) || CASE p_partkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' L.L.C.' WHEN 2 THEN ' Company' ELSE '' END AS raw FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(raw), '[^\w\s#/@\-]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM n)
SELECT p_partkey, trim(regexp_replace(' ' || clean, '( (L L C|LLC|INCORPORATED|INC|CORPORATION|CORP|LIMITED|LTD|L P|LP|COMPANY|CO))+$', '')) AS name FROM c""")
def business_name_normalize(spark, sf_dir):
    form = F.when(F.col("p_partkey") % 4 == 0, ", Inc.").when(F.col("p_partkey") % 4 == 1, " L.L.C.").when(F.col("p_partkey") % 4 == 2, " Company").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", X.business_name(F.concat("p_name", form)).alias("name"))


#: Addresses in several wordings: (form of the street, unit, city and zip), by key.
_RAW_ADDRESS = """c_custkey || CASE c_custkey % 4 WHEN 0 THEN ' North Main Street' WHEN 1 THEN ' N. MAIN ST' WHEN 2 THEN ' northwest 5th Avenue' ELSE ' Old State Highway' END
  || CASE c_custkey % 3 WHEN 0 THEN ', Apt. ' || (c_custkey % 9) WHEN 1 THEN ' #' || (c_custkey % 9) || 'B' ELSE '' END || CASE c_custkey % 2 WHEN 0 THEN ', Miami, FL 33101-1234' ELSE ' Miami FL 33' || (100 + c_custkey % 50) END"""


def _raw_addresses(spark, sf_dir):
    return spark.sql(f"SELECT c_custkey, {_RAW_ADDRESS} AS raw FROM {{customer}}", customer=table(spark, sf_dir, "customer"))


_WORDS_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in {**X.DIRECTIONS, **X.STREETS}.items())


@R.query(rf"""
WITH t AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(upper({_RAW_ADDRESS}), '[^\w\s#/@\-]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM customer),
u AS (SELECT *, nullif(regexp_extract(text, '(?:\b(?:APT|APARTMENT|UNIT|STE|SUITE)\b|#)\s*([A-Z0-9\-]+)', 1), '') AS unit, regexp_replace(text, '(?:\b(?:APT|APARTMENT|UNIT|STE|SUITE)\b|#)\s*([A-Z0-9\-]+)', ' ') AS bare FROM t),
w AS (SELECT *, [x FOR x IN string_split(bare, ' ') IF x <> ''] AS words FROM u),
b AS (SELECT *, array_to_string([CASE x {_WORDS_SQL} ELSE x END FOR x IN words], ' ') AS building, [substr(regexp_replace(x, '\D', '', 'g'), 1, 5) FOR x IN words IF length(regexp_replace(x, '\D', '', 'g')) >= 5][-1] AS zip FROM w)
SELECT c_custkey, building, unit, zip, CASE WHEN regexp_matches(words[1], '^\d+$') THEN words[1] END AS house_number, building || CASE WHEN unit IS NULL THEN '' ELSE ' UNIT ' || unit END AS address FROM b""")
def address_normalize(spark, sf_dir):
    rows = _raw_addresses(spark, sf_dir).select("c_custkey", X.address_key(F.col("raw")).alias("a"))
    return rows.select("c_custkey", "a.building", "a.unit", "a.zip", "a.house_number", F.col("a.text").alias("address"))


_LINE_WORDS_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in {**X.DIRECTIONS, **X.STREETS, **X.UNIT_WORDS}.items())


@R.query(rf"""
WITH t AS (SELECT c_custkey, regexp_replace(regexp_replace(replace(upper({_RAW_ADDRESS}), '.', ' '), '\s*,\s*', ', ', 'g'), '\b([A-Z]+)\s+HIGHWAY\b', '\1 HWY', 'g') AS text FROM customer),
u AS (SELECT c_custkey, regexp_replace(regexp_replace(text, '\b#\s*([A-Z0-9\-]+)\b', ' UNIT \1', 'g'), '[^A-Z0-9,\-#/ ]', ' ', 'g') AS text FROM t),
w AS (SELECT c_custkey, [x FOR x IN string_split(replace(text, ',', ' , '), ' ') IF x <> ''] AS words FROM u)
SELECT c_custkey, trim(regexp_replace(regexp_replace(array_to_string([CASE x {_LINE_WORDS_SQL} ELSE x END FOR x IN words], ' '), '\s*,\s*', ', ', 'g'), '\b(\d{{5}})-\d{{4}}\b', '\1', 'g'), ' ,') AS line FROM w""")
def address_lines(spark, sf_dir):
    return _raw_addresses(spark, sf_dir).select("c_custkey", X.address_line(F.col("raw")).alias("line"))


_MIXED = """CASE c_custkey % 7 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' WHEN 2 THEN 'website' WHEN 3 THEN 'business' WHEN 4 THEN 'owner' WHEN 5 THEN 'person' ELSE 'property' END AS kind,
  CASE c_custkey % 7 WHEN 0 THEN '+1 (305) 555-' || (1000 + c_custkey % 9000) || CASE WHEN c_custkey % 2 = 0 THEN ' ext 7' ELSE '' END WHEN 1 THEN ' Mail.' || c_custkey || '@Example.COM ' WHEN 2 THEN 'HTTPS://www.Site' || c_custkey || '.com:8080/A/b/?q=1' WHEN 3 THEN 'Acme ' || c_custkey || ', L.L.C. Co.'
    WHEN 4 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Bolt ' || c_custkey || ' Inc.' ELSE 'Dr. Ann Q' || c_custkey || ' Lee, MD, JR' END WHEN 5 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Cher' || c_custkey ELSE 'John X' || c_custkey || ' Public III' END ELSE 'lot' END AS display, 'parcel:0' || c_custkey || '-a' AS entity_id"""


@R.query(rf"""
WITH m AS (SELECT c_custkey, {_MIXED} FROM customer), c AS (SELECT *, trim(regexp_replace(regexp_replace(upper(display), '[^\w\s#/@\-]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM m),
w AS (SELECT *, string_split(clean, ' ') AS ws FROM c),
p AS (SELECT *, [x FOR x IN (CASE WHEN ws[-1] IN ('JR', 'SR', 'II', 'III', 'IV', 'V') THEN ws[:-2] ELSE ws END) IF x NOT IN ('MD', 'DO', 'DDS', 'DMD', 'PA', 'NP', 'RN', 'ESQ', 'CPA', 'JD')] AS name FROM w)
SELECT c_custkey, kind, CASE kind
  WHEN 'phone' THEN right(regexp_replace(regexp_replace(display, ' ext.*$', ''), '\D', '', 'g'), 10) || CASE WHEN display LIKE '%ext%' THEN 'X7' ELSE '' END WHEN 'email' THEN lower(trim(display))
  WHEN 'website' THEN rtrim(regexp_extract(lower(display), '^https://www\.([^?]*)', 1), '/') WHEN 'property' THEN '0' || c_custkey || 'A'
  WHEN 'person' THEN name[1] || ' ' || name[-1] WHEN 'owner' THEN CASE WHEN list_contains(ws, 'INC') THEN regexp_replace(clean, '( (LLC|L L C|INC|CO))+$', '') ELSE name[1] || ' ' || name[-1] END
  ELSE regexp_replace(clean, '( (LLC|L L C|INC|CO))+$', '') END AS value FROM p""")
def normalized_values(spark, sf_dir):
    rows = spark.sql(f"SELECT c_custkey, {_MIXED} FROM {{customer}}", customer=table(spark, sf_dir, "customer"))
    return rows.select("c_custkey", "kind", X.normalized(F.col("kind"), F.col("display"), F.col("entity_id"))["value"].alias("value"))


@R.query("""
WITH a AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'PO Box ' || c_custkey WHEN 1 THEN c_custkey || ' City Hall Sq' WHEN 2 THEN c_custkey || ' Oak Rd Apt ' || (c_custkey % 9) WHEN 3 THEN c_custkey || ' Harbor Plaza' WHEN 4 THEN c_custkey || ' Elm Rd' ELSE '' END AS address FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'VIRTUAL_OFFICE_OR_MAILBOX' WHEN 1 THEN 'GOVERNMENT_FACILITY' WHEN 2 THEN 'EXACT_APARTMENT_OR_UNIT' WHEN 3 THEN 'COMMERCIAL_PROPERTY' ELSE 'UNKNOWN' END AS context,
  CASE c_custkey % 6 WHEN 2 THEN c_custkey || ' OAK RD' ELSE upper(address) END AS building, CASE c_custkey % 6 WHEN 2 THEN 'APT ' || (c_custkey % 9) ELSE '' END AS unit, CASE c_custkey % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 WHEN 3 THEN 0.7 WHEN 4 THEN 0.35 ELSE 0.0 END::DOUBLE AS confidence FROM a""")
def address_contexts(spark, sf_dir):
    form = "CASE c_custkey % 6 WHEN 0 THEN 'PO Box ' || c_custkey WHEN 1 THEN c_custkey || ' City Hall Sq' WHEN 2 THEN c_custkey || ' Oak Rd Apt ' || (c_custkey % 9) WHEN 3 THEN c_custkey || ' Harbor Plaza' WHEN 4 THEN c_custkey || ' Elm Rd' ELSE '' END"
    return table(spark, sf_dir, "customer").select("c_custkey", X.address_context(F.expr(form)).alias("c")).select("c_custkey", "c.*")


@R.query("SELECT s_suppkey, 'canonical:business:' || substr(sha1('business|' || s_name), 1, 16) AS canonical_id FROM supplier")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.stable_id("canonical:business", F.lit("business"), F.col("s_name")).alias("canonical_id"))


_BLOCKS = """
pairs AS (
  SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, a.p_brand = b.p_brand AS same_brand, a.p_type = b.p_type AS same_type FROM part a JOIN part b USING (p_name)
  WHERE a.p_partkey < b.p_partkey AND p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) BETWEEN 2 AND 200))"""


@R.query(f"WITH {_BLOCKS} SELECT left_id, right_id FROM pairs")
def blocking_pairs(spark, sf_dir):
    return resolution.candidate_pairs(table(spark, sf_dir, "part"), ["p_name"], "p_partkey")


@R.query(f"""WITH {_BLOCKS}
SELECT left_id, right_id, CASE WHEN same_brand THEN 'exact_name_plus_secondary' WHEN same_type THEN 'exact_name' ELSE 'exact_name_requires_secondary_review' END AS method,
  CASE WHEN same_brand THEN 0.97 WHEN same_type THEN 0.96 ELSE 0.82 END::DOUBLE AS score, CASE WHEN same_brand OR same_type THEN 'AUTO_MERGE' ELSE 'REVIEW' END AS decision FROM pairs""")
def pair_decisions(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    side = lambda x: parts.select(F.col("p_partkey").alias(f"{x}_id"), F.col("p_name").alias(f"{x}_name"), F.col("p_brand").alias(f"{x}_brand"), F.col("p_type").alias(f"{x}_type"))
    pairs = resolution.candidate_pairs(parts, ["p_name"], "p_partkey").join(side("left"), "left_id").join(side("right"), "right_id")
    decided = resolution.decide(F.col("left_name") == F.col("right_name"), F.col("left_brand") == F.col("right_brand"), F.col("left_type") != F.col("right_type"))
    return pairs.select("left_id", "right_id", decided.alias("d")).select("left_id", "right_id", "d.*")


@R.query()
def fuzzy_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.substring("p_name", 1, 1).alias("block"))
    return resolution.fuzzy_pairs(names, ["block"], "p_name", "p_name", 0.6)


@R.query("""
SELECT p_name AS name, count(*) AS records, count(DISTINCT p_brand) AS sources, CASE WHEN count(DISTINCT p_brand) >= 2 THEN 'AUTO_MATCH' ELSE 'REJECTED_SAME_SOURCE' END AS decision,
  'cross:' || substr(sha1(p_name || '|' || string_agg(DISTINCT p_brand, '|' ORDER BY p_brand)), 1, 16) AS match_id FROM part GROUP BY p_name""")
def cross_source_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("p_brand").alias("sources"), sorted_tokens(F.col("p_brand")).alias("_all"))
    decision = F.when(F.col("sources") >= 2, "AUTO_MATCH").otherwise("REJECTED_SAME_SOURCE")
    return rows.select("name", "records", "sources", decision.alias("decision"), X.stable_id("cross", F.col("name"), F.col("_all")).alias("match_id"))


@R.query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS r FROM part),
f AS (SELECT * FROM p WHERE r = 1)
SELECT a.p_name AS name, a.p_brand AS left_source, b.p_brand AS right_source, a.p_partkey AS left_id, b.p_partkey AS right_id FROM f a JOIN f b USING (p_name) WHERE a.p_brand < b.p_brand""")
def cross_source_pairs(spark, sf_dir):
    first = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"))
    left = first.withColumnsRenamed({"p_brand": "left_source", "id": "left_id"})
    right = first.withColumnsRenamed({"p_brand": "right_source", "id": "right_id"})
    return left.join(right, "p_name").where("left_source < right_source").select(F.col("p_name").alias("name"), "left_source", "right_source", "left_id", "right_id")


@R.query("""
SELECT o_custkey, p.p_brand, count(DISTINCT l_suppkey) AS suppliers, count(*) AS paths FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN part p ON l_partkey = p_partkey
WHERE o_orderstatus = 'P' GROUP BY ALL""")
def three_source_path(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    paths = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders, "l_orderkey").join(parts, "l_partkey")
    return paths.groupBy("o_custkey", "p_brand").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("paths"))


@R.query("""
SELECT p_name AS name, count(DISTINCT p_brand) AS sources, count(DISTINCT p_type) AS kinds, bool_and(p_size > 2) AS all_larger, min(p_partkey) AS first_id FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2""")
def owner_in_other_records(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"))
    return rows.agg(F.countDistinct("p_brand").alias("sources"), F.countDistinct("p_type").alias("kinds"), F.bool_and(F.col("p_size") > 2).alias("all_larger"), F.min("p_partkey").alias("first_id")).where("sources >= 2")


@R.query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' Main St, Miami, FL' WHEN 1 THEN c_custkey || ' Main St' ELSE '' END AS address, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS officers FROM customer""")
def polymorphic_records(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    street = F.concat(key, F.lit(" Main St"))
    as_object = F.to_json(F.struct(street.alias("line1"), F.lit("").alias("line2"), F.lit("Miami").alias("city"), F.lit("FL").alias("state")))
    kind = F.col("c_custkey") % 3
    address = F.when(kind == 0, as_object).when(kind == 1, street)
    officers = F.when(kind == 0, F.lit("Ann Lee; Bo Li |")).when(kind == 1, F.lit('[{"name": "Cy Wu", "title": "CEO"}, {"name": ""}]'))
    return table(spark, sf_dir, "customer").select("c_custkey", P.address_text(address).alias("address"), F.size(P.people(officers)).alias("officers"))


@R.query()
def similar_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    return similarity.alike(rows.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("block")), "block", "id", "name", 0.8).drop("block").distinct()


#: For each customer a pair for every outcome of the ladder: (case, type, left name, right name, whether evidence is shared).
_LADDER = """SELECT c_custkey, step, CASE step WHEN 0 THEN 'phone' WHEN 1 THEN 'email' WHEN 2 THEN 'website' WHEN 3 THEN 'property' WHEN 4 THEN 'address' WHEN 5 THEN 'address' WHEN 9 THEN 'case' ELSE 'business' END AS entity_type,
  CASE step WHEN 4 THEN c_custkey || ' N MAIN ST UNIT 4' WHEN 5 THEN c_custkey || ' N OAK ST UNIT 4' WHEN 3 THEN 'LOT' ELSE 'NAME ' || step || substr(md5(cast(c_custkey AS string)), 1, 1 + c_custkey % 20) || 'Z' END AS l,
  CASE step WHEN 4 THEN c_custkey || ' N MAIN ST UNIT 4' WHEN 5 THEN c_custkey || ' N OAK ST UNIT 5' WHEN 3 THEN 'BLOCK' ELSE 'NAME ' || step || substr(md5(cast(c_custkey AS string)), 1, 1 + c_custkey % 20) || CASE WHEN step IN (8, 10) THEN '' ELSE 'Z' END END AS r,
  step IN (6, 8) AS shared FROM {customer} CROSS JOIN (SELECT explode_steps AS step FROM (SELECT 0 AS explode_steps UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10) s) steps"""


@R.query(f"""WITH p AS ({_LADDER.format(customer="customer")}),
m AS (SELECT *, CASE step WHEN 0 THEN 'exact_phone' WHEN 1 THEN 'exact_email' WHEN 2 THEN 'exact_website' WHEN 3 THEN 'exact_property_parcel' WHEN 4 THEN 'exact_address' WHEN 5 THEN 'shared_building_different_unit' WHEN 6 THEN 'exact_name_plus_secondary'
  WHEN 7 THEN 'exact_name_requires_secondary_review' WHEN 9 THEN 'exact_name' ELSE CASE WHEN step = 8 AND 2 * length(r) / (length(l) + length(r)) >= 0.9 THEN 'fuzzy_name_plus_secondary' WHEN 2 * length(r) / (length(l) + length(r)) >= 0.75 THEN 'fuzzy_name_only' ELSE 'candidate_only' END END AS method FROM p)
SELECT c_custkey || ':' || step || ':a' AS left_id, c_custkey || ':' || step || ':b' AS right_id, entity_type, method,
  CASE method WHEN 'exact_address' THEN 0.99 WHEN 'shared_building_different_unit' THEN 0.3 WHEN 'exact_name_plus_secondary' THEN 0.97 WHEN 'exact_name' THEN 0.96 WHEN 'exact_name_requires_secondary_review' THEN 0.82 WHEN 'fuzzy_name_plus_secondary' THEN 0.86 WHEN 'fuzzy_name_only' THEN 0.45 WHEN 'candidate_only' THEN 0 ELSE 1 END::DOUBLE AS score,
  CASE WHEN method LIKE 'fuzzy_name_plus%' OR method LIKE '%review' THEN 'REVIEW' WHEN method IN ('fuzzy_name_only', 'candidate_only', 'shared_building_different_unit') THEN 'NO_MERGE' ELSE 'AUTO_MERGE' END AS decision,
  'match:' || substr(sha1(c_custkey || ':' || step || ':a|' || c_custkey || ':' || step || ':b|' || method), 1, 16) AS match_id FROM m""")
def match_ladder(spark, sf_dir):
    pairs = spark.sql(_LADDER, customer=table(spark, sf_dir, "customer")).withColumn("id", F.concat_ws(":", "c_custkey", "step"))
    side = lambda x, name: pairs.select(F.concat_ws(":", "id", F.lit(x)).alias("entity_id"), "entity_type", F.col(name).alias("name"), F.lit("s").alias("source_name"), F.when(F.col("step") == 3, F.col("id")).alias("parcel"))
    rows = side("a", "l").unionByName(side("b", "r"))
    key = F.regexp_replace("entity_id", ":[ab]$", "")
    evidence = rows.select("entity_id", key.alias("id")).join(pairs.select("id", "shared"), "id").select("entity_id", F.when(F.col("shared"), F.col("id")).otherwise(F.col("entity_id")).alias("value"))
    return resolution.match_decisions(rows, rows.select("entity_id", key.alias("key")), evidence).drop("shared")


_PEOPLE = """SELECT 'x:' || c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN 'business' ELSE 'person' END AS entity_type, CASE c_custkey % 3 WHEN 0 THEN 'FIRM ' || (c_custkey % 100) || ' LLC' ELSE 'ANN' || (c_custkey % 70) || ' LEE' || (c_custkey % 70) END AS display_name, c_mktsegment AS source_name FROM {customer}"""


def people_and_phones(spark, sf_dir):
    """(people, phones, edges between them)."""
    customers = table(spark, sf_dir, "customer")
    people = spark.sql(_PEOPLE, customer=customers)
    phone = F.concat(F.lit("ph:305555"), F.lpad((F.floor(F.col("c_custkey") / 200)).cast("string"), 4, "0"))
    edges = customers.select(F.concat(F.lit("x:"), "c_custkey").alias("src"), phone.alias("dst"), F.lit("USES_PHONE").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("s").alias("source_name"))
    phones = edges.select(F.col("dst").alias("entity_id"), F.lit("phone").alias("entity_type"), F.regexp_replace("dst", "^ph:", "").alias("display_name"), F.lit("s").alias("source_name")).distinct()
    return people, phones, edges


@R.query(f"""WITH e AS ({_PEOPLE.format(customer="customer")}), n AS (SELECT *, replace(display_name, ' LLC', '') AS name, 'p' || (substr(entity_id, 3)::BIGINT // 200) AS phone FROM e)
SELECT entity_id, min(entity_id) OVER (PARTITION BY entity_type, name, phone) AS cluster, count(*) OVER (PARTITION BY entity_type, name, phone) > 1 AS merged FROM n""")
def resolved_entities(spark, sf_dir):
    """Names merge where they share a phone, which goes by ranges of keys: blocks, evidence, decisions and clusters from raw rows."""
    people, phones, edges = people_and_phones(spark, sf_dir)
    found = resolution.resolve_graph(people.unionByName(phones), edges).aliases
    return found.where(F.col("entity_id").startswith("x:")).select("entity_id", "cluster", (F.col("method") != "identity").alias("merged"))


_GRAPH = f"WITH {GRAPH_SQL}"
_MATCHES = f"""{_GRAPH},
typed AS (SELECT e.*, s.entity_type AS type FROM edges e JOIN entities s ON e.src = s.entity_id JOIN entities t ON e.dst = t.entity_id AND t.entity_type = 'address'),
at_address AS (
  SELECT l.dst AS canonical_id, 'address' AS entity_type, l.src AS left_id, r.src AS right_id, l.source_name AS left_source, r.source_name AS right_source, l.source_type AS left_source_type, r.source_type AS right_source_type,
    CASE WHEN r.type = 'person' THEN 'property_address_linked_to_person_record' WHEN l.kind = 'PROPERTY_HAS_SITUS_ADDRESS' THEN 'property_situs_matches_business_address' ELSE 'property_mailing_matches_business_address' END AS method, 0.88::DOUBLE AS confidence, l.dst AS evidence, FALSE AS lacking
  FROM typed l JOIN typed r ON l.dst = r.dst WHERE l.type = 'property' AND r.type IN ('business', 'person', 'case') AND l.source_name <> r.source_name),
context AS (SELECT DISTINCT e.src AS id, t.entity_type || ':' || e.dst AS value FROM edges e JOIN entities t ON e.dst = t.entity_id),
named AS (
  SELECT l.entity_id AS left_id, r.entity_id AS right_id, l.entity_type AS lt, r.entity_type AS rt, l.source_name AS left_source, r.source_name AS right_source, l.source_type AS left_source_type, r.source_type AS right_source_type,
    CASE WHEN 'owner' IN (l.entity_type, r.entity_type) AND 'business' IN (l.entity_type, r.entity_type) THEN 'parcel_owner_matches_business_name'
      WHEN 'owner' IN (l.entity_type, r.entity_type) AND (l.entity_type IN ('person', 'registered_agent', 'officer') OR r.entity_type IN ('person', 'registered_agent', 'officer')) THEN 'parcel_owner_matches_person_with_secondary'
      WHEN 'person' IN (l.entity_type, r.entity_type) AND 'business' IN (l.entity_type, r.entity_type) THEN 'clerk_party_matches_business_person_with_secondary' END AS method
  FROM entities l JOIN entities r ON l.normalized_value = r.normalized_value AND l.entity_id < r.entity_id
  WHERE l.source_name <> r.source_name AND l.entity_type IN ('business', 'owner', 'person', 'registered_agent', 'officer') AND r.entity_type IN ('business', 'owner', 'person', 'registered_agent', 'officer')),
shared AS (SELECT n.left_id, n.right_id, min(a.value) AS evidence FROM named n JOIN context a ON a.id = n.left_id JOIN context b ON b.id = n.right_id AND a.value = b.value WHERE method LIKE '%secondary%' GROUP BY 1, 2),
pairs AS (
  SELECT * FROM at_address
  UNION ALL SELECT left_id, lt, left_id, right_id, left_source, right_source, left_source_type, right_source_type, method, CASE WHEN method LIKE '%secondary%' AND evidence IS NULL THEN 0.76 ELSE 0.88 END::DOUBLE, coalesce(evidence, ''), method LIKE '%secondary%' AND evidence IS NULL
  FROM named LEFT JOIN shared USING (left_id, right_id) WHERE method IS NOT NULL),
matches AS (
  SELECT *, CASE WHEN left_source_type <> 'synthetic' THEN 1 ELSE 0 END + CASE WHEN right_source_type <> 'synthetic' THEN 1 ELSE 0 END AS real_sources,
    CASE WHEN lacking THEN 'REJECTED_NO_SECONDARY_EVIDENCE' WHEN 'synthetic' IN (left_source_type, right_source_type) THEN 'REJECTED_SYNTHETIC_OR_SINGLE_REAL' ELSE 'AUTO_MATCH' END AS decision,
    'cross:' || substr(sha1(canonical_id || '|' || left_id || '|' || right_id || '|' || method), 1, 16) AS match_id FROM pairs)"""


def _case_graph(spark, sf_dir):
    return stored(entities(spark, sf_dir), "entities"), stored(edges(spark, sf_dir).select("src", "dst", "kind", "source_name", "source_type", F.lit("").alias("record")), "edges")


def _case_matches(spark, sf_dir):
    return cross_source.cross_source_matches(*_case_graph(spark, sf_dir))


@R.query(f"""{_MATCHES} SELECT DISTINCT match_id, canonical_id, entity_type, left_id, right_id, method, confidence, decision, evidence, real_sources::INT AS real_sources, 'synthetic' IN (left_source_type, right_source_type) AS contains_synthetic,
  least(left_source, right_source) || '|' || greatest(left_source, right_source) AS source_pair FROM matches""")
def cross_source_decisions(spark, sf_dir):
    return _case_matches(spark, sf_dir).select("match_id", "canonical_id", "entity_type", "left_id", "right_id", "method", "confidence", "decision", "evidence", "real_sources", "contains_synthetic", "source_pair")


@R.query(f"""{_MATCHES}, one AS (SELECT DISTINCT * FROM matches WHERE decision = 'AUTO_MATCH' AND real_sources = 2),
m AS (SELECT canonical_id, match_id, confidence, CASE method WHEN 'parcel_owner_matches_business_name' THEN 'cross_source_owner_business' WHEN 'parcel_owner_matches_person_with_secondary' THEN 'cross_source_owner_person' WHEN 'clerk_party_matches_business_person_with_secondary' THEN 'cross_source_clerk_business'
  WHEN 'property_address_linked_to_person_record' THEN 'cross_source_multi_source_cluster' ELSE 'cross_source_property_business_address' END AS marker FROM one)
SELECT canonical_id AS entity_id, marker, match_id AS related, 2::BIGINT AS support, confidence, CASE marker WHEN 'cross_source_owner_person' THEN 22 WHEN 'cross_source_multi_source_cluster' THEN 24 ELSE 20 END::BIGINT AS risk FROM m""")
def cross_source_markers(spark, sf_dir):
    return markers.cross_source_records(_case_matches(spark, sf_dir)).select("entity_id", "marker", "related", "support", "confidence", "risk")


#: Registry and parcel ends of matches, by key: whose name, where, redacted or incomplete, and by which method they were matched.
_REGISTRY = """SELECT 'm' || c_custkey AS match_id, 'r' || c_custkey AS entity_id, 'q' || c_custkey AS parcel_id, 'NAME ' || (c_custkey % 900) AS name, c_custkey % 23 = 0 AS redacted, c_custkey % 19 = 0 AS incomplete,
  CASE c_custkey % 4 WHEN 0 THEN 'parcel_owner_matches_person_with_secondary' WHEN 1 THEN 'parcel_owner_matches_business_name' WHEN 2 THEN 'property_situs_matches_business_address' ELSE 'parcel_owner_matches_person_with_secondary' END AS method,
  CASE c_custkey % 6 WHEN 0 THEN 'PO Box ' || c_custkey WHEN 1 THEN c_custkey || ' Main Street Apt 4' WHEN 2 THEN c_custkey || ' Main Street' WHEN 3 THEN c_custkey || ' Main Street Apt 4' WHEN 4 THEN 'Redacted 1' ELSE c_custkey || ' Oak Road' END AS address,
  CASE c_custkey % 6 WHEN 0 THEN c_custkey || ' Main St' WHEN 1 THEN c_custkey || ' MAIN ST APT 4' WHEN 2 THEN c_custkey || ' MAIN ST' WHEN 3 THEN c_custkey || ' MAIN ST APT 5' WHEN 4 THEN c_custkey || ' Main St' ELSE c_custkey || ' Main St' END AS parcel_address FROM {customer}"""


@R.query(f"""WITH m AS ({_REGISTRY.format(customer="customer")}), f AS (SELECT name, count(*) AS frequency FROM m GROUP BY 1),
s AS (SELECT *, substr(match_id, 2)::BIGINT % 6 AS form, CASE substr(match_id, 2)::BIGINT % 6 WHEN 0 THEN 'PO_BOX' WHEN 1 THEN 'EXACT_UNIT' WHEN 2 THEN 'EXACT_BUILDING' WHEN 3 THEN 'GENERALIZED' WHEN 4 THEN 'GENERALIZED' ELSE 'MAILING_ONLY' END AS scope FROM m JOIN f USING (name)),
d AS (SELECT *, method LIKE '%person%' AS person, CASE WHEN redacted OR incomplete THEN 'INSUFFICIENT_DATA' WHEN scope = 'PO_BOX' AND method LIKE 'property_situs%' THEN 'REJECTED' WHEN method LIKE '%person%' THEN CASE scope WHEN 'EXACT_UNIT' THEN CASE WHEN frequency >= 2 THEN 'REVIEW_STRONG' ELSE 'ACCEPTED_EXACT' END WHEN 'EXACT_BUILDING' THEN 'REVIEW_STRONG' ELSE 'REVIEW_WEAK' END
  WHEN method LIKE '%business_name' AND scope LIKE 'EXACT%' THEN 'REVIEW_STRONG' ELSE 'REJECTED' END AS decision FROM s)
SELECT match_id, scope, frequency::BIGINT AS frequency, decision, CASE WHEN redacted THEN 0.2 WHEN incomplete THEN 0.25 WHEN decision = 'REJECTED' THEN CASE WHEN scope = 'PO_BOX' AND method LIKE 'property_situs%' THEN 0.05 ELSE 0.1 END WHEN NOT person THEN 0.78
  WHEN scope = 'EXACT_UNIT' THEN CASE WHEN frequency >= 2 THEN 0.82 ELSE 0.97 END WHEN scope = 'EXACT_BUILDING' THEN CASE WHEN frequency >= 2 THEN 0.72 ELSE 0.8 END WHEN scope IN ('GENERALIZED', 'MAILING_ONLY') THEN CASE WHEN frequency >= 2 THEN 0.42 ELSE 0.5 END ELSE CASE WHEN frequency >= 2 THEN 0.3 ELSE 0.36 END END::DOUBLE AS confidence,
  person AND NOT redacted AND NOT incomplete AND frequency >= 2 AS downgraded FROM d""")
def registry_decisions(spark, sf_dir):
    return registry_matches(spark, sf_dir).select("match_id", "scope", "frequency", "decision", "confidence", "downgraded")


def registry_matches(spark, sf_dir):
    rows = spark.sql(_REGISTRY, customer=table(spark, sf_dir, "customer"))
    matches = rows.select("match_id", "method", F.col("entity_id").alias("left_id"), F.col("parcel_id").alias("right_id"), F.lit("registry").alias("left_source"), F.lit("parcels").alias("right_source"))
    parcels = rows.select(F.col("parcel_id").alias("entity_id"), F.col("parcel_address").alias("address"))
    return correlation.registry_matches(matches, rows.select("entity_id", "name", "address", "redacted", "incomplete"), parcels, "registry")

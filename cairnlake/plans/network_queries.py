"""Components, canonical entities, networks and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import graph, resolution
from cairnlake.plans.registry import Registry
from cairnlake.sources.scratch import stored
from cairnlake.sources.tables import table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: Documents are joined to the first document with the same text: a star per text, however many copies it has.
_SAME_SQL = "same AS (SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY md5(text)) AS dst FROM documents)"

def both_ways_sql(edges: str) -> str:
    return f"""supplied AS ({edges}),
both_ways AS (SELECT src AS id, dst AS nbr FROM supplied UNION SELECT dst, src FROM supplied)"""


def components_sql(edges: str) -> str:
    """The components of a graph by keyed recursion: each vertex keeps its smallest label."""
    return f"""{both_ways_sql(edges)},
cc(id, component) USING KEY (id) AS (
  SELECT id, min(least(id, nbr)) FROM both_ways GROUP BY id
  UNION SELECT b.nbr, min(c.component) FROM cc c JOIN both_ways b ON b.id = c.id JOIN recurring.cc r ON r.id = b.nbr WHERE c.component < r.component GROUP BY b.nbr),
sizes AS (SELECT component, count(*) AS members FROM cc GROUP BY 1)"""


#: Every distinct supplier-part edge, and the components of that graph.
_EDGES_SQL = "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"
_SUPPLIED_SQL, _CC_SQL = both_ways_sql(_EDGES_SQL), components_sql(_EDGES_SQL)


def _same_text(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(firsts, "digest").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst")


def _supplied(spark, sf_dir):
    """Every distinct supplier-part edge."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def _ends(edges):
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


@R.query(f"WITH {_SAME_SQL} SELECT src AS id, dst AS component FROM same")
def connected_components(spark, sf_dir):
    return graph.connected_components(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _same_text(spark, sf_dir))


def _summary(components):
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    largest = F.min_by("component", F.struct(-F.col("members"), F.col("component")))
    return sizes.agg(F.count(F.lit(1)).alias("networks"), F.max("members").alias("largest"), F.sum("members").alias("members"), largest.alias("largest_component"))


def _whole(spark, sf_dir):
    edges = stored(_supplied(spark, sf_dir), "edges")
    return edges, stored(graph.connected_components(_ends(edges), edges), "components")


@R.query(f"""WITH RECURSIVE {_CC_SQL},
rel AS (SELECT c.component, count(*) AS relationships FROM supplied s JOIN cc c ON s.src = c.id GROUP BY 1)
SELECT component, network_id, members, relationships, round(2 * relationships / (members * greatest(members - 1, 1)), 4)::DOUBLE AS density,
  CASE WHEN members >= 25 THEN 'Large' WHEN members >= 10 THEN 'Medium' ELSE 'Small' END AS size_label
FROM (SELECT *, 'network:' || lpad(row_number() OVER (ORDER BY component)::VARCHAR, 4, '0') AS network_id FROM sizes) JOIN rel USING (component)""")
def network_clusters(spark, sf_dir):
    edges, components = _whole(spark, sf_dir)
    return graph.network_metrics(components, edges)


@R.query(f"WITH RECURSIVE {_CC_SQL} SELECT count(*) AS networks, max(members) AS largest, sum(members)::BIGINT AS members, arg_min(component, (-members, component)) AS largest_component FROM sizes")
def network_summary(spark, sf_dir):
    return _summary(_whole(spark, sf_dir)[1])


@R.query("WITH same AS (SELECT min(doc_id) AS component, count(*) AS members FROM documents GROUP BY md5(text)) SELECT count(*) AS networks, max(members) AS largest, sum(members)::BIGINT AS members, arg_min(component, (-members, component)) AS largest_component FROM same")
def copies_summary(spark, sf_dir):
    """Of many components, several may be the largest: the one with the smallest id counts."""
    return _summary(connected_components(spark, sf_dir))


@R.query(f"""WITH {_SUPPLIED_SQL}
SELECT id, count(*) AS degree, round(count(*) / greatest((SELECT count(DISTINCT id) FROM both_ways) - 1, 1), 4)::DOUBLE AS centrality FROM both_ways GROUP BY id""")
def degree_centrality(spark, sf_dir):
    edges = stored(_supplied(spark, sf_dir), "edges")
    return graph.degrees(_ends(edges), edges)


@R.query()
def articulation_points(spark, sf_dir):
    return graph.articulation_points(*_whole(spark, sf_dir))


@R.query()
def communities(spark, sf_dir):
    return graph.communities(*_whole(spark, sf_dir))


@R.query(f"""WITH {_SAME_SQL}
SELECT dst AS cluster, 'document' AS entity_type, min(d.lang) AS display_name, count(*) AS aliases, count(DISTINCT d.source) AS sources, string_agg(DISTINCT d.source, '|' ORDER BY d.source) AS source_names,
  'canonical:document:' || substr(sha1('document|' || arg_min(d.lang, (d.lang, d.lang, upper(d.lang), d.source, d.doc_id))), 1, 16) AS canonical_id FROM same JOIN documents d ON d.doc_id = src GROUP BY dst""")
def canonical_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clusters = connected_components(spark, sf_dir).withColumnsRenamed({"id": "entity_id", "component": "cluster"})
    members = docs.select(F.col("doc_id").alias("entity_id"), F.lit("document").alias("entity_type"), F.col("lang").alias("name"), F.col("source").alias("source_name")).join(clusters, "entity_id")
    return resolution.canonical(members)


@R.query(f"""WITH {_SAME_SQL}
SELECT src AS entity_id, dst AS cluster, CASE WHEN count(*) OVER (PARTITION BY dst) > 1 THEN 'exact_text' ELSE 'identity' END AS method FROM same""")
def entity_aliases(spark, sf_dir):
    comps = connected_components(spark, sf_dir).withColumnsRenamed({"id": "entity_id", "component": "cluster"})
    sizes = comps.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return comps.join(sizes, "cluster").select("entity_id", "cluster", F.when(F.col("n") > 1, "exact_text").otherwise("identity").alias("method"))


@R.query("""
WITH m AS (SELECT p_partkey, 'canonical:' || p_name AS c FROM part),
e AS (SELECT 'canonical:' || s_nationkey AS src, m.c AS dst, l_returnflag AS kind, l_discount, l_linestatus FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN m ON l_partkey = p_partkey)
SELECT src, dst, kind, max(l_discount) AS confidence, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS sources FROM e WHERE src <> dst GROUP BY src, dst, kind""")
def canonical_edges(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("source"))
    of = lambda name, prefix, key, value: table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), F.concat(F.lit("canonical:"), F.col(value).cast("string")).alias("canonical_id"))
    return resolution.canonical_edges(items, of("supplier", "s", "s_suppkey", "s_nationkey").unionByName(of("part", "p", "p_partkey", "p_name")))

"""Networks of customers, their orders and the orders' lines: many components, with bridges and cycles.

A customer is tied to orders, an order to its lines, and each line to the next of its order; so what bridges what is known
beforehand, and SQL can say it: a customer holds its orders together, an order its customer and its lines.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.operators import graph, networks
from cairnlake.operators.markers import Graph
from cairnlake.plans.network_queries import _same_text
from cairnlake.plans.registry import Registry
from cairnlake.sources.scratch import stored
from cairnlake.sources.tables import table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_BLANK_MARKERS = "entity_id string, marker string, confidence double, sources string"


def _order_graph(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("o"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("c")).distinct()
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    line = lambda n: F.concat(F.lit("l:"), F.col("l_orderkey").cast("string"), F.lit(":"), n.cast("string"))
    after = F.lead("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))  # an order has few lines
    lines = lines.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("o"), line(F.col("l_linenumber")).alias("l"), line(after).alias("following"))
    entity = lambda id_col, kind, source: [F.col(id_col).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(id_col).alias("display_name"), F.lit(source).alias("source_name"), F.lit("api" if source == "sales" else "synthetic").alias("source_type")]
    entities = orders.select(*entity("c", "owner", "sales")).unionByName(orders.select(*entity("o", "business", "sales"))).unionByName(lines.select(*entity("o", "business", "sales"))).distinct().unionByName(lines.select(*entity("l", "property", "shipping")))
    edge = lambda a, b, source: [F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(source).alias("source_name"), F.lit("api" if source == "sales" else "synthetic").alias("source_type")]
    edges = orders.select(*edge("c", "o", "sales")).unionByName(lines.select(*edge("o", "l", "shipping"))).unionByName(lines.where("following IS NOT NULL").select(*edge("l", "following", "shipping")))
    g = Graph(stored(entities, "entities"), stored(edges, "edges"))
    return g, stored(graph.connected_components(g.entities.select(F.col("entity_id").alias("id")), g.edges), "components")


#: The customer of an order is the one its only row of ``orders`` names; an order without one is a component of its own.
_SQL = """WITH ordered AS (SELECT DISTINCT 'o:' || o_orderkey AS o, 'c:' || o_custkey AS c FROM orders),
lines AS (SELECT DISTINCT 'o:' || l_orderkey AS o, l_orderkey, l_linenumber, 'l:' || l_orderkey || ':' || l_linenumber AS l FROM lineitem),
per_order AS (SELECT o, max(c) AS c, coalesce(max(n), 0) AS n FROM (SELECT o, c, NULL AS n FROM ordered UNION ALL SELECT o, NULL, count(*) FROM lines GROUP BY o) GROUP BY o),
firsts AS (SELECT coalesce(c, o) AS top, count(*) AS orders, sum(n) AS n_lines, sum(n + greatest(n - 1, 0)) AS inner_edges, count(c) AS tied, sum(CASE WHEN c IS NOT NULL AND n > 0 THEN 1 ELSE 0 END) AS holding FROM per_order GROUP BY 1),
components AS (SELECT *, CASE WHEN tied > 0 THEN top ELSE (SELECT min(l) FROM lines WHERE lines.o = top) END AS least, orders + n_lines + CASE WHEN tied > 0 THEN 1 ELSE 0 END AS members FROM firsts),
numbered AS (SELECT *, 'network:' || lpad((row_number() OVER (ORDER BY least))::VARCHAR, 4, '0') AS network_id FROM components)"""


@R.query(f"""{_SQL},
shaped AS (SELECT *, inner_edges + tied AS relationships, holding + CASE WHEN tied > 1 THEN 1 ELSE 0 END AS bridges FROM numbered),
dense AS (SELECT *, round(2 * relationships / (members * (members - 1)), 4)::DOUBLE AS density FROM shaped)
SELECT network_id, members::BIGINT AS members, orders::BIGINT AS businesses, relationships::BIGINT AS relationships, density, bridges::BIGINT AS bridges,
  CASE WHEN members >= 25 THEN 'Large' WHEN members >= 10 THEN 'Medium' ELSE 'Small' END AS size_label FROM dense""")
def order_network_profiles(spark, sf_dir):
    g, components = _order_graph(spark, sf_dir)
    got = networks.profiles(components, g.entities, g.edges, spark.createDataFrame([], _BLANK_MARKERS), bridges=graph.articulation_points(g.edges, components))
    return got.select("network_id", "members", "businesses", "relationships", "density", "bridges", "size_label")


@R.query(f"""{_SQL},
ends AS (
  SELECT top, 'c' AS kind, top AS id, tied AS degree, tied AS held FROM numbered WHERE tied > 0
  UNION ALL SELECT coalesce(c, o), 'o', o, n + (c IS NOT NULL)::INTEGER, (n > 0)::INTEGER + (c IS NOT NULL)::INTEGER FROM per_order
  UNION ALL SELECT coalesce(c, o), 'l', l, 1 + (l_linenumber > lo)::INTEGER + (l_linenumber < hi)::INTEGER, 1 FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY o) AS lo, max(l_linenumber) OVER (PARTITION BY o) AS hi FROM lines) JOIN per_order USING (o))
SELECT network_id, id AS entity_id, degree::BIGINT AS degree, round(degree / (members - 1), 4)::DOUBLE AS centrality, CASE WHEN held > 1 THEN 'Yes' ELSE 'No' END AS bridge, CASE WHEN held > 1 THEN held ELSE 0 END::BIGINT AS held_groups,
  CASE WHEN held > 1 THEN 10 * held + degree ELSE 0 END::BIGINT AS bridge_score, CASE WHEN kind = 'l' THEN 'synthetic' ELSE 'real' END AS data_scope FROM ends JOIN numbered USING (top)""")
def order_network_members(spark, sf_dir):
    g, components = _order_graph(spark, sf_dir)
    got = networks.members(components, g.entities, g.edges, spark.createDataFrame([], _BLANK_MARKERS), graph.articulation_points(g.edges, components))
    return got.select("network_id", "entity_id", "degree", "centrality", "bridge", "held_groups", "bridge_score", "data_scope")


@R.query("""WITH same AS (SELECT doc_id AS id, min(doc_id) OVER w AS component, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY md5(text)))
SELECT component, id, component AS community FROM same WHERE n > 1""")
def copies_communities(spark, sf_dir):
    """A star is one community: the first document hears its smallest copy, the others hear the first."""
    edges = stored(_same_text(spark, sf_dir), "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.communities(edges, stored(graph.connected_components(ends, edges), "components"))

"""Marker rules over the edge kinds that connectors emit, their gate and what is made of them."""

from cairnlake.operators import markers

ENTITIES = [
    ("b1", "business", "Acme", "ACME HOLDINGS", "s", "api"), ("b2", "business", "Bolt", "ACME HOLDING", "t", "api"), ("o1", "owner", "Ann", "ANN LEE", "s", "arcgis"), ("x1", "person", "Ann", "ANN LEE", "county_clerk_local_file|t", "connector"), ("a1", "address", "P O Box 7", "", "s", "api"),
    ("a2", "address", "1 Main St", "", "s", "api"), ("p1", "phone", "3055550101", "", "s", "api"), ("e1", "email", "x@y.com", "", "s", "api"), ("w1", "website", "y.com", "", "s", "api"), ("p2", "phone", "3055550102", "", "s", "api"),
    ("g1", "registered_agent", "Agent", "", "s", "api"), ("g2", "registered_agent", "Agent 2", "", "s", "api"), ("f1", "officer", "Officer", "", "s", "api"),
]
EDGES = [
    ("b1", "p1", "USES_PHONE"), ("o1", "p1", "USES_PHONE"), ("b2", "p2", "USES_PHONE"), ("b1", "e1", "USES_EMAIL"), ("b2", "e1", "USES_EMAIL"), ("b2", "e1", "USES_EMAIL"), ("b1", "w1", "HAS_WEBSITE"), ("b2", "w1", "HAS_WEBSITE"),
    ("b1", "a1", "BUSINESS_MAILING_ADDRESS"), ("b2", "a1", "BUSINESS_MAILING_ADDRESS"), ("o1", "a1", "PROPERTY_HAS_MAILING_ADDRESS"), ("b1", "a2", "LOCATED_AT"), ("b2", "a2", "BUSINESS_LOCATED_AT"),
    *[(g, f"n{i}", "REGISTERED_AGENT_FOR") for g in ("g1", "g2") for i in range(3)], ("g1", "a1", "REGISTERED_AGENT_AT_ADDRESS"), ("g2", "a1", "REGISTERED_AGENT_AT_ADDRESS"), ("g2", "a1", "REGISTERED_AGENT_AT_ADDRESS"), *[("f1", f"n{i}", "OFFICER_OF") for i in range(2)],
]


def made(spark, edges=EDGES):
    return markers.Graph(
        spark.createDataFrame(ENTITIES, "entity_id string, entity_type string, display_name string, normalized_value string, source_name string, source_type string"),
        spark.createDataFrame([(*e, "s") for e in edges], "src string, dst string, kind string, source_name string"),
    )


def test_rules_and_gate(spark):
    got = {(r["marker"], r["entity_id"]): (r["support"], r["confidence"], r["risk"], r["related"]) for r in markers.run_markers(made(spark)).collect()}
    want = {("mailbox_address_cluster", "a1"): (5, 0.85, 16, "b1"), ("registered_agent_dense_network", "g2"): (3, 0.85, 18, "n0"), ("arcgis_owner_in_business_records", "o1"): (1, 0.77, 20, "x1"), ("county_clerk_party_in_business_records", "x1"): (1, 0.75, 18, "o1")}
    for name, members, of, confidence, risk in [
        ("business_mailing_address_cluster", ("b1", "b2"), "a1", 0.74, 17), ("shared_phone", ("b1", "o1"), "p1", 0.74, 14), ("shared_email", ("b1", "b2"), "e1", 0.74, 12), ("shared_website", ("b1", "b2"), "w1", 0.74, 10),
        ("shared_address_businesses", ("b1", "b2"), "a2", 0.71, 18), ("similar_business_names", ("b1", "b2"), "a2", 0.62, 11),
    ]:
        want |= {(name, m): (2, confidence, risk, of) for m in members}
    want |= {("business_cluster_compound", "b1"): (5, 0.97, 24, "shared_address_businesses|shared_email|shared_phone|shared_website|similar_business_names"), ("business_cluster_compound", "b2"): (4, 0.96, 24, "shared_address_businesses|shared_email|shared_website|similar_business_names")}
    plain = {k: v for k, v in got.items() if k[0] not in ("dense_entity_cluster", "bridge_entity")}
    assert plain == want  # one agent lacks other ties, the officer has two businesses, one owner's mailing address is no reuse
    assert {k[1] for k in got if k[0] == "dense_entity_cluster"} == {"b1", "b2", "g1", "g2"} and not [k for k in got if k[0] == "bridge_entity"]


def test_config_statistics_and_risk(spark):
    graph = made(spark)
    rules = markers.with_config({"shared_phone": {"enabled": False}, "shared_email": {"least_support": 3}, "shared_website": {"least_sources": 3}, "similar_business_names": {"least_confidence": 0.7}})
    names = {r["marker"] for r in markers.run_markers(graph, rules).select("marker").distinct().collect()}
    assert not names & {"shared_phone", "shared_email", "shared_website", "similar_business_names", "business_cluster_compound"} and "shared_address_businesses" in names
    statistics = spark.createDataFrame([("b1", "shared_address_businesses", 12, -6, 40.0, "COMMON")], "entity_id string, marker string, adjusted long, adjustment long, rarity double, level string")
    rows = markers.run_markers(graph, statistics=statistics)
    (r,) = rows.where("entity_id = 'b1' AND marker = 'shared_address_businesses'").collect()
    assert (r["raw_risk"], r["risk"], r["adjustment"], r["rarity"], r["rarity_level"]) == (18, 12, -6, 40.0, "COMMON")
    risk = {r["entity_id"]: r for r in markers.entity_risk(graph, rows).collect()}
    assert set(risk) == {e[0] for e in ENTITIES} and risk["b1"]["risk_score"] == 100 and risk["p2"]["risk_score"] == 2 and risk["p2"]["confidence"] == "Unknown"
    assert (risk["f1"]["degree"], risk["f1"]["risk_score"], risk["f1"]["risk_level"]) == (2, 4, "Low")
    view = markers.anomaly_view(rows).where("rule = 'shared_phone'").collect()
    assert {(v["entity_ids"], v["phones"]) for v in view} == {("b1|p1", ""), ("o1|p1", "")}
    assert markers.related_edges(graph.edges, "b1", kind="USES_PHONE").count() == 1 and markers.related_edges(graph.edges, "a1", "in").count() == 6


def test_an_empty_graph_fires_nothing(spark):
    graph = made(spark)
    empty = markers.Graph(graph.entities.limit(0), graph.edges.limit(0))
    assert markers.run_markers(empty).count() == 0 and markers.entity_risk(empty, markers.run_markers(empty)).count() == 0

"""Lead candidates and their scores, against values worked out by hand."""

from cairnlake.operators import candidates

RISK = "entity_id string, entity_type string, display_name string, source_names string, source_type string, markers long, degree long, sources long, risk_score long, mean_confidence double, rules string"
MATCH = "canonical_id string, entity_type string, left_source string, right_source string, confidence double, decision string, evidence string, real_sources int, contains_synthetic boolean"


def risk(spark):
    rows = [("b1", "business", "Acme", "s|t", "api", 2, 5, 2, 50, 0.8, "x|y"), ("o1", "owner", "Ann", "u", "synthetic", 1, 0, 1, 10, 0.5, "x"), ("a1", "address", "1 Main", "s", "api", 0, 9, 1, 18, 0.0, "")]
    return spark.createDataFrame(rows, RISK)


def test_entities_and_their_scores(spark):
    members = spark.createDataFrame([("b1", "network:0001", "Yes")], "entity_id string, network_id string, bridge string")
    networks = spark.createDataFrame([("network:0001", 30)], "network_id string, members long")
    records = spark.createDataFrame([("b1", 40.0, "COMMON"), ("b1", 12.0, "IMMEDIATE_REVIEW"), ("b1", 0.0, "")], "entity_id string, rarity double, rarity_level string")
    lookup = candidates.marker_lookup(records)
    assert [(r["rarity"], r["rarity_level"], r["rare"]) for r in lookup.collect()] == [(40.0, "IMMEDIATE_REVIEW", 1)]
    got = {r["primary_id"]: r for r in candidates.scored(candidates.entity_candidates(risk(spark), members, networks, lookup)).collect()}
    assert set(got) == {"b1", "o1"}  # who has no markers is no candidate
    b, o = got["b1"], got["o1"]
    assert (b["lead_type"], b["network_id"], b["members"], b["bridges"], b["rarity"], b["contains_real"], b["contains_synthetic"]) == ("BUSINESS_CLUSTER", "network:0001", 30, 1, 40.0, True, False)
    assert (o["lead_type"], o["network_id"], o["members"], o["bridges"], o["contains_real"], o["contains_synthetic"]) == ("ENTITY", "", 0, 0, False, True)
    assert (b["completeness"], b["missing"]) == (66.67, "timeline_events|aliases|recommended_review") and o["completeness"] == 44.44
    sure = round(0.4 * 0.2 + 0.2 + 0.7 * 0.15 + 0.15 + 0.8 * 0.15 + 0.06667 + 0.05, 4)
    assert b["confidence_score"] == sure == 0.7717 and b["confidence"] == "HIGH"
    assert b["priority_score"] == round(50 * 0.25 + 40 * 0.08 + sure * 15 + 1.6 + 3.2 + 0 + 7 + 7 + 6 + 6 + 66.67 * 0.05 + 0 + 2, 2) and b["priority"] == "MEDIUM"
    assert b["lead_id"] != o["lead_id"] and b["lead_id"].startswith("lead:") and len(b["lead_id"]) == 21


def test_matches_across_sources(spark):
    rows = [("a1", "address", "s", "t", 0.88, "AUTO_MATCH", f"e{i}", 2, False) for i in range(4)] + [("a1", "address", "s", "v", 0.97, "AUTO_MATCH", "e0", 2, True), ("a1", "address", "s", "w", 0.9, "REVIEW", "e9", 2, False), ("b1", "business", "s", "t", 0.9, "AUTO_MATCH", "", 1, False)]
    matches = spark.createDataFrame(rows, MATCH)
    (r,) = candidates.cross_source_candidates(matches).collect()
    assert (r["primary_id"], r["matches"], r["relationships"], r["sources"], r["source_names"], r["explanation"], r["contains_synthetic"]) == ("a1", 5, 5, 3, "s|t|v", "e0 | e1 | e2", True)
    assert abs(r["marker_confidence"] - (4 * 0.88 + 0.97) / 5) < 1e-12 and r["resolution_confidence"] == 0.9 and r["review"].endswith("s|t|v")
    (known,) = candidates.cross_source_candidates(matches, risk(spark)).collect()
    assert (known["risk_score"], known["relationships"], known["resolution_confidence"]) == (18.0, 9, 0.0)
    assert candidates.cross_source_candidates(matches, least_matches=6).count() == 0


def test_nothing_gives_no_candidates(spark):
    assert candidates.scored(candidates.entity_candidates(risk(spark).limit(0))).count() == 0
    assert candidates.cross_source_candidates(spark.createDataFrame([], MATCH)).count() == 0

"""Rules under a configuration, and reports of one row."""

import pytest

from cairnlake.operators import reports, rules

BUSINESSES = [(1, "A", "1 MAIN", "p1", "w1", "x LLC"), (2, "B", "1 MAIN", "p2", "w1", "y LLC"), (3, "C", "1 MAIN", "p2", "", ""), (4, "A", "2 OAK", "p1", None, "z LLC"), (5, "D", None, "", "w2", None), (6, "E", None, None, "w3", "")]
PATTERNS = [(10, "A", "mom"), (11, "A", "mom"), (12, "Z", "mom"), (13, "B", "tour")]


@pytest.fixture
def tables(spark):
    return {
        "business_entities": spark.createDataFrame(BUSINESSES, "record_id int, business_name string, address string, phone string, website string, llc_name string"),
        "known_patterns": spark.createDataFrame(PATTERNS, "record_id int, entity_name string, keyword string"),
    }


def found(frame):
    return {(r["rule"], r["key"], r["evidence"]): (r["n"], r["score"], r["level"]) for r in frame.collect()}


def test_findings(tables):
    got = found(rules.findings(rules.configured({}), tables))
    assert got["shared_address_businesses", "1 MAIN", "3 businesses share address 1 MAIN"] == (3, 30, "High")
    assert got["shared_address_businesses", None, "2 businesses share address "] == (2, 25, "High") and got["shared_address_phones", "1 MAIN", "2 phone numbers appear at address 1 MAIN"] == (2, 20, "Medium")
    assert got["shared_address_websites", None, "2 websites appear at address "] == (2, 10, "Low") and got["shared_phone_llcs", "p1", "2 LLCs share phone p1"] == (2, 20, "Medium")
    assert got["keyword_frequency", "mom", "Keyword 'mom' appears 3 times"] == (3, 29, "High")
    placed = {k: v for k, v in got.items() if k[0] == "known_pattern_addresses"}
    assert {k[1:] for k in placed} == {(a, f"Known pattern keyword '{w}' linked to address {a}") for a, w in (("1 MAIN", "mom"), ("2 OAK", "mom"), ("1 MAIN", "tour"))} and set(placed.values()) == {(1, 15, "Medium")}
    mentions = {r["record_id"]: r["mentions"] for r in rules.mentions(rules.members(rules.configured({}), tables)).collect()}
    assert mentions["1"] == 3 and mentions["5"] == 2 and mentions["10"] == 3 and mentions["12"] == 1 and mentions["3"] == 2


def test_overrides(tables):
    config = {"shared_address_businesses": {"threshold": 2, "base_score": 40, "description": "Many"}, "keyword_frequency": {"enabled": False}, "known_pattern_addresses": {"base_score": 5}}
    some = rules.configured(config)
    assert "keyword_frequency" not in {r.name for r in some}
    got = {(r["rule"], r["key"]): (r["score"], r["level"], r["description"]) for r in rules.findings(some, tables).collect()}
    assert got["shared_address_businesses", "1 MAIN"] == (45, "High", "Many") and ("shared_address_businesses", None) not in got and got["known_pattern_addresses", "2 OAK"][:2] == (5, "Low")
    with pytest.raises(ValueError, match="nothing"):
        rules.configured({"nothing": {}})
    none = {k: v.limit(0) for k, v in tables.items()}
    assert rules.findings(some, none).count() == rules.members(some, none).count() == 0


def test_reports(spark):
    leads = spark.createDataFrame(
        [("CRITICAL", True, 2, "NETWORK", 90.0, 0.9, 50.0, "", "a|b", "High", 2), ("HIGH", False, 0, "ENTITY", 60.0, 0.5, 100.0, "x|y", "a", "VERY HIGH", 1), ("LOW", True, None, "ENTITY", None, 0.1, 0.0, "y", "a", "Low", 3)],
        "priority string, contains_real boolean, matches long, lead_type string, risk_score double, confidence_score double, completeness double, markers string, source_names string, confidence string, sources int",
    )
    (r,) = reports.investigation_summary(leads).collect()
    assert (r["total_leads"], r["critical_leads"], r["high_leads"], r["medium_leads"], r["low_leads"], r["real_data_leads"], r["synthetic_data_leads"], r["cross_source_leads"], r["entity_leads"], r["network_leads"]) == (3, 1, 1, 0, 1, 2, 1, 1, 2, 1)
    assert (r["average_risk"], r["average_confidence"], r["average_completeness"], r["most_common_markers"], r["most_common_source_combinations"]) == (50.0, 0.5, 50.0, "y|x", "a|a|b")
    (none,) = reports.investigation_summary(leads.limit(0)).collect()
    assert none["total_leads"] == 0 and none["average_risk"] == 0 and none["most_common_markers"] == ""
    markers, risk = spark.createDataFrame([(1.0,), (2.0,)], "score double"), spark.createDataFrame([("High", 0.5), ("Medium", 0.7), ("Low", None)], "risk_level string, mean_confidence double")
    (d,) = reports.dashboard_metrics(markers, leads, leads, risk, leads).collect()
    assert (d["total_markers"], d["avg_marker_score"], d["total_entities"], d["high_risk_entities"], d["medium_risk_entities"], d["avg_confidence"]) == (2, 1.5, 3, 1, 1, 0.4)
    assert (d["critical_leads"], d["high_priority_leads"], d["high_confidence_leads"], d["cross_source_leads"], d["newest_leads"]) == (1, 2, 2, 2, 3)
    matches = spark.createDataFrame([("REVIEW",), (" review ",), ("NO_MERGE",)], "decision string")
    (m,) = reports.resolution_metrics(leads, leads.limit(2), matches).collect()
    assert (m["raw_entities"], m["canonical_entities"], m["entities_merged"], m["review_candidates"]) == (3, 2, 1, 2)

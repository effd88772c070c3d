"""Filings to businesses, addresses, agents and officers."""

import json

from pyspark.sql import functions as F

from cairnlake.functions import parsing


def filing(number, name, address="100 Commerce Blvd, Tampa, FL 33602", people=(), **more):
    return {"corporation_number": number, "corporation_name": name, "status": "ACTIVE", "file_date": "2026-01-02", "principal_address": address, "mailing_address": "PO Box 500, Tampa", "registered_agent": {"name": "Agent Inc", "address": "1 Elm St"}, "officers": list(people), **more}


JOHN = {"name": "JOHN SMITH", "title": "MGR", "officer_type": "MANAGER", "position": "MANAGER", "address": "100 Commerce Blvd Apt 10, Tampa"}


def flat(spark, tmp_path, rows):
    (tmp_path / "filings.json").write_text("\n".join(json.dumps(r) for r in rows))
    return parsing.filings(spark.read.schema(parsing.FILING).json(str(tmp_path / "filings.json")))


def ids(frame):
    return sorted(r["officer_id"] for r in parsing.officers(frame).collect())


def test_rows(spark, tmp_path):
    got = flat(spark, tmp_path, [filing("L1", "ONE LLC"), filing("L1", "ONE AGAIN", file_date="2026-02-02"), filing(" ", "BLANK ONE"), filing(None, "BLANK TWO", address=None), filing("L2", "TWO", address={"line1": "5 Oak St", "city": "Tampa"})])
    rows = {r["corporation_name"]: r for r in got.collect()}
    # Filings without a number stay apart.
    assert set(rows) == {"ONE LLC", "BLANK ONE", "BLANK TWO", "TWO"} and rows["BLANK TWO"]["missing"] == "corporation_number|principal_address" and rows["BLANK ONE"]["incomplete"] and not rows["ONE LLC"]["incomplete"]
    assert rows["TWO"]["principal_address"] == "5 OAK ST, TAMPA" and rows["ONE LLC"]["agent_address"] == "1 ELM ST"


def test_officers_are_told_apart_and_stable(spark, tmp_path):
    mary = JOHN | {"name": "MARY ROE"}
    first = ids(flat(spark, tmp_path, [filing("L1", "ONE", people=[JOHN, mary, JOHN]), filing("L2", "TWO", people=[JOHN]), filing("", "NO NUMBER", people=[JOHN])]))
    again = ids(flat(spark, tmp_path, [filing("L2", "TWO", people=[JOHN]), filing("L1", "ONE", people=[JOHN, JOHN, mary, {"name": " "}])]))
    assert first == again and len(first) == 4 and sum(i.startswith("person:sunbiz_daily:L1:officer:") for i in first) == 3
    changed = ids(flat(spark, tmp_path, [filing("L2", "TWO", people=[JOHN | {"title": "CEO"}])]))
    assert not set(changed) & set(first)


def test_entities_and_edges(spark, tmp_path):
    frame = flat(spark, tmp_path, [filing("L1", "ONE", people=[JOHN]), filing("L2", "TWO", people=[JOHN | {"address": ""}], registered_agent=None), filing("", "NONE", people=[JOHN])])
    entities = {r["entity_id"]: r for r in parsing.filing_entities(frame).collect()}
    kinds = sorted(r["entity_type"] for r in entities.values())
    assert kinds == ["address"] * 4 + ["business"] * 2 + ["officer"] * 2 + ["registered_agent"]
    assert entities["business:sunbiz_daily:L1"]["display_name"] == "ONE" and entities["address:PO BOX 500, TAMPA"]["source_record_id"] == "L1:mailing"
    edges = parsing.filing_edges(frame)
    counts = {r["kind"]: r["count"] for r in edges.groupBy("kind").count().collect()}
    assert counts == {"BUSINESS_PRINCIPAL_ADDRESS": 2, "BUSINESS_LOCATED_AT": 2, "BUSINESS_MAILING_ADDRESS": 2, "REGISTERED_AGENT_FOR": 1, "REGISTERED_AGENT_ASSOCIATED_WITH_ADDRESS": 1, "REGISTERED_AGENT_AT_ADDRESS": 1, "OFFICER_OF": 2, "OFFICER_ASSOCIATED_WITH_ADDRESS": 1, "OFFICER_AT_ADDRESS": 1}
    assert {r[0] for r in edges.select(F.explode(F.array("src", "dst"))).collect()} <= set(entities)
    assert parsing.filing_entities(frame.limit(0)).count() == parsing.filing_edges(frame.limit(0)).count() == 0

"""Packets, timelines, texts and the workbench against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import leads, packets
from cairnlake.operators.workflow import UPDATES_DDL, Workbench

LEADS = [("L1", "b1", "Acme", "2024-06-01", "s|t"), ("L2", "a1", "1 Main", "2024-06-01", ""), ("L3", "zz", "Alone", "2024-06-01", "s")]
ENTITIES = [("b1", "Acme"), ("a1", "1 Main"), ("o1", "Ann")]
EDGES = [("r1", "b1", "a1", "LOCATED_AT", "s", "api", "2024-01-02"), ("r2", "o1", "b1", "OFFICER_OF", "u", "api", ""), ("r3", "b1", "b1", "SAME", "s", "api", "2024-01-01"), ("r4", "b1", "gone", "USES_PHONE", "v", "api", "2023-05-05")]
MARKERS = [("b1", "m1", "shared_phone", "s|w", "why"), ("b1", "m2", "bridge_entity", "s", "why"), ("a1", "m3", "mailbox", "t", "why")]


@pytest.fixture
def made(spark):
    return (
        spark.createDataFrame(LEADS, "lead_id string, entity_id string, name string, generated string, source_name string"),
        spark.createDataFrame(EDGES, "relationship_id string, src string, dst string, kind string, source_name string, source_type string, imported_at string"),
        spark.createDataFrame(MARKERS, "entity_id string, marker_id string, marker string, sources string, explanation string"),
        spark.createDataFrame([("b1", "ACME CO"), ("b1", "ACME"), ("b1", "ACME"), ("b1", "")], "canonical_id string, alias string"),
        spark.createDataFrame(ENTITIES, "entity_id string, display_name string"),
    )


def test_packets(made):
    found, edges, fired, aliases, entities = made
    got = {r["lead_id"]: r for r in packets.packets(found, edges, fired, aliases, entities, 3).collect()}
    one, two, three = got["L1"], got["L2"], got["L3"]
    assert (one["n_aliases"], one["n_markers"], one["n_relationships"], one["n_connected"], one["n_events"]) == (2, 2, 4, 4, 6)
    assert (one["aliases"], one["markers"], one["relationship_kinds"], one["sources"]) == ("ACME | ACME CO", "bridge_entity|shared_phone", "LOCATED_AT|OFFICER_OF|SAME|USES_PHONE", "s|t|u|v|w")
    assert one["connected"] == "1 Main | Acme | Ann" and one["record_ids"] == "m1 | m2 | r1"
    assert one["timeline"] == "2023-05-05: Phone usage | 2024-01-01: SAME | 2024-01-02: Business location"
    assert (two["n_relationships"], two["connected"], two["sources"]) == (1, "Acme", "s|t") and (three["n_events"], three["timeline"], three["sources"]) == (0, "", "s")
    assert packets.packets(found.limit(0), edges, fired, aliases, entities).count() == 0


def test_timelines(made):
    found, edges, fired, _, entities = made
    rows = {(r["lead_id"], r["record_id"]): r for r in packets.timelines(found, edges, fired, entities).collect()}
    assert len(rows) == 8 and rows["L1", "r2"]["date"] == "2024-06-01" and rows["L1", "r2"]["evidence"] == "Acme linked to Ann via OFFICER_OF"
    assert rows["L1", "r4"]["evidence"] == "Acme linked to gone via USES_PHONE" and rows["L2", "m3"]["event"] == "Fraud marker: mailbox" and rows["L2", "r1"]["event"] == "Business location"


def test_kinds_and_texts(spark):
    rows = spark.createDataFrame([("address", 1, 9, "phone"), ("address", 0, 9, ""), ("Property", 0, 0, ""), ("email", 0, 0, ""), ("business", 0, 9, ""), ("person", 0, 5, ""), ("person", 0, 4, "shared_email"), (None, 0, 0, None)], "t string, m int, e int, k string")
    kind = leads.lead_type(F.col("t"), F.col("m"), F.col("e"))
    got = [r[0] for r in rows.select(kind).collect()]
    assert got == ["CROSS_SOURCE_CLUSTER", "ADDRESS_CLUSTER", "PROPERTY_CLUSTER", "COMMUNICATION_CLUSTER", "BUSINESS_CLUSTER", "TEMPORAL_CLUSTER", "ENTITY", "ENTITY"]
    few = [r[0] for r in rows.select(leads.lead_type(F.col("t"), F.col("m"), F.col("e"), ("ENTITY", "TEMPORAL_CLUSTER"))).collect()]
    assert few == ["TEMPORAL_CLUSTER", "TEMPORAL_CLUSTER", "ENTITY", "ENTITY", "TEMPORAL_CLUSTER", "TEMPORAL_CLUSTER", "ENTITY", "ENTITY"]
    said = [r[0] for r in rows.select(leads.recommendation(kind, F.col("t"), F.col("k"), F.lit(59))).collect()]
    assert said[0].startswith("Verify whether") and said[5].startswith("Review formation") and said[6].startswith("Review all entities") and said[7] == leads.RECOMMENDED[""] + leads.VALIDATE_FIRST
    assert not rows.select(leads.recommendation(kind, F.col("t"), F.col("k"), F.lit(60))).first()[0].endswith(leads.VALIDATE_FIRST)
    one = lambda c: rows.limit(1).select(c).first()[0]
    assert one(leads.why_flagged(F.lit("a"), F.lit("b"), F.lit(2))) == "Rules: a | Evidence: b | Matched 2 anomaly findings" and one(leads.why_flagged(F.lit(""), F.lit(None), F.lit(0))).startswith("High-risk")
    assert one(leads.review_action(F.lit("Shared Phone, x"))).startswith("Verify phone") and one(leads.review_action(F.lit(None))).startswith("Conduct")
    assert one(leads.risk_explanation(F.lit("a"), F.lit(3), F.lit(0), F.lit(True), F.lit("m"))) == "Markers: a | Relationships: 3 | Cross-source correlation detected | Top marker: m"


def updates(spark, rows):
    return spark.createDataFrame([(i, at, n, seen, action, who, ch) for n, (i, at, seen, action, who, ch) in enumerate(rows)], UPDATES_DDL)


def events(bench, lead):
    return [(r["event_type"], r["previous_status"], r["new_status"], r["note"]) for r in bench.history().where(F.col("lead_id") == lead).orderBy("batch", "nth").collect()]


def test_workbench(spark, tmp_path):
    bench = Workbench(spark, f"file://{tmp_path}/bench")
    assert bench.state().count() == bench.history().count() == 0
    bench.create(spark.createDataFrame([("a", "A"), ("b", "B"), ("a", "again"), (" ", "")], "lead_id string, title string"), "t0", 0)
    bench.apply(updates(spark, [
        ("a", "t2", None, "UPDATE", "Bo", {"status": "IN_REVIEW", "analyst_notes": "look", "bad": "x"}), ("a", "t3", "t2", "UPDATE", "", {"status": "CLOSED", "reviewer": "Cy"}),
        ("a", "t4", "t2", "UPDATE", "Di", {"status": "NEW"}), ("c", "t1", None, "UPDATE", "", {"status": "NEW"}), ("a", "t5", None, "EXPORT", "Ed", None),
    ]), 1)
    state = {r["lead_id"]: r for r in bench.state().collect()}
    assert set(state) == {"a", "b", "c"} and (state["a"]["status"], state["a"]["reviewer"], state["a"]["analyst_notes"], state["a"]["updated_at"], state["a"]["last_exported_at"]) == ("CLOSED", "Cy", "look", "t5", "t5")
    assert (state["b"]["status"], state["b"]["updated_at"], state["b"]["needs_review"]) == ("NEW", "t0", "true") and state["c"]["updated_at"] == "t1"
    # The update whose author had seen an older version is refused; nothing of it stays.
    assert events(bench, "a") == [("CREATED", "", "NEW", ""), ("STATUS_CHANGED", "NEW", "IN_REVIEW", "look"), ("NOTE_ADDED", "NEW", "IN_REVIEW", "look"), ("STATUS_CHANGED", "IN_REVIEW", "CLOSED", ""), ("REFUSED", "CLOSED", "CLOSED", ""), ("EXPORTED", "", "", "")]
    bench.create(spark.createDataFrame([("a", "A"), ("d", "D")], "lead_id string, title string"), "t6", 2)
    assert events(bench, "a")[0][0] == "CREATED" and sum(e[0] == "CREATED" for e in events(bench, "a")) == 1 and bench.state().count() == 4


def test_a_batch_that_failed_is_replaced(spark, tmp_path, monkeypatch):
    bench = Workbench(spark, f"file://{tmp_path}/bench")
    bench.create(spark.createDataFrame([("a", "A")], "lead_id string, title string"), "t0", 0)
    one = updates(spark, [("a", "t1", None, "UPDATE", "", {"status": "CLOSED"})])
    with monkeypatch.context() as m:
        m.setattr(Workbench, "_commit", lambda self, batch, state, found: found.write.mode("overwrite").parquet(f"{self.folder}/history/batch={batch}"))
        bench.apply(one, 1)  # ends between history and state
    assert events(bench, "a") == [("CREATED", "", "NEW", "")] and bench.state().first()["status"] == "NEW"
    for _ in range(2):
        Workbench(spark, f"file://{tmp_path}/bench").apply(one, 1)
        assert events(bench, "a")[1:] == [("STATUS_CHANGED", "NEW", "CLOSED", "")] and bench.state().first()["status"] == "CLOSED"


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, said, checkpoint = f"file://{tmp_path}/bench", str(tmp_path / "updates"), f"file://{tmp_path}/checkpoint"
    bench = Workbench(spark, folder)
    bench.create(spark.createDataFrame([("a", "A")], "lead_id string, title string"), "t0", 0)
    for n, status in enumerate(("IN_REVIEW", "CLOSED", "NEW")):
        updates(spark, [("a", f"t{n + 1}", None, "UPDATE", "", {"status": status})]).coalesce(1).write.mode("append").parquet(said)
        stream = spark.readStream.schema(UPDATES_DDL).option("maxFilesPerTrigger", 1).parquet(said)
        Workbench(spark, folder).stream(stream, checkpoint).awaitTermination()  # a new run each time
        assert bench.state().first()["status"] == status
    assert [e[1:3] for e in events(bench, "a")[1:]] == [("NEW", "IN_REVIEW"), ("IN_REVIEW", "CLOSED"), ("CLOSED", "NEW")] and bench.last() == 3

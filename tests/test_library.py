"""Normalisers, scores, graph algorithms, sources and sinks on small rows."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import scores, sets
from cairnlake.functions import text as X
from cairnlake.operators import correlation, graph, leads, resolution, stats
from cairnlake.sources import connectors, files, pages, provenance, sinks, synthetic


def values(spark, make, given, kind="string"):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalisers(spark):
    assert values(spark, X.clean_text, [" a.b,c ", "Año #4", None]) == ["A B C", "AÑO #4", ""]
    assert values(spark, X.phone_digits, ["1 (305) 555-0101", "305.555.0101 ext 22", "555-0101", None, "+1 (850) 555-1234"]) == ["3055550101", "3055550101X22", None, None, "8505551234"]
    assert values(spark, X.email_address, [" A.b@Mail.Example.COM ", "nope@", None]) == ["a.b@mail.example.com", None, None]
    assert values(spark, X.website_key, ["https://www.Site.com:8080/A/?q=1#x", "site.com", "", None]) == ["site.com:8080/a", "site.com", None, None]
    assert values(spark, X.business_name, ["Acme, L.L.C.", "ACME HOLDINGS CO INC", "LLC", None]) == ["ACME", "ACME HOLDINGS", "", ""]
    assert [r["full"] for r in values(spark, X.person_name, ["John Q. Public Jr.", "Cher", "Ann Lee, MD, V", "Dr Bo MD Wu PhD", "", None])] == ["JOHN PUBLIC", "CHER CHER", "ANN LEE", "DR PHD", "", ""]
    a = values(spark, X.address_key, ["12 North Main Street, Apt. 4, Miami FL 33101-1234", "12 N MAIN ST #4 MIAMI FL 33101"])
    assert [(r["house_number"], r["unit"]) for r in a] == [("12", "4"), ("12", "4")] and a[1]["building"] == "12 N MAIN ST MIAMI FL 33101"
    same = values(spark, X.address_key, ["123 Main Street Apt 2, Pensacola, FL 32502", "123 MAIN ST #2 Pensacola FL 32502", "123 Main Street Apt 3, Pensacola, FL 32502", "9 Room Rd 12345-6789 Unit 4 Ste 5", "", None])
    assert same[0] == same[1] and same[0]["text"] != same[2]["text"] and same[0]["building"] == same[2]["building"] and same[0]["zip"] == "32502"
    assert (same[3]["building"], same[3]["unit"], same[3]["zip"]) == ("9 ROOM RD 12345-6789 STE 5", "4", "12345") and same[4]["building"] == same[5]["text"] == ""
    lines = {"123 Main St, Pensacola, FL 32501": "123 MAIN ST, PENSACOLA, FL 32501", " p.o. box 7 ,Miami": "PO BOX 7, MIAMI", "P O Box 7": "PO BOX 7", "9 County Road 5 Apartment 2,": "9 CR 5 APT 2", "1 North Highway, X 33101-9999": "1 N HWY, X 33101", "": ""}
    assert values(spark, X.address_line, list(lines)) == list(lines.values())
    contexts = values(spark, X.address_context, ["123 Main St Apt 4B, Tampa, FL 33602", "900 Commerce Plaza", "PO BOX 5", "", None])
    assert [(c["context"], c["unit"]) for c in contexts] == [("EXACT_APARTMENT_OR_UNIT", "APT 4B"), ("COMMERCIAL_PROPERTY", ""), ("VIRTUAL_OFFICE_OR_MAILBOX", ""), ("UNKNOWN", ""), ("UNKNOWN", "")]
    assert values(spark, X.property_key, ["parcel:01-22 a", "7-7"]) == ["0122A", "77"]
    assert values(spark, X.source_kind, ["County ArcGIS api", "local file", "x"]) == ["arcgis", "connector", "unknown"]
    assert values(spark, X.parse_bool, ["Yes", "0", None]) == [True, False, False]
    assert values(spark, X.to_number, ["1.5", "x", None]) == [1.5, 0.0, 0.0]
    assert values(spark, X.slug, ["A  b/C!", None]) == ["a-b-c", ""]


def test_token_sets(spark):
    assert values(spark, sets.tokens, ["b| a ||b", None]) == [["b", "a"], []]
    rows = spark.createDataFrame([(1, 2, "c|a"), (1, 1, "b|c"), (1, 3, " |10")], "k int, o int, v string")
    assert rows.groupBy("k").agg(sets.merge_tokens(F.col("v"), F.col("o")).alias("m")).first()["m"] == "b|c|a|10"


def test_poisson_tail(spark):
    rows = spark.createDataFrame([(0, 2.0), (3, 2.0), (7, 1.5), (40, 30.0), (0, 0.0), (2, 0.0)], "k int, rate double")
    got = [r["p"] for r in rows.select(scores.poisson_at_least(F.col("k"), F.col("rate")).alias("p")).collect()]
    for p, (k, rate) in zip(got[:4], [(0, 2.0), (3, 2.0), (7, 1.5), (40, 30.0)], strict=True):
        assert p == pytest.approx(1 - sum(math.exp(-rate) * rate**v / math.factorial(v) for v in range(k)), abs=1e-12)
    assert got[4:] == [1.0, None]


def test_scores_and_bands(spark):
    row = spark.range(1).select(
        scores.weighted_flags({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(True)}, {"a": 0.5, "b": 0.4, "c": 0.7}).alias("w"),
        scores.banded(F.lit(72), scores.RISK_BANDS, "None").alias("b"),
        scores.explain_flags({"x": F.lit(True), "y": F.lit(False)}).alias("e"),
        scores.adjusted(F.lit(18), F.lit(-30), F.lit("ELEVATED_REVIEW")).alias("a"),
        scores.rarity(F.lit(0.001), F.lit(0.5), F.lit(None).cast("double")).alias("r"),
    ).first()
    assert (row["w"], row["b"], row["e"], row["a"]) == (1.0, "High", "x", 12) and row["r"] == pytest.approx(75)


def components_by_hand(vertices, edges):
    head = {v: v for v in vertices}
    for _ in vertices:
        for a, b in edges:
            head[a] = head[b] = min(head[a], head[b])
    return head


def test_components_of_long_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(50)] + [(300, 300)]
    vertices = sorted({v for e in edges for v in e} | {999})
    got = graph.connected_components(spark.createDataFrame([(v,) for v in vertices], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == components_by_hand(vertices, edges)


def test_articulation_points_by_removal():
    rng = random.Random(2)
    for _ in range(30):
        edges = {tuple(sorted(rng.sample(range(9), 2))) for _ in range(rng.randint(3, 14))}
        adjacent = {}
        for a, b in edges:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
        adjacent = {k: sorted(v) for k, v in sorted(adjacent.items())}
        want = {}
        for v in adjacent:
            comp = {w for w, c in components_by_hand(adjacent, edges).items() if c == components_by_hand(adjacent, edges)[v]} - {v}
            groups = len(set(components_by_hand(sorted(comp), [e for e in edges if v not in e and set(e) <= comp]).values()))
            if groups > 1:
                want[v] = groups
        assert graph.articulation_groups(adjacent) == want


def test_communities_and_metrics(spark):
    clique = lambda ids: list(itertools.combinations(ids, 2))
    edges = clique(range(5)) + clique(range(10, 15)) + [(4, 10)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    comps = graph.connected_components(frame.select(F.col("src").alias("id")).union(frame.select("dst")), frame)
    got = {r["id"]: r["community"] for r in graph.communities(frame, comps).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(11, 15)}) == 1 and got[0] == 0
    assert {(r["id"], r["groups"]) for r in graph.articulation_points(frame, comps).collect()} == {(4, 2), (10, 2)}
    (m,) = graph.network_metrics(comps, frame).collect()
    assert (m["members"], m["relationships"], m["density"], m["size_label"]) == (10, 21, round(42 / 90, 4), "Medium")


def test_blocking_skips_large_blocks_and_decides(spark):
    rows = spark.createDataFrame([(i, "big") for i in range(6)] + [(10, "two"), (11, "two"), (11, "two"), (12, "one")], "id long, k string")
    assert [tuple(r) for r in resolution.candidate_pairs(rows, ["k"], "id", most=5).collect()] == [(10, 11)]
    names = spark.createDataFrame([("tide",), ("diet",), ("tides",)], "n string").withColumn("b", F.lit(1))
    assert {(r["left_id"], r["right_id"]) for r in resolution.fuzzy_pairs(names, ["b"], "n", "n", 0.8).collect()} == {("tide", "tides")}
    keys = lambda kind, given: values(spark, lambda v: resolution.block_keys(F.lit(kind), X.normalized(F.lit(kind), v, F.lit("x"))), given)
    assert keys("business", ["Acme Holdings LLC", ""]) == [["exact:ACME HOLDINGS", "name:ACME HOL", "fuzzy-name:ACM"], []]
    assert keys("person", ["Jane Q. Doe"]) == [["exact:JANE DOE", "surname:DOE", "fuzzy-name:JAN", "fuzzy-person:J:DO"]] and keys("owner", ["Jane Doe"]) == [["exact:JANE DOE"]]
    assert keys("address", ["1 Main St Unit 2, Miami 33101"]) == [["exact:1 MAIN ST MIAMI 33101 UNIT 2", "building:1 MAIN ST MIAMI 33101", "zipnum:33101:1"]]


def test_rolling_peak_and_robust_scores(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-08", "2024-02-20"]
    rows = spark.createDataFrame([("k", d) for d in days], "k string, d string").select("k", F.col("d").cast("timestamp").alias("ts"))
    r = stats.rolling_peaks(rows, "k", "ts", (3, 7, 30)).first()
    assert (r["peak_3"], r["peak_7"], r["peak_30"]) == (2, 3, 3)
    scored = stats.robust_scores(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 100.0), ("b", 5.0)], "g string, v double"), ["g"], "v").collect()
    by = {(x["g"], x["v"]): (x["robust_z"], x["iqr_score"]) for x in scored}
    assert by[("b", 5.0)] == (None, None) and by[("a", 100.0)][0] == pytest.approx(0.6745 * 97.5 / 1.0) and by[("a", 100.0)][1] > 0


def test_leads(spark):
    state = spark.createDataFrame([(1, "CLOSED", 2)], "lead_id int, status string, notes int")
    ids = spark.createDataFrame([(1,), (2,)], "lead_id int")
    merged = leads.merge_state(ids, state, "lead_id", {"status": "NEW", "notes": 0})
    assert sorted(map(tuple, merged.collect())) == [(1, "CLOSED", 2), (2, "NEW", 0)]
    assert sorted(map(tuple, leads.history(state, merged.withColumn("status", F.lit("OPEN")), "lead_id", "status").collect())) == [(1, "STATUS_CHANGED", "CLOSED", "OPEN"), (2, "CREATED", None, "OPEN")]


def test_provider_matching(spark):
    providers = spark.createDataFrame([(1, "Acme Clinic LLC", "12 Main St Suite 5, Miami FL 33101", True), (2, "Other", "PO Box 7, Miami FL 33101", True)], "npi int, name string, address string, active boolean")
    registry = spark.createDataFrame([("a", "ACME CLINIC", "12 Main Street Ste 5 Miami FL 33101"), ("b", "Zeta", "12 MAIN ST MIAMI FL 33101"), ("c", "OTHER", "PO BOX 7 MIAMI FL 33101")], "entity_id string, name string, address string")
    got = {(r["npi"], r["entity_id"]): (r["scope"], r["score"], r["decision"]) for r in correlation.provider_matches(providers, registry).collect()}
    assert got[(1, "a")] == ("EXACT_BUILDING", 0.72, "REVIEW_STRONG") and got[(1, "b")] == ("EXACT_BUILDING", 0.76, "REVIEW_STRONG") and got[(2, "c")][::2] == ("PO_BOX", "REJECTED")


def test_parcels_and_three_source_paths(spark):
    providers = spark.createDataFrame([(1, "Bay Clinic", "12 Main St Apt 5, Miami, FL", True), (2, "Ann Lee", "9 Oak Rd, Miami", False), (3, "Bay Clinic", "", True), (4, "Ann Lee", "PO Box 7", False)], "npi int, name string, address string, organization boolean")
    entities = spark.createDataFrame([("property:P1", "property", "P1"), ("property:P2", "property", "P2"), ("a1", "address", "12 MAIN ST APT 5, MIAMI, FL"), ("a2", "address", "9 OAK RD, MIAMI"), ("a3", "address", "PO BOX 7"), ("o1", "owner", "Ann Lee"), ("o2", "owner", "Bay Clinic")], "entity_id string, entity_type string, display_name string")
    edges = spark.createDataFrame([("r1", "property:P1", "a1", correlation.SITUS), ("r2", "property:P1", "a2", correlation.PARCEL_MAILING), ("r3", "property:P2", "a3", correlation.SITUS), ("r4", "property:P2", "o1", correlation.OWNED), ("r5", "property:P2", "a1", "OTHER")], "relationship_id string, src string, dst string, kind string")
    legs = correlation.parcel_matches(providers, entities, edges)
    got = {(r["npi"], r["parcel_id"], r["match_type"]): (r["scope"], r["confidence"], r["decision"]) for r in legs.collect()}
    assert got == {
        (1, "P1", "PROVIDER_PRACTICE_ADDRESS_TO_PARCEL_SITUS"): ("EXACT_UNIT", 0.8, "REVIEW_STRONG"), (2, "P1", "PROVIDER_MAILING_ADDRESS_TO_PARCEL_MAILING"): ("MAILING_ONLY", 0.16, "REJECTED"),
        (4, "P2", "PROVIDER_PRACTICE_ADDRESS_TO_PARCEL_SITUS"): ("PO_BOX", 0.0, "REJECTED"), (2, "P2", "PROVIDER_NAME_TO_PARCEL_OWNER"): ("INCOMPLETE", 0.12, "REJECTED"), (4, "P2", "PROVIDER_NAME_TO_PARCEL_OWNER"): ("INCOMPLETE", 0.12, "REJECTED"),
    }
    registry = spark.createDataFrame([(1, "b9", "EXACT_BUILDING", 0.95, "ACCEPTED_EXACT"), (1, "b8", "INCOMPLETE", 0.95, "ACCEPTED_EXACT"), (2, "b7", "EXACT_UNIT", 0.99, "ACCEPTED_EXACT")], "npi int, entity_id string, scope string, score double, decision string")
    assert [tuple(r) for r in correlation.three_source_paths(registry, legs).collect()] == [("nppes-path:1:b9:property:P1", 1, "b9", "property:P1", 0.8, "REVIEW_STRONG")]
    types = spark.createDataFrame([(True, False, "business"), (False, True, "officer"), (False, False, "registered_agent"), (True, False, "address"), (True, True, "address"), (False, False, "business")], "o boolean, m boolean, t string")
    assert [r[0].split("_TO_")[0] for r in types.select(correlation.registry_match_type(F.col("o"), F.col("m"), F.col("t"))).collect()] == ["NPI_ORGANIZATION", "NPI_PROVIDER_NAME", "NPI_AUTHORIZED_OFFICIAL", "NPI_PRACTICE_ADDRESS", "NPI_MAILING_ADDRESS", "NPI_ORGANIZATION_ADDRESS"]


def test_csv_sources_and_connectors(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Folio,Owner Name,SITUS ADDRESS,Mailing Address\n 1 ,"Doe, Jane",1 A St,\n,,,\n2,Doe Co,1 A St,PO BOX 4\n')
    rows = connectors.PARCELS.read(spark, str(tmp_path / "p.csv"))
    assert sorted((r["parcel_id"], r["owner"], r["source_type"], r["is_synthetic"]) for r in rows.collect()) == [("1", "Doe, Jane", "connector", "false"), ("2", "Doe Co", "connector", "false")]
    assert {r["entity_id"] for r in connectors.PARCELS.to_entities(rows).collect()} == {"property:1", "property:2", "owner:DOE, JANE", "owner:DOE CO", "address:1 A ST", "address:PO BOX 4"}
    assert {(r["src"], r["dst"], r["kind"]) for r in connectors.PARCELS.to_edges(rows).collect()} >= {("property:2", "address:PO BOX 4", "PROPERTY_HAS_MAILING_ADDRESS"), ("property:1", "owner:DOE, JANE", "PROPERTY_OWNED_BY")}
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).columns == ["a"]
    with pytest.raises(files.ValidationError):
        files.validate(rows, ["nope"])
    with pytest.raises(ValueError):
        provenance.ensure_local("https://example.com/x.csv")
    assert provenance.readiness({"source_name": "a", "source_type": "api", "path": "p"}, False) == "MISSING_INPUT"
    typed = spark.createDataFrame([("api|synthetic",), ("synthetic",)], "source_type string")
    assert provenance.in_scope(typed, "REAL_ONLY").count() == provenance.in_scope(typed, "SYNTHETIC_ONLY").count() == 1


def test_json_envelopes(spark, tmp_path):
    for name, body in {"a": [{"id": "1"}], "b": {"results": [{"id": "2"}]}, "c": {"result": {"items": [{"id": "3"}]}}, "d": {"id": "4"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert sorted(r["id"] for r in files.read_envelopes(spark, str(tmp_path), files.text_schema(["id"])).collect()) == ["1", "2", "3", "4"]
    rows = spark.createDataFrame([("1", "Main", None, "x")], "n string, s string, u string, z string")
    assert files.project(rows, {"address": ["n", "s", "u"], "z": "z"}).first()["address"] == "1, Main"


def test_pages_and_polling():
    client = pages.PageClient(lambda page, size: [{"id": (page * size + i) % 25} for i in range(size)], "id", page_size=10, max_pages=4)
    assert [r["id"] for r in client.records()] == list(range(25)) and client.truncated
    answers = iter([(202, {}, 1.0), (429, {}, 2.0), (200, {"ok": 1}, 0.0)])
    waits = []
    assert pages.poll(lambda: next(answers), sleep=waits.append) == {"ok": 1} and waits == [1.0, 2.0]


def test_sinks(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([], "a int, b int"), str(tmp_path / "e"))
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("part-*")) == "a,b\n"
    rows = spark.createDataFrame([(1, "HIGH", "x|y"), (2, "LOW", "z")], "lead_id int, priority_level string, t string")
    sinks.lead_packages({"facts": rows}, rows, str(tmp_path / "p"))
    assert [p.name for p in (tmp_path / "p/facts").glob("lead_id=*")] == ["lead_id=1"]
    out = sinks.report(rows, ["lead_id"], 1)
    assert json.loads(out["json"])[0]["lead_id"] == 1 and "x\\|y" in out["md"] and "<td>HIGH</td>" in out["html"]


def test_synthetic_clusters(spark):
    made = synthetic.businesses(spark, 100)
    assert made.groupBy("address").count().where("count >= 4").count() == 5
    assert made.collect() == synthetic.businesses(spark, 100).collect()


def test_stream_of_events(spark, tmp_path):
    from cairnlake.streaming import events

    rows = spark.createDataFrame([(i, f"2024-01-{1 + i % 20:02d}", i % 3, 1.0) for i in range(60)], "event_id int, d string, user_id int, value double")
    rows = rows.select("event_id", F.col("d").cast("timestamp").alias("ts"), "user_id", "value")
    rows.union(rows.limit(5)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.without_repeats(events.read_events(spark, str(tmp_path / "in"), rows.schema, 1), "event_id", "ts", "30 days")
    events.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60

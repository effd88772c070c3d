"""The whole ladder of pair decisions, and what it merges."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from cairnlake.operators import resolution, similarity

PAIRS = [  # (type, names, parcels, shared evidence, method, decision)
    ("phone", "3055550101", "3055550101", "", "", False, "exact_phone", "AUTO_MERGE"),
    ("phone", "3055550101", "7865550199", "", "", False, "candidate_only", "NO_MERGE"),
    ("email", "a@b.com", "a@b.com", "", "", False, "exact_email", "AUTO_MERGE"),
    ("website", "b.com", "b.com", "", "", False, "exact_website", "AUTO_MERGE"),
    ("property", "LOT 1", "BLOCK 9", "01-22", "01-22", False, "exact_property_parcel", "AUTO_MERGE"),
    ("address", "12 N MAIN ST MIAMI FL 33101", "12 N MAIN ST MIAMI FL 33101", "", "", False, "exact_address", "AUTO_MERGE"),
    ("address", "12 N MAIN ST #4 MIAMI FL 33101", "12 N MAIN ST #5 MIAMI FL 33101", "", "", True, "shared_building_different_unit", "NO_MERGE"),
    ("business", "ACME", "ACME", "", "", True, "exact_name_plus_secondary", "AUTO_MERGE"),
    ("business", "ACME", "ACME", "", "", False, "exact_name_requires_secondary_review", "REVIEW"),
    ("business", "ACME HOLDINGS", "ACME HOLDING", "", "", True, "fuzzy_name_plus_secondary", "REVIEW"),
    ("business", "ACME HOLDINGS", "ACME HOLDING", "", "", False, "fuzzy_name_only", "NO_MERGE"),
    ("person", "ANN LEE", "BO WU", "", "", True, "candidate_only", "NO_MERGE"),
    ("business", "", "", "", "", False, "candidate_only", "NO_MERGE"),
]


def test_every_rung_of_the_ladder(spark):
    entities, keys, evidence = [], [], []
    for i, (kind, left, right, one, other, shared, *_) in enumerate(PAIRS):
        entities += [(f"{i:02}a", kind, left, "s", one), (f"{i:02}b", kind, right, "s", other)]
        keys += [(f"{i:02}a", str(i)), (f"{i:02}b", str(i))]
        evidence += [(f"{i:02}{x}", f"v{i}" if shared else f"v{i}{x}") for x in "ab"]
    entities = spark.createDataFrame(entities, "entity_id string, entity_type string, name string, source_name string, parcel string")
    keys, evidence = spark.createDataFrame(keys, "entity_id string, key string"), spark.createDataFrame(evidence, "entity_id string, value string")
    got = {r["left_id"]: (r["method"], r["decision"]) for r in resolution.match_decisions(entities, keys, evidence).collect()}
    assert got == {f"{i:02}a": pair[-2:] for i, pair in enumerate(PAIRS)}
    clusters = {r["entity_id"]: r["cluster"] for r in resolution.resolve(entities, keys, evidence).collect()}
    assert clusters == {f"{i:02}{x}": f"{i:02}a" if pair[-1] == "AUTO_MERGE" else f"{i:02}{x}" for i, pair in enumerate(PAIRS) for x in "ab"}


def test_similar_names_of_a_large_block(spark):
    names = [f"{chr(65 + i % 26)}{chr(65 + i // 26)} HOLDINGS {i:03} OF MIAMI" for i in range(230)]
    rows = spark.createDataFrame([(n, n, "a") for n in names] + [("ACME ONE", "ACME ONE", "b"), ("ACME ONES", "ACME ONES", "b")], "id string, name string, block string")
    got = sorted((r["left_id"], r["right_id"], r["ratio"]) for r in similarity.alike(rows, "block", "id", "name", 0.86).collect())
    want = [(a, b, round(SequenceMatcher(None, a, b).ratio(), 4)) for a, b in combinations(sorted(names), 2)] + [("ACME ONE", "ACME ONES", round(16 / 17, 4))]
    assert got == sorted(w for w in want if w[2] >= 0.86) and len(got) > 1
    pairs = resolution.block_pairs(rows, ["block"], "id", part=40).collect()
    assert {tuple(p) for p in pairs} == {*combinations(sorted(names), 2), ("ACME ONE", "ACME ONES")}


@pytest.mark.parametrize("least", [0.5, 0.75, 0.8, 0.86, 0.95])
def test_alike_names_are_those_of_all_pairs(spark, least):
    draw = random.Random(7)
    stems = ["ACME HOLDINGS", "BLUE OCEAN TRADING", "GULF COAST REALTY", "A", "AB", "ABC", "QZ", "SUNSHINE STATE LLC", "ÉTÉ", "", "AAAA", "AAAAAA"]
    def spoiled(s):
        s = list(s)
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(s))
            s[at:at + draw.randint(0, 1)] = draw.choice(["", "X", "AB", " ", "Q"])
        return "".join(s)
    rows = [(f"e{i:03}", spoiled(draw.choice(stems)), f"b{i % 3}") for i in range(330)] + [("e000", "TWO NAMES", "b0"), ("e999", "two blocks", "b0"), ("e999", "two blocks", "b1")]
    frame = spark.createDataFrame(rows, "id string, name string, block string")
    got = {(r["block"], r["left_id"], r["right_id"]): r["ratio"] for r in similarity.alike(frame, "block", "id", "name", least).collect()}
    want = {}
    for (i, a, x), (j, b, y) in combinations(sorted(set(rows)), 2):
        if x == y and i != j and a and b and (r := SequenceMatcher(None, a, b).ratio()) >= least:
            want[x, i, j] = max(want.get((x, i, j), 0), round(r, 4))
    assert got == want and len(got) > 100


def test_few_pairs_are_compared(spark):
    draw = random.Random(9)
    names = sorted({"".join(draw.choices("ABCDEFGHIJKLMNOPRSTUVWY", k=draw.randint(6, 10))) + " " + draw.choice(["TRADING", "HOLDINGS", "REALTY", "SERVICES"]) for _ in range(1500)})
    frame = spark.createDataFrame([("b", n) for n in names], "block string, name string")
    share = similarity.candidates(frame, 0.86).count() / (len(names) * (len(names) - 1) / 2)
    assert share < 0.2  # names of random letters; rare tokens part real ones better


def test_names_without_rare_characters_are_parted_by_segments(spark):
    """Letters that all names share don't part them: the names that meet grow with the block, the pairs with its square."""
    met = []
    for n in (300, 1200):
        draw = random.Random(3)
        names = sorted({"".join(draw.choices("0123456789abcdef", k=12)) for _ in range(n)})
        names += [x[:4] + "x" + x[5:] for x in names[:20]]
        found = similarity.candidates(spark.createDataFrame([("b", x) for x in names], "block string, name string"), 0.86).collect()
        assert {(min(x, x[:4] + "x" + x[5:]), max(x, x[:4] + "x" + x[5:])) for x in names[:20]} <= {(r["left"], r["right"]) for r in found}
        met.append(len(found))
    assert met[1] < 0.002 * 1220 * 1219 / 2, met


@pytest.mark.parametrize("least", [0.5, 0.75, 0.86, 0.95])
def test_segments_lose_no_pair(spark, least, monkeypatch):
    monkeypatch.setattr(similarity, "MANY_MET", -1)
    draw = random.Random(5)
    names = {"".join(draw.choices("abcé", k=draw.randint(1, 14))) for _ in range(160)}
    names = sorted(names | {x[:i] + draw.choice(["", "b", "bc"]) + x[i + draw.randint(0, 2):] for x in names for i in [draw.randint(0, len(x))]} - {""})
    shorter, longer = similarity.segment_keys(spark.createDataFrame([("b", x) for x in names], "block string, name string"), least)
    both = shorter.withColumnRenamed("name", "l").join(longer.withColumnRenamed("name", "r"), ["block", "key"]).select("l", "r").distinct().collect()
    met = {tuple(sorted(p)) for p in both}
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    assert {(a, b) for a, b in combinations(names, 2) if ratio(a, b) >= least} <= met
    found = {(r["left"], r["right"]) for r in similarity.candidates(spark.createDataFrame([("b", x) for x in names], "block string, name string"), least).collect()}
    assert {(a, b) for a, b in combinations(names, 2) if ratio(a, b) >= least} <= found


def test_stored_tables_of_many_rows_are_not_broadcast(spark):
    """Repeated texts compress a hundredfold: by the size of its files a table of 40 MB would go through the driver."""
    from cairnlake.sources.scratch import Rounds, stored

    rows = spark.range(400_000).selectExpr("id", "'the same long text of every row, which files hold once for all of them' AS said")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for made in (stored(rows, "t"), Rounds(spark, "r").store(rows)):
        assert "Broadcast" not in plan(rows.join(made.select("id", "said"), "id")) and made.count() == 400_000
    assert "Broadcast" in plan(rows.join(stored(rows.limit(20), "few"), "id"))

"""Refreshed resolution against a whole run, and stages that go on where a run ended."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import refresh, stages

ENTITIES = "entity_id string, entity_type string, display_name string, source_name string"
EDGES = "src string, dst string, kind string, confidence double, source_name string"


def tables(spark, seed, n=160):
    draw = random.Random(seed)
    firms = [f"{a} {b}" for a in ("ACME", "BLUE", "CORAL") for b in ("HOLDINGS LLC", "TRADING INC", "HOLDING LLC", "REALTY")]
    people = [f"{a} {b}" for a in ("Ann", "Anne", "Bo") for b in ("Lee", "Leigh", "Wu")]
    entities = [(f"b{i:03}", *(("business", draw.choice(firms)) if i % 2 else ("person", draw.choice(people))), "s") for i in range(n)]
    entities += [(f"ph{i}", "phone", f"305555010{i}", "s") for i in range(8)]
    edges = [(f"b{i:03}", f"ph{draw.randint(0, 7)}", "USES_PHONE", 1.0, "s") for i in range(n) if i % 3]
    return entities, edges


def run_of(run):
    labels = {r["entity_id"]: r["cluster"] for r in run.labels.collect()}
    matches = sorted((r["left_id"], r["right_id"], r["method"], r["decision"], r["shared"]) for r in run.matches.collect())
    return labels, matches


def test_a_refresh_is_a_whole_run(spark):
    entities, edges = tables(spark, 5)
    frame = lambda e, d: (spark.createDataFrame(e, ENTITIES), spark.createDataFrame(d, EDGES))
    run = refresh.first_run(*frame(entities, edges))
    draw = random.Random(6)
    for step in range(3):
        if step == 0:  # new rows and edges
            entities = [*entities, ("n1", "business", "ACME HOLDINGS LLC", "t"), ("n2", "person", "Zed Zorn", "t")]
            edges = [*edges, ("n1", "ph3", "USES_PHONE", 1.0, "t"), ("n2", "ph8", "USES_PHONE", 1.0, "t")]
        elif step == 1:  # names and edges change, a row goes
            entities = [(i, t, "BLUE REALTY" if i == "b031" else name, s) for i, t, name, s in entities if i != "b005"]
            edges = [e for e in edges if draw.random() > 0.02 and e[0] != "b005"]
        else:  # a block passes its limit: its other pairs go
            entities = [*entities, *[(f"z{i:03}", "business", f"ACME X{i}", "t") for i in range(190)]]
        run, report = refresh.refresh(run, *frame(entities, edges))
        assert run_of(run) == run_of(refresh.first_run(*frame(entities, edges)))
        (r,) = report.collect()
        assert r["decided"] + r["kept"] == run.matches.count() and 0 < r["changed"] <= r["affected"] <= r["entities"] + 1
        if step == 0:
            assert r["kept"] > 0 and r["affected"] < r["entities"]
    same, report = refresh.refresh(run, *frame(entities, edges))
    (r,) = report.collect()
    assert (r["changed"], r["affected"], r["decided"], r["relabelled"]) == (0, 0, 0, 0) and run_of(same) == run_of(run)


def test_stages(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/stages", str(tmp_path / "rows")
    spark.range(5).write.parquet(rows)
    made = []

    def doubled(frame, by):
        made.append(by)
        if by == 13:
            raise ValueError("unlucky")
        return frame.select((F.col("id") * by).alias("id"))

    def run(name, by=2, second=3):
        s = stages.Stages(spark, folder, name)
        one = s.stage("one", doubled, [rows], params={"by": by})
        return s.stage("two", doubled, after=[one], params={"by": second})

    first = run("a")
    assert sorted(r[0] for r in first.result.collect()) == [0, 6, 12, 18, 24] and made == [2, 3]
    assert run("b").key == first.key and made == [2, 3]  # nothing is made again
    with pytest.raises(ValueError, match="unlucky"):
        run("c", second=13)
    run("d", second=4)
    assert made == [2, 3, 13, 4]
    spark.range(7).write.mode("overwrite").parquet(rows)  # other files
    assert run("e", second=4).result.count() == 7 and made == [2, 3, 13, 4, 2, 4]
    profile = stages.Stages.profiles(spark, folder)
    got = [(r["run"], r["stage"], r["status"], r["rows"]) for r in profile.orderBy("run", "nth").collect()]
    assert got == [("a", "one", "PASS", 5), ("a", "two", "PASS", 5), ("b", "one", "REUSED", 5), ("b", "two", "REUSED", 5), ("c", "one", "REUSED", 5), ("c", "two", "FAIL", 0), ("d", "one", "REUSED", 5), ("d", "two", "PASS", 5), ("e", "one", "PASS", 7), ("e", "two", "PASS", 7)]
    state = {r["run"]: (r["completed"], r["failed"]) for r in stages.resume_state(profile).collect()}
    assert state["c"] == ("one", "two") and state["d"] == ("one|two", "") and "unlucky" in profile.where("status = 'FAIL'").first()["notes"]
    with pytest.raises(FileNotFoundError):
        stages.Stages(spark, folder, "f").stage("x", doubled, [str(tmp_path / "none")])

"""Paged services, their snapshots, and bulk files."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnlake.sources import bulk, paged

def service(request):
    """37 records on pages, the last of each page again on the next; busy at first, and it loses a task once."""
    log = Path(request["log"])
    asked = len(list(log.iterdir()))
    start = int(request.get("token") or 0) if "token" in request else request["offset"]
    key = f"{start}-{time.time_ns()}"
    (log / key).write_text(str(time.time()))
    if request.get("busy") and sum(p.name.startswith(f"{start}-") for p in log.iterdir()) == 1:
        return 429, {}, 0.05
    if request.get("lose") and start == 20 and not (log.parent / "lost").exists():
        (log.parent / "lost").touch()
        raise OSError("gone")
    if request.get("bad"):
        return 404, {}, 0.0
    rows = [{"id": max(i - (i % 10 == 0 and i > 0), 0), "asked": 0 * asked} for i in range(start, min(start + request["limit"], 37))]
    return 200, {"records": rows, "next": str(start + request["limit"]) if start + request["limit"] < 37 else None}, 0.0


@pytest.fixture
def asked(tmp_path):
    (tmp_path / "log").mkdir()
    return {"log": str(tmp_path / "log")}


def read(spark, asked, most=None, **options):
    return paged.read_pages(spark, "id", most, **{"fetch": "tests.test_services:service", "chains": [asked], "page_size": 10, "max_pages": 10, **options})


def ids(pages):
    return sorted(json.loads(r["record"])["id"] for r in pages.records.collect())


@pytest.mark.parametrize("options", [{"run": 2}, {"run": 100}, {"mode": "token"}])
def test_pages_without_repeats(spark, asked, options):
    got = read(spark, asked | {"busy": True}, **options)
    assert ids(got) == [i for i in range(37) if i not in (10, 20, 30)]
    (r,) = got.report.collect()
    assert (r["pages"], r["read"], r["repeats"], r["records"], r["truncated"]) == (4, 37, 3, 34, False)


@pytest.mark.parametrize("mode", ["offset", "token"])
def test_bounds_are_told(spark, asked, mode):
    few = read(spark, asked, max_pages=2, mode=mode, run=1)
    assert len(ids(few)) == 19 and few.report.first()["truncated"]
    cut = read(spark, asked, 12, mode=mode)
    assert ids(cut) == [i for i in range(13) if i != 10] and cut.report.first()["truncated"] and cut.report.first()["records"] == 12
    whole = read(spark, asked, 34, mode=mode)
    assert not whole.report.first()["truncated"]


def test_several_chains(spark, asked):
    got = read(spark, asked, chains=[asked, asked | {"other": 1}], mode="token")
    assert len(ids(got)) == 34 and got.report.first()["repeats"] == 40


def test_a_refusal_is_an_error(spark, asked):
    with pytest.raises(Exception, match="404"):
        read(spark, asked | {"bad": True}).records.collect()


def test_tasks_share_a_rate(asked):
    reader = paged._PagedReader({"fetch": "tests.test_services:service", "chains": json.dumps([asked]), "page_size": "10", "max_pages": "6", "run": "3", "rate_per_hour": str(3600 * 20)})
    began = time.time()
    for part in reversed(reader.partitions()):  # in any order, requests keep to their slots
        list(reader.read(part))
    times = sorted(float(p.read_text()) for p in Path(asked["log"]).iterdir())
    assert len(times) == 4 and times[-1] - began >= 2 / 20 and [p.bounded for p in reader.partitions()] == [False, True]


def test_a_lost_task_asks_again(tmp_path, asked):
    reader = paged._PagedReader({"fetch": "tests.test_services:service", "chains": json.dumps([asked | {"lose": True}]), "page_size": "10", "max_pages": "4", "run": "4"})
    (part,) = reader.partitions()
    with pytest.raises(OSError):
        list(reader.read(part))
    rows = list(reader.read(part))  # what Spark does with a task that failed
    assert [r[1] for r in rows if r[2] == paged.END] == [3] and sum(r[2] != paged.END for r in rows) == 37


def test_snapshots(spark, tmp_path, asked):
    folder = f"file://{tmp_path}/kept"
    got = read(spark, asked, run=1)
    paged.write_snapshot(got.records, folder, "one")
    paged.write_snapshot(got.records.limit(5), folder, "two")
    told = {m["run"]: m["rows"] for m in paged.manifests(folder)}
    assert told == {"one": 34, "two": 5}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(paged.read_snapshot(spark, folder, "one")) == rows(got.records) and paged.read_snapshot(spark, folder).count() == 39
    # What no manifest names, a task that was lost for one, isn't read; what was changed is refused.
    (tmp_path / "kept" / "one-left.jsonl").write_text("[1,2,3,null]\n")
    assert paged.read_snapshot(spark, folder, "one").count() == 34
    writer = paged._SnapshotWriter(folder, "three")
    message = writer.write(iter([(0, 0, 0, "x")]))
    writer.abort([message, None])
    assert not (tmp_path / "kept" / message.name).exists() and len(paged.manifests(folder)) == 2
    (changed,) = [f for f in (tmp_path / "kept").glob("two-*.jsonl") if f.stat().st_size]
    changed.write_bytes(changed.read_bytes().replace(b'"id', b'"iD'))
    with pytest.raises(Exception, match="not what its manifest says"):
        paged.read_snapshot(spark, folder, "two").collect()
    assert paged.read_snapshot(spark, f"file://{tmp_path}/none").count() == 0


HEADINGS = [bulk.NUMBER, bulk.KIND, bulk.FIRM, bulk.FIRST, bulk.LAST, bulk.CLOSED, bulk.TAXONOMY, bulk.TAXONOMY_TEXT, bulk.LICENSE_STATE, *bulk.OFFICIAL, *(f"{p} {x}" for p in (bulk.MAILING, bulk.PRACTICE) for x in bulk.PARTS)]
HOME, SHOP = ["1 Oak St", "", "Tampa", "FL", "33601"], ["2 Elm Ave", "Ste 5", "Tampa", "FL", "33602-1111"]
ROWS = [
    ["11", "2", "Bay Clinic, LLC", "", "", "", "261Q", "Clinic", "FL", "Ann", "Lee", *HOME, *SHOP],
    ["22", "1", "", "Bo", "Wu", "", "207Q", "Family Medicine", "", "", "", *HOME, *["", "", "", "", ""]],
    ["33", "1", "", "Cy", "Ray", "2020-01-01", "", "", "", "", "", *["PO Box 7", "", "Miami", "FL", "33101"], *SHOP],
    ["11", "2", "Bay Clinic Holdings", "", "", "", "261Q", "Clinic", "FL", "Ann", "Lee", *HOME, *SHOP],
    ["44", "2", "Peach", "", "", "", "261Q", "Clinic", "GA", "", "", *["9 A St", "", "Atlanta", "GA", "30301"], *["9 A St", "", "Atlanta", "GA", "30301"]],
    ["", "2", "No number", "", "", "", "261Q", "Clinic", "FL", "", "", *HOME, *SHOP],
]


@pytest.fixture
def file(tmp_path):
    quoted = [",".join(f'"{v}"' for v in r) for r in [HEADINGS, *ROWS]]
    (tmp_path / "providers.csv").write_text("\n".join(quoted) + "\n")
    return str(tmp_path / "providers.csv")


def test_bulk_filters_and_repeats(spark, file):
    got = bulk.read_bulk(spark, file, {"state": "fl", "postal_prefix": "336"}, 10)
    rows = {r["npi"]: r for r in got.providers.collect()}
    assert set(rows) == {"11", "22", "33"} and rows["11"]["name"] == "Bay Clinic Holdings"  # the last row counts
    (r,) = got.report.collect()
    assert (r["matched"], r["providers"], r["repeats"], r["persons"], r["organizations"], r["deactivated"], r["incomplete"], r["truncated"]) == (4, 3, 1, 2, 1, 1, 1, False)
    first = bulk.read_bulk(spark, file, {"state": "FL"}, 1)
    assert [r["name"] for r in first.providers.collect()] == ["Bay Clinic, LLC"] and first.report.first()["truncated"]
    n = lambda **f: bulk.read_bulk(spark, file, f).providers.count()
    assert (n(), n(city="atlanta"), n(taxonomy_code="261q"), n(taxonomy_description="medicine"), n(enumeration_type="NPI-1"), n(active_only=True), n(postal_code="33101")) == (4, 1, 2, 1, 2, 3, 1)
    with pytest.raises(ValueError, match="county"):
        n(county="x")
    (Path(file).parent / "short.csv").write_text("NPI,x\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        bulk.read_bulk(spark, str(Path(file).parent / "short.csv"))


def test_bulk_filters_reach_the_scan(spark, file):
    rows = spark.read.option("header", True).csv(file)
    for condition in bulk.wanted({"postal_prefix": "336", "enumeration_type": "NPI-2"}):
        rows = rows.where(condition)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    pushed = rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]
    assert "StringStartsWith" in pushed and "EqualTo(Entity Type Code,2)" in pushed and "IsNotNull(NPI)" in pushed


def test_bulk_entities_and_edges(spark, file):
    providers = bulk.read_bulk(spark, file, {"state": "FL"}).providers
    entities = {r["entity_id"]: r for r in bulk.bulk_entities(providers).collect()}
    assert entities["provider:nppes:11"]["entity_type"] == "organization_provider" and entities["provider:nppes:11"]["normalized_value"] == "BAY CLINIC HOLDINGS"
    assert entities["address:nppes:22:mailing:1"]["scope"] == "MAILING_ONLY" and "address:nppes:22:practice:1" not in entities and entities["address:nppes:11:practice:1"]["scope"] == "EXACT_UNIT"
    assert entities["address:nppes:33:mailing:1"]["scope"] == "PO_BOX" and entities["authorized_official:nppes:11"]["display_name"] == "Ann Lee" and entities["taxonomy:nppes:207Q"]["display_name"] == "Family Medicine"
    edges = {(r["src"], r["dst"], r["kind"]) for r in bulk.bulk_edges(providers).collect()}
    assert ("provider:nppes:22", "address:nppes:22:mailing:1", "PROVIDER_MAILS_TO") in edges and ("provider:nppes:11", "state:FL", "PROVIDER_LICENSE_REPORTED_IN_STATE") in edges
    assert {d for _, d, _ in edges} - set(entities) == {"state:FL"} and len(edges) == 5 + 2 + 2
    assert bulk.bulk_entities(providers.limit(0)).count() == 0 == bulk.bulk_edges(providers.limit(0)).count()
    assert providers.where(F.col("incomplete")).select("npi").collect()[0]["npi"] == "33"


def test_tasks_share_a_bulk_file_and_its_last_rows_count(spark, tmp_path, monkeypatch):
    from cairnlake.plans import service_queries
    from cairnlake.sources import bulk, scratch

    monkeypatch.setattr(service_queries, "FILE_ROWS", 100, raising=False)
    spark.range(1, 1001).selectExpr("id AS c_custkey", "'n' || id AS c_name", "cast(id % 25 AS int) AS c_nationkey", "'SEGMENT' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    path = service_queries._bulk_file(spark, str(tmp_path))
    assert spark.read.option("header", True).csv(path).select(bulk.F.input_file_name()).distinct().count() > 5
    kept = {r["npi"]: r["name"] for r in bulk.read_bulk(spark, path).providers.collect()}
    # Every seventh row is of the provider before.
    assert len(kept) == 1000 - 142 and kept["1000000006"].endswith("n7") and "1000000007" not in kept
    rows = spark.range(1000).withColumn("key", bulk.F.col("id"))
    assert scratch.dealt(rows, "key", 100).rdd.getNumPartitions() == 11

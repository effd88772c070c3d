import duckdb
import pandas as pd
import pytest

from cairnlake.llm import mixing


def water_filling(sizes, weights, factor, cap):
    """Targets by the rule itself: share by weight, stop at the cap, share the excess again."""
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), factor * sum(sizes.values())
    while free and left > 1e-9:
        total, over = sum(weights[s] for s in free), set()
        for s in free:
            if target[s] + left * weights[s] / total >= cap * sizes[s] - 1e-9:
                over.add(s)
        if not over:
            for s in free:
                target[s] += left * weights[s] / total
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        free -= over
    return target


ROWS = [(i, "w " * (i % 23 + 1), f"s{i % 5}" if i % 11 else None) for i in range(600)] + [(700 + i, "big " * 40, "hot") for i in range(400)] + [(9000, None, "s1"), (9001, "", "s2"), (9002, "x " * 50_000, "long"), (5, "again twice", "s0"), (5, "again twice", "s0"), (None, "no id", "s3"), (9003, "a b c\x0bd", "s3")]


def test_targets_and_words(spark, docs, tmp_path):
    docs(ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op7_mixing(spark, str(tmp_path)).toPandas()
    assert len(got) == len(ROWS)
    got["s"] = got["source"].fillna("~")
    sizes = got.groupby("s")["size"].sum().to_dict()
    names = sorted(s for s in sizes if s != "~") + ["~"]
    target = water_filling(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2)
    longest = got.groupby("s")["size"].max()
    for s, part in got.groupby("s"):
        assert set(part["source_size"]) == {sizes[s]}
        assert part["target"].iloc[0] == pytest.approx(target[s])
        assert abs(part["taken"].sum() - target[s]) <= longest[s] / 2 + 1e-6
    assert (got["taken"] <= 2 * got["size"]).all()
    assert got[got.doc_id == 9003]["size"].tolist() == [3] and got[got.doc_id == 9000]["size"].tolist() == [0]
    again = mixing.op7_mixing(spark, str(tmp_path)).toPandas()
    key = lambda f: sorted(map(str, f[["doc_id", "size", "taken"]].itertuples(index=False)))
    assert key(got) == key(again)
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert key(got) == key(oracle.execute(mixing.OP7_SQL).df().astype({"doc_id": "float64"}))


def test_the_mix_repeats_whole_rows(spark, docs):
    frame = docs(ROWS)
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    taken = mixing.mix(mixing.rows_to_mix(frame)).toPandas()
    got = mixed.groupBy("doc_id").count().toPandas()
    want = taken.groupby("id", dropna=False)["copies"].sum()
    assert got["count"].sum() == want.sum() and (got["count"] <= 6).all()


def test_rows_that_repeat_one_id_are_split(spark, docs):
    # The rows of one id and text are alike, most of a source, and the budget ends among them.
    rows = [(1, "a b c", "hot")] * 500 + [(None, "no id", "hot")] * 40 + [(10 + i, "d e", "hot") for i in range(30)] + [(100 + i, "w " * 60, "other") for i in range(30)]
    for ranges in (1, 7, None):
        got = mixing.mix(mixing.rows_to_mix(docs(rows)), ranges=ranges).toPandas()
        assert len(got) == len(rows)
        for s, part in got.groupby("source"):
            assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2
            assert part["copies"].max() - part["copies"].min() <= 1 and (part["taken"] <= 2 * part["size"]).all()
        split = got[got["id"] == 1]["copies"].nunique(), got[got["id"].isna()]["copies"].nunique()
        assert split == (2, 1) or split == (1, 2) or split == (1, 1)
        if ranges == 1:
            first = sorted(got["taken"])
        assert sorted(got["taken"]) == first


def test_empty_and_light_keys(spark, docs):
    assert mixing.mix(mixing.rows_to_mix(docs([]))).count() == 0
    # Heavier documents come earlier far more often.
    rows = docs([(i, "one two three four", "s") for i in range(2000)])
    from pyspark.sql import functions as F

    weight = F.when(F.substring("text", 1, 1) == "o", F.lit(1.0))
    keyed = mixing.rows_to_mix(rows, weight=weight * F.when(F.col("id") % 2 == 0, 10.0).otherwise(1.0))
    first = keyed.orderBy("key").limit(200).toPandas()
    assert isinstance(first, pd.DataFrame) and (first["id"] % 2 == 0).mean() > 0.8

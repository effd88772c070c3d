import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(linededup.UPPER, linededup.LOWER)


def key_of(line):
    return line.strip(BLANKS).translate(LOWER)


def expected(texts, min_docs=10, min_chars=1):
    """Brute force: the kept text and the number of dropped lines of each text."""
    found = Counter(k for t in texts for k in {key_of(x) for x in (t or "").split("\n")})
    common = {k for k, n in found.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in common]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def some_texts():
    texts = [f"own {i}\n  Shared HEADER\t\nbody {i % 7}\n\n{'TAIL' if i % 2 else 'tail'}" for i in range(40)]
    texts += ["only\nnine"] * 9 + ["exactly ten"] * 10 + ["a\n a\nA \r\nÉ\né"] * 12 + ["É"] * 3
    texts += [None, "", "\n", "shared header", "twice\ntwice\n" * 9, "twice"] + ["x\n" * 20_000 + "shared header\nlast"] + ["hot\nhot\n𝔘nicode 𝔘"] * 60
    return texts


def rows_of(out):
    got = out.select(F.col("doc.doc_id").alias("i"), "n_lines", "n_dropped", "kept").collect()
    return {r["i"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in got}


@pytest.mark.parametrize("parts, fanout", [(1, 4), (7, 2), (9, 3)])
def test_batches_give_what_all_lines_at_once_give(spark, docs, monkeypatch, parts, fanout):
    texts = some_texts()
    frame = docs(list(enumerate(texts)))
    runs, compacted = linededup.LineRuns, []
    monkeypatch.setattr(linededup, "LineRuns", lambda *a: runs(*a, buckets=3, fanout=fanout))
    monkeypatch.setattr(runs, "_compact", lambda self, found, do=runs._compact: (compacted.append(len(found)), do(self, found)))
    split = [frame.where(F.col("doc_id") % parts == i) for i in range(parts)]
    assert rows_of(linededup.dedup_lines(frame, split)) == dict(enumerate(expected(texts)))
    assert len(compacted) >= (parts > 1) and set(compacted) <= {fanout}


def test_settled_keys_are_not_added_again_and_stores_reopen(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/runs"
    store = linededup.LineRuns(spark, folder, buckets=2)
    store.add(docs([(i, "hot\nrare") for i in range(6)] + [(i, "hot") for i in range(6)]))
    store.add(docs([(i, "hot\nrare\nnew") for i in range(3)]))
    second = {r["docs"] for r in spark.table(store.runs[1][2]).collect()}
    assert second == {3} and spark.table(store.runs[1][2]).count() == 2
    names = [n for *_, n in store.runs]
    store.close()
    again = linededup.LineRuns(spark, folder, buckets=5)
    assert again.buckets == 2 and [r[:2] for r in again.runs] == [(0, 0), (1, 1)] and not {n for *_, n in again.runs} & set(names)
    again.add(docs([(0, "rare")]))
    assert again.frequent().count() == 2  # hot, and rare in 6 + 3 + 1 documents
    again.add(docs([(0, "late")]))
    assert [r[:2] for r in again.runs] == [(0, 3)] and again.frequent().count() == 2
    again.close()


def test_runs_are_joined_where_they_lie(spark, docs, tmp_path):
    store = linededup.LineRuns(spark, f"file://{tmp_path}/runs")
    store.add(docs([(i, f"hot\nrare {i}") for i in range(30)]))
    store.close()
    store = linededup.LineRuns(spark, f"file://{tmp_path}/runs")
    counts = spark.range(5).groupBy(F.col("id").alias("hi"), F.col("id").alias("lo")).count()
    joined = counts.join(store._of(store.runs[0][2], settled=True).select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # that of the new counts alone
    store.close()


def test_query(spark, docs, tmp_path):
    texts = some_texts()
    frame = docs([*enumerate(texts), (None, "exactly ten"), (None, "no id"), (3, "repeated id"), (3, "repeated id")])
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = linededup.op12_lines(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    as_rows = lambda rows: sorted(("" if r[0] is None or r[0] != r[0] else str(int(r[0])), *map(str, r[1:])) for r in rows)
    got = as_rows(got.collect())
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == as_rows(oracle.execute(linededup.OP12_SQL).fetchall())
    every = [*texts, "exactly ten", "no id", "repeated id", "repeated id"]
    assert sorted(r[3] for r in got) == sorted(hashlib.sha256(k.encode()).hexdigest() for *_, k in expected(every))
    assert len(linededup.batches_of(spark.read.parquet(str(tmp_path / "documents.parquet")), 3)) == 3


def test_empty_table_and_whole_rows(spark, docs):
    assert linededup.dedup_lines(docs([])).count() == 0
    frame = docs([(1, "a\nb")])
    out = linededup.dedup_lines(frame, min_docs=1, min_chars=1)
    assert out.select("doc.*").columns == frame.columns and out.first()["kept"] == "" and out.first()["n_dropped"] == 2
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()

"""The pipeline's rows against the same steps done one document at a time on the driver."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from cairnlake.llm import mixing, packing, quality, toxicity  # noqa: E402

from .test_neardup import exact  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")


def by_hand(spark):
    docs = {i: (t, s) for i, t, s in duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()}
    labels = {i: (q, t) for i, q, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()}
    stats = {i: np.array(quality.statistics_of(t)) for i, (t, _) in docs.items()}
    sums = {}
    for y in (0, 1):
        own = np.array([stats[i] for i, (q, _) in labels.items() if q == y and i in docs and zlib.crc32(str(i).encode()) % 5])
        sums[y] = (len(own), own.sum(axis=0), own.T @ own)
    model = quality.fit_from_sums(sums)
    docs = {i: d for i, d in docs.items() if model.score(stats[i][None])[0] >= 0.3}
    frame = spark.createDataFrame([(i, t) for i, (t, _) in docs.items()], "doc_id long, text string")
    toxic = toxicity.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {i: d for i, d in docs.items() if toxic is None or toxic.locate(d[0])[0] < 0.5}
    docs = {i: docs[i] for i, (_, component) in exact([(i, t) for i, (t, _) in docs.items()]).items() if i == component}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, (t, s) in docs.items()])
    pieces, encoder = Counter(), packing.WordEncoder(packing.TOKENIZER)
    for doc_id, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP7_SQL})").fetchall():
        ids = encoder.encode(docs[doc_id][0] or "") + (1).to_bytes(4, "little")
        for start in range(0, len(ids) // 4, 2048):
            cut = ids[4 * start : 4 * (start + 2048)]
            pieces[(doc_id, start, len(cut) // 4, zlib.crc32(cut))] += taken // size if size else 1
    return Counter({k: n for k, n in pieces.items() if n})


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, str(SF)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == by_hand(spark)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(placed))])
        assert [a for a, _ in sorted(placed)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(SF)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(SF)).count() == 0

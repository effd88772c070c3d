import zlib

import numpy as np

from cairnlake.llm import quality


def test_score_is_the_posterior_of_two_gaussians():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = {0: rng.normal(0, 1, (4000, d)), 1: rng.normal(0.7, 2, (4000, d))}
    model = quality.fit_from_sums({y: (len(v), v.sum(0), v.T @ v) for y, v in x.items()})
    z = np.concatenate([x[0][:50], x[1][:50]])
    direct = []
    for v in (z - model.centre) / model.scale:
        logs = [p - 0.5 * (v - m) @ np.linalg.inv(c) @ (v - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c, p in zip(model.means, model.covariances, model.log_priors, strict=True)]
        direct.append(1 / (1 + np.exp(logs[0] - logs[1])))
    assert np.allclose(model.score(z), direct, atol=1e-9)
    assert ((model.score(x[1]) > 0.5).mean() > 0.9) and ((model.score(x[0]) < 0.5).mean() > 0.9)
    assert quality.fit_from_sums({1: (5, np.zeros(d), np.eye(d))}) is None


def prose(i):
    rng = np.random.default_rng(i)
    words = ["river", "stone", "and", "the", "of", "walk", "bright", "morning", "house", "garden", "was", "with", "over", "quiet", "people"]
    return " ".join(" ".join(rng.choice(words, 12)).capitalize() + "." for _ in range(6))


def junk(i):
    rng = np.random.default_rng(i)
    return " ".join(f"{w}$$$" for w in rng.choice(["BUY", "NOW", "WIN"], 80))


def test_held_out_accuracy_and_edge_rows(spark, docs):
    rows = [(i, prose(i) if i % 3 else junk(i)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "word " * 40_000), (None, prose(5)), (7, prose(7)), (7, prose(7))]
    got = quality.classify_quality(docs(rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    assert quality.classify_quality(docs([]), labels).count() == 0
    assert {r["score"] for r in quality.classify_quality(docs(rows[:3]), labels.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_do_not_matter(spark, docs):
    rows = [(i, prose(i) if i % 3 else junk(i)) for i in range(60)]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    make = lambda flip: spark.createDataFrame([(i, int(i % 3 > 0) ^ int(flip and i in held), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    score = lambda labels: {r["doc_id"]: round(r["score"], 9) for r in quality.classify_quality(docs(rows), labels).collect()}
    assert score(make(False)) == score(make(True))


def test_filter_keeps_whole_rows(spark, docs):
    rows = [(i, prose(i) if i % 3 else junk(i)) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    frame = docs(rows)
    kept = quality.quality_documents(frame, labels)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(150) if i % 3}

from pathlib import Path

import numpy as np

from cairnlake.llm import neighbours as nn

TABLE = Path("/root/testdata/sf0.1/embeddings.parquet")
SCHEMA = "vec_id long, embedding array<float>, label int, shard int, score string"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, np.float32).astype(np.float64)) ** 2).sum(axis=1))
        at = np.flatnonzero(ids != q)
        out[q] = [(int(ids[i]), float(d[i])) for i in at[np.lexsort((ids[at], d[at]))][:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "c") for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    for n, width in ((3000, 64), (40, 64), (1, 30), (9, 128)):
        bits = rng.integers(0, 2, (n, width), dtype=np.uint8)
        bits[: n // 6] = bits[0] ^ (rng.random((n // 6, width)) < 0.1)
        index = nn.MultiIndex(bits)
        assert sorted(np.concatenate(index.cuts)) == list(range(width)) and max(map(len, index.cuts)) <= max(4, np.ceil(np.log2(n + 1)) + 1)
        for radius in (0, 3, 9, 20, 30, width):
            for q in {0, n // 2, n - 1}:
                distance = (bits ^ bits[q]).sum(axis=1)
                want = np.flatnonzero(distance <= radius)
                assert index.search(bits[q], radius).tolist() == want.tolist() and set(want) <= set(index.marked(bits[q], radius))
                allowed = np.arange(n) != q
                got, reached = index.search_until(bits[q], radius, 5, allowed)
                assert len(got) >= min(5, n - 1) and q not in got and set(want) - {q} <= set(got)
                assert set(got) == set(np.flatnonzero(distance <= reached)) - {q}


def test_rows_come_out_of_the_indexes(spark, monkeypatch):
    """On the given vectors too, which have no structure: recall, and the share of rows that probes meet and that are reranked."""
    if not TABLE.exists():
        return
    rows = spark.read.parquet(str(TABLE)).select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    codes = nn.learn(x)
    index = nn.MultiIndex(codes.encode(x))
    hits = near = 0
    queries = np.flatnonzero(ids % 100 == 0)
    for q in queries:
        rows, score = nn.nearest_rows(index, codes, x, x[q], codes.encode(x[q]), 10, ids != ids[q])
        near += len(rows)
        d = np.where(ids != ids[q], ((x - x[q]) ** 2).sum(axis=1), np.inf)
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(rows))
        assert np.allclose(score**2, d[rows])
    assert hits >= 0.93 * 10 * len(queries) and near < 0.3 * len(x) * len(queries)


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(x)]
    vectors = frame(spark, rows)
    got = found(nn.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), shard_rows=700, query_block=10, sample_rows=1000))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
    for q, w in want.items():
        exact = dict(w)
        assert all(abs(s - exact[i]) < 1e-9 for i, s in got[q] if i in exact)


def test_ties_repeats_and_unusable_vectors(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same) for i in range(300)] + [(300, None), (400, [0.0] * 4), (500, [1.0, None, 1.0, 1.0]), (600, [float("nan")] * 4), (700, [1.0, 2.0]), (800, [float("inf"), 1, 1, 1]), (900, []), (0, same)]
    vectors = frame(spark, rows)
    got = found(nn.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), shard_rows=64))
    assert set(got) == {0, 100, 200}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[100] == [(i, 0.0) for i in [0, 0, *range(1, 9)]]
    few = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [i for i, _ in found(nn.nearest_neighbours(few, few.where("vec_id = 0")))[0]] == [2, 1]
    assert nn.nearest_neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def test_small_tables_and_sparse_queries_get_all_their_rows(spark):
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 8, 11):
        rows = list(enumerate(rng.normal(size=(n, 64))))
        vectors = frame(spark, rows)
        got, want = found(nn.nearest_neighbours(vectors, vectors)), brute(rows, rows, 10)
        assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    centres, sparse = rng.normal(size=(150, 64)), rng.normal(size=(60, 64))
    x = np.concatenate([centres[np.arange(2940) % 150] + 1e-4 * rng.normal(size=(2940, 64)), sparse])
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(x)]
    vectors = frame(spark, rows)
    got, want = found(nn.nearest_neighbours(vectors, vectors.where("vec_id >= 2940"), shard_rows=1600)), brute(rows, rows[2940:], 10)
    assert {len(r) for r in got.values()} == {10} and set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.95 * 600


def test_clustered_vectors_meet_few_others(spark):
    """Cells and probes leave out most rows; outliers and a cluster that holds a third of all rows get all their rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    of = np.where(np.arange(4000) % 3 == 0, 0, np.arange(4000) % 40)
    x = centres[of] + 0.15 * rng.normal(size=(4000, 32))
    x[100], x[1300] = 9 * rng.normal(size=32), -7 * rng.normal(size=32)
    rows = list(enumerate(x))
    vectors = frame(spark, rows)
    got = found(nn.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), shard_rows=200, query_block=8))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(got) == set(want) and {len(r) for r in got.values()} == {10}
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.95 * 400
    codes = nn.learn(x)
    bits = codes.encode(x)
    index = nn.MultiIndex(bits)
    others = [q for q in range(1, 4000, 100) if of[q]]
    assert np.mean([len(index.marked(bits[q], codes.radius)) for q in others]) < 0.2 * 4000
    cells = nn.learn_centres(x, 16)
    assert nn.learn_probes(x, cells, 10) <= 4

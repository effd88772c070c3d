import math
import random

import numpy as np
import pytest

from cairnlake.llm import neardup


def exact(rows, threshold=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], rng.choices(words, k=60)
    for i in range(40):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(4, 120)))))
    base = rng.choices(words, k=150)
    for i in range(100, 220):  # near copies of one text, many of them near the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    for i in range(300, 340):  # a passage that many share, in different texts
        rows.append((i, " ".join(rng.choices(words, k=40) + passage + rng.choices(words, k=40))))
    rows += [(400 + i, "Exactly  the SAME few words here") for i in range(30)] + [(450, "exactly the same few words HERE")]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE two"), (505, "two one"), (506, "x y z"), (507, " ".join(rng.choices(words, k=30_000)))]
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 8, "star_rounds": 0}, {"block": 16, "star_rounds": 1}])
def test_components_are_those_of_all_links(spark, docs, options):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(rows), **options).collect()}
    assert got == exact(rows)


def test_repeats_nulls_and_empty_tables(spark, docs):
    rows = [(3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "q w e r t"), (9, "other words stand here now"), (None, None)]
    got = [(str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([("3", 2, False), ("2", 2, True), ("2", 2, True), ("None", 2, False), ("None", None, True), ("9", 9, True), ("None", None, True)], key=str)
    frame = docs(rows)
    kept = neardup.without_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(((str(r["doc_id"]), r["text"]) for r in kept.collect()), key=str) == sorted([("2", "a b c d e"), ("9", "other words stand here now"), ("None", "q w e r t"), ("None", None)], key=str)
    assert neardup.near_duplicates(docs([])).count() == 0
    assert neardup.near_duplicates(docs([(1, None)])).count() == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    s, t = neardup.min_max([np.unique(np.r_[shared, a]), np.unique(np.r_[shared, b])])
    assert abs((s == t).mean() - 0.8) < 0.12
    assert s[0] == np.unique(np.r_[shared, a] * neardup.permutations(95)[0][0] + neardup.permutations(95)[1][0]).min()


def test_sketches_drop_fewer_links_than_bands_miss():
    n, bands = 2 * neardup.PERMUTATIONS, 2 * neardup.PERMUTATIONS // neardup.BAND_ROWS
    least = math.ceil(neardup._least_match(n, neardup.THRESHOLD) * n)
    for j in (0.8, 0.805, 0.81):
        q = j * 255 / 256 + 1 / 256
        dropped = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(least))
        assert dropped < 2.1e-8 < (1 - 0.8**neardup.BAND_ROWS) ** bands


def test_components_read_no_link_again(spark, monkeypatch):
    """Later rounds get the links between components that are left, not all links once more."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 300])) for i in range(0, 60)]
    asked, labelled = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda links: (asked.append(links.count()), labelled(links))[1])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert asked[0] >= 59 and sum(asked[1:]) < asked[0], asked


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 60 + i) for i in range(20)] + [(201, 200), (202, 201), (200, 202), (7, 8), (8, 7)]
    got = {r["id"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {i: 60 for i in [*range(60, 80), 100]} | {200: 200, 201: 200, 202: 200, 7: 7, 8: 7}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).collect() == []
    more = neardup.merged(neardup.components(spark.createDataFrame([(5, 6), (9, 8)], "a long, b long")), spark.createDataFrame([(6, 9), (6, 5), (3, 2)], "a long, b long"))
    assert {tuple(r) for r in more.collect()} == {(5, 5), (6, 5), (8, 5), (9, 5), (2, 2), (3, 2)}

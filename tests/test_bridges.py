"""Articulation points and communities of whole graphs, by joins alone, against what one process finds."""

import random
from functools import partial

import pytest

from cairnlake.operators import graph


def random_graphs(n, seed, largest=9):
    """Edges of many small random graphs, each with ids of its own."""
    draw, edges = random.Random(seed), []
    for g in range(n):
        size = draw.randint(2, largest)
        names = [f"{g:03d}-{draw.randint(0, 99):02d}-{i}" for i in range(size)]
        for _ in range(draw.randint(1, 2 * size)):
            edges.append(tuple(draw.choices(names, k=2)))
    return edges


def around(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return {v: sorted(out[v]) for v in sorted(out)}


def reached(adjacent, start, without=None):
    seen, todo = set(), [start]
    while todo:
        v = todo.pop()
        if v not in seen and v != without:
            seen.add(v)
            todo.extend(adjacent[v])
    return seen


def groups_by_removal(adjacent):
    out = {}
    for v, nbrs in adjacent.items():
        left, n = set(nbrs), 0
        while left:
            left -= reached(adjacent, min(left), v)
            n += 1
        if n > 1:
            out[v] = n
    return out


def tables(spark, edges):
    frame = spark.createDataFrame(edges, "src string, dst string")
    adjacent = around(edges)
    least = {}
    for v in adjacent:
        if v not in least:
            least |= dict.fromkeys(reached(adjacent, v), v)
    return frame, spark.createDataFrame(list(least.items()), "id string, component string"), adjacent, least


@pytest.mark.parametrize("local_edges", [0, 12, 200_000])
def test_random_graphs(spark, local_edges):
    edges = random_graphs(200, 3)
    frame, components, adjacent, least = tables(spark, edges)
    got = {r["id"]: (r["component"], r["groups"], r["score"]) for r in graph.articulation_points(frame, components, local_edges=local_edges).collect()}
    assert got == {v: (least[v], n, 10 * n + len(adjacent[v])) for v, n in groups_by_removal(adjacent).items()} and len(got) > 150
    labels = graph.spread_labels(adjacent)
    named = {v: min(w for w in adjacent if labels[w] == labels[v] and least[w] == least[v]) for v in adjacent}
    found = {r["id"]: (r["component"], r["community"]) for r in graph.communities(frame, components, local_edges=local_edges).collect()}
    assert found == {v: (least[v], named[v]) for v in adjacent}


def test_one_round_is_not_the_last(spark):
    edges = random_graphs(40, 8, largest=14)
    frame, components, adjacent, least = tables(spark, edges)
    for rounds in (1, 2):
        labels = graph.spread_labels(adjacent, rounds)
        found = {r["id"]: r["community"] for r in graph.communities(frame, components, rounds=rounds, local_edges=0).collect()}
        assert found == {v: min(w for w in adjacent if labels[w] == labels[v] and least[w] == least[v]) for v in adjacent}


def test_a_long_path_and_a_wide_star(spark):
    n = 10_000
    edges = [(f"p{i:05d}", f"p{i + 1:05d}") for i in range(n - 1)] + [("hub", f"s{i:04d}") for i in range(3000)] + [("s0001", "s0002")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    rows = [(f"p{i:05d}", "p00000") for i in range(n)] + [("hub", "hub")] + [(f"s{i:04d}", "hub") for i in range(3000)]
    points = graph.articulation_points(frame, spark.createDataFrame(rows, "id string, component string"), local_edges=0)
    got = {r["id"]: (r["groups"], r["score"]) for r in points.collect()}
    assert got == {f"p{i:05d}": (2, 22) for i in range(1, n - 1)} | {"hub": (2999, 29990 + 3000)}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    alone = spark.createDataFrame([("a", "a")], "id string, component string")
    for find in (graph.articulation_points, graph.communities):
        for f in (find, partial(find, local_edges=0)):
            assert f(none, alone).count() == 0
            assert f(spark.createDataFrame([("a", "a")], "src string, dst string"), alone).count() == 0


def test_a_dense_component_is_searched_only_where_it_hangs_together_loosely(spark, monkeypatch):
    # Sixty vertices that share neighbours, a ring and an ear of three edges on them, a tail, two triangles that meet in a vertex.
    draw = random.Random(11)
    edges = [(f"a{i:02d}", f"b{j:02d}") for i in range(20) for j in draw.sample(range(40), 20)]
    edges += [("a00", "e1"), ("e1", "e2"), ("e2", "b05"), ("b01", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r4"), ("r4", "b02")]
    edges += [("b03", "t1"), ("t1", "t2"), ("t2", "x"), ("x", "y"), ("y", "t2"), ("t2", "z1"), ("z1", "z2"), ("z2", "t2"), ("b03", "p1"), ("a19", "p2")]
    frame, components, adjacent, least = tables(spark, edges)
    searched, blocks = [], graph.biconnected.blocks
    monkeypatch.setattr(graph.biconnected, "blocks", lambda ends, of: (searched.append(ends.count()), blocks(ends, of))[1])
    got = {r["id"]: (r["groups"], r["score"]) for r in graph.articulation_points(frame, components, local_edges=0).collect()}
    assert got == {v: (n, 10 * n + len(adjacent[v])) for v, n in groups_by_removal(adjacent).items()} and got["b03"][0] == 3
    assert searched and searched[0] < 40 < len(set(edges))


def test_a_round_hears_only_what_the_last_one_changed(spark, monkeypatch):
    edges = random_graphs(30, 21, largest=8)
    frame, components, adjacent, least = tables(spark, edges)
    heard, hear = [], graph.propagation._heard
    monkeypatch.setattr(graph.propagation, "_heard", lambda both, labels: (heard.append(both.count()), hear(both, labels))[1])
    found = {r["id"]: r["community"] for r in graph.communities(frame, components, local_edges=0).collect()}
    labels = graph.spread_labels(adjacent)
    assert found == {v: min(w for w in adjacent if labels[w] == labels[v] and least[w] == least[v]) for v in adjacent}
    every = sum(len(n) for n in adjacent.values())
    assert heard[-1] < every / 4


def test_hubs_hear_only_who_changed(spark, monkeypatch):
    # The first and the last id are tied to all others: whoever changes, one of them hears again.
    edges = random_graphs(30, 21, largest=8)
    edges += [(v, hub) for v in sorted({v for e in edges for v in e}) for hub in ("!", "zz")]
    frame, components, adjacent, least = tables(spark, edges)
    heard, hear = [], graph.propagation._heard
    monkeypatch.setattr(graph.propagation, "_heard", lambda both, labels: (heard.append(both.count()), hear(both, labels))[1])
    found = {r["id"]: r["community"] for r in graph.communities(frame, components, local_edges=0).collect()}
    labels = graph.spread_labels(adjacent)
    assert found == {v: min(w for w in adjacent if labels[w] == labels[v] and least[w] == least[v]) for v in adjacent}
    assert min(heard) < len(adjacent["zz"]) / 2

"""The network queries over all supplier-part edges, against brute force."""

import pytest

from cairnlake.operators.graph import spread_labels
from cairnlake.plans.catalogue import QUERIES

#: (supplier, part, quantity, discount): two components; one row of each has a large quantity and discount.
ITEMS = [(1, 1, 50.0, 0.1), (1, 2, 3.0, 0.0), (2, 2, 4.0, 0.02), (2, 3, 1.0, 0.0), (1, 3, 9.0, 0.01), (3, 3, 2.0, 0.0), (3, 4, 2.0, 0.0), (3, 4, 7.0, 0.05), (4, 5, 1.0, 0.0), (4, 6, 50.0, 0.1)]
EDGES = {(f"s{s}", f"p{p}") for s, p, *_ in ITEMS}


def around(edges):
    out = {}
    for a, b in sorted(edges):
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def groups(adjacent, without=None):
    left, out = set(adjacent) - {without}, []
    while left:
        reached, todo = set(), [min(left)]
        while todo:
            v = todo.pop()
            if v not in reached and v != without:
                reached.add(v)
                todo.extend(adjacent[v])
        out.append(reached)
        left -= reached
    return out


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame(ITEMS, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_network_queries_read_every_edge(spark, sf_dir):
    adjacent = around(EDGES)
    whole = {min(g): g for g in groups(adjacent)}
    component = {v: c for c, g in whole.items() for v in g}
    run = lambda name: QUERIES[name](spark, sf_dir).collect()

    clusters = {r["component"]: (r["members"], r["relationships"]) for r in run("network_clusters")}
    assert clusters == {c: (len(g), sum(s in g for s, _ in EDGES)) for c, g in whole.items()}
    (summary,) = run("network_summary")
    largest = max(whole, key=lambda c: len(whole[c]))
    assert tuple(summary[c] for c in ("networks", "largest", "members", "largest_component")) == (len(whole), len(whole[largest]), len(adjacent), largest)
    degrees = {r["id"]: (r["degree"], r["centrality"]) for r in run("degree_centrality")}
    assert degrees == {v: (len(n), round(len(n) / (len(adjacent) - 1), 4)) for v, n in adjacent.items()}

    cuts = {v: len(groups(adjacent, v)) - len(whole) + 1 for v in adjacent}
    points = {r["id"]: (r["component"], r["groups"], r["score"]) for r in run("articulation_points")}
    assert points == {v: (component[v], n, 10 * n + len(adjacent[v])) for v, n in cuts.items() if n > 1}
    labels = spread_labels({v: sorted(n) for v, n in sorted(adjacent.items())})
    named = {v: (component[v], min(w for w in labels if labels[w] == labels[v])) for v in adjacent}
    assert {r["id"]: (r["component"], r["community"]) for r in run("communities")} == named

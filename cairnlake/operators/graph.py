"""Graph operators over edge tables: components, degrees, articulation points, communities, cluster metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators import biconnected, ears, propagation, stats
from cairnlake.sources.scratch import Rounds, shuffled, stored

#: Neighbours of a component that one task may hold.
LOCAL_EDGES = 200_000


def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, nbr): each edge seen from both ends, without loops and repeats."""
    ends = edges.select(F.col(a).alias("id"), F.col(b).alias("nbr"))
    return ends.unionByName(ends.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).where("id <> nbr").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id", a: str = "src", b: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable.

    Each label that is linked to smaller ones hooks to the smallest of them, hooks are followed to their ends by doubling,
    and links are drawn between the ends: what links the same ends is one link, what lies within an end is none. So
    links shrink round by round; each round is a table in the shared folder, so plans stay short.
    """
    links, labels, hooks = (Rounds(edges.sparkSession, name) for name in ("links", "labels", "hooks"))
    between = lambda rows, x, y: rows.select(F.least(x, y).alias("low"), F.greatest(x, y).alias("high")).where("low < high").distinct()
    left = links.store(between(edges, a, b))
    found = labels.store(vertices.select(F.col(id_col).alias("id")).distinct().withColumn("component", F.col("id")))
    while not left.isEmpty():
        ends = hooks.store(left.groupBy(F.col("high").alias("at")).agg(F.min("low").alias("end"), F.lit(True).alias("moved")))
        while True:
            beyond = ends.select(F.col("at").alias("end"), F.col("end").alias("beyond"))
            ends = hooks.store(ends.join(beyond, "end", "left").select("at", F.coalesce("beyond", "end").alias("end"), F.col("beyond").isNotNull().alias("moved")))
            if ends.where("moved").isEmpty():
                break
        of = lambda c, name: ends.select(F.col("at").alias(c), F.col("end").alias(name))
        found = labels.store(found.join(of("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        drawn = left.join(of("high", "x"), "high").join(of("low", "y"), "low", "left")
        left = links.store(between(drawn, F.col("x"), F.coalesce("y", "low")))
    return found


def degrees(vertices: DataFrame, edges: DataFrame, id_col: str = "id", a: str = "src", b: str = "dst") -> DataFrame:
    """(id, degree, centrality): distinct neighbours, and their share of all other vertices."""
    n = vertices.select(F.countDistinct(id_col).alias("n"))
    counts = undirected(edges, a, b).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    every = vertices.select(F.col(id_col).alias("id")).distinct().join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return every.crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)), 4).alias("centrality"))


def _neighbours(frame: pd.DataFrame) -> dict:
    out: dict = {}
    for a, b in zip(frame["id"], frame["nbr"], strict=True):
        out.setdefault(a, set()).add(b)
    return {k: sorted(v) for k, v in sorted(out.items())}


def articulation_groups(adjacent: dict) -> dict:
    """vertex -> into how many groups its component falls without it, for vertices where that is more than one."""
    order, low, found = {}, {}, Counter()
    for root in adjacent:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(adjacent[root]))]
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= order[parent]:
                        found[parent] += 1
            elif w not in order:
                order[w] = low[w] = len(order)
                stack.append((w, v, iter(adjacent[w])))
            elif w != parent:
                low[v] = min(low[v], order[w])
        found[root] -= 1  # the root has no group above it
    return {v: n + 1 for v, n in found.items() if n > 0}


def _by_size(both: DataFrame, components: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Stored neighbours (id, nbr, component) of components with up to ``most`` of them, in parts of about so many; and of the others."""
    tied = stored(both.join(components, "id").select("id", "nbr", "component"), "adjacent")
    large = stored(tied.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component"), "large")
    large = F.broadcast(large)  # one in ``most`` rows at most; a shuffle by component would give a task whole components
    few, many = tied.join(large, "component", "left_anti"), tied.join(large, "component", "left_semi")
    return few, many, 1 + few.count() // max(most, 1)


def _in_parts(few: DataFrame, parts: int, found: Callable[[dict], Iterable[tuple]], names: str) -> DataFrame:
    """``found`` on the neighbours of whole small components, many at a time."""
    kind = few.schema["id"].dataType.simpleString()
    ddl = names.replace("KIND", kind)
    columns = [c.split()[0] for c in ddl.split(", ")]

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(found(_neighbours(frame))), columns=columns)

    return few.groupBy(F.pmod(F.xxhash64("component"), F.lit(parts)).alias("part")).applyInPandas(rows, ddl)


class Adjacent(NamedTuple):
    """Neighbours of numbered vertices: ``names`` has (number, id, component), ``few`` and ``many`` as ``_by_size`` gives them."""

    names: DataFrame
    few: DataFrame
    many: DataFrame
    parts: int
    most: int


def adjacent(edges: DataFrame, components: DataFrame, a: str = "src", b: str = "dst", local_edges: int = LOCAL_EDGES) -> Adjacent:
    """What ``articulation_points`` and ``communities`` both read of a graph. Numbers go in the order of ids."""
    names = stored(stats.numbered(components.select("id", "component"), ["id"], "number").select("number", "id", "component"), "numbers")
    of = lambda end, name: names.select(F.col("id").alias(end), F.col("number").alias(name))
    ends = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("src"), F.col(b).alias("dst")).join(of("src", "x"), "src").join(of("dst", "y"), "dst")
    few, many, parts = _by_size(undirected(ends, "x", "y"), _numbers(names), local_edges)
    return Adjacent(names, few, shuffled(many), parts, local_edges)


def _numbers(names: DataFrame) -> DataFrame:
    return names.select(F.col("number").alias("id"), "component")


def articulation_points(edges: DataFrame, components: DataFrame, a: str = "src", b: str = "dst", local_edges: int = LOCAL_EDGES, near: Adjacent | None = None) -> DataFrame:
    """(component, id, groups, score) of bridge vertices; ``near`` is what ``adjacent`` gives, if it is there already.

    A component with more than ``local_edges`` neighbours loses what ``ears.reduced`` finds in one block; if it is still
    as large, it goes through ``biconnected.blocks``, which no task holds whole: a vertex holds as many groups together
    as blocks meet in it. Smaller ones are searched in depth, many to a task.
    """
    near = near or adjacent(edges, components, a, b, local_edges)
    search = lambda few, parts: _in_parts(few, parts, lambda by: [(v, n) for v, n in articulation_groups(by).items()], "id KIND, groups long")
    points = search(near.few, near.parts)
    if not near.many.isEmpty():
        # What is left of a component's neighbours comes to six times as many rows at most.
        few, many, parts = _by_size(ears.reduced(near.many, near.most // 8), _numbers(near.names), near.most)
        points = points.unionByName(search(few, parts))
        if not many.isEmpty():
            ends = stored(many.where("id < nbr").select(F.col("id").alias("a"), F.col("nbr").alias("b")), "numbered-edges")
            points = points.unionByName(biconnected.blocks(ends, connected_components).groupBy("id").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1"))
    points = stored(points, "points")
    degree = near.few.unionByName(near.many).join(points, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    found = points.join(degree, "id").withColumnRenamed("id", "number").join(near.names, "number")
    return found.select("component", "id", "groups", (10 * F.col("groups") + F.col("degree")).alias("score"))


def spread_labels(adjacent: dict, rounds: int = 20) -> dict:
    """Label propagation in sorted order, each vertex hearing what was set before it; ties to the smallest label."""
    labels = {v: v for v in adjacent}
    for _ in range(rounds):
        changed = False
        for v, nbrs in adjacent.items():
            counts = Counter(labels[w] for w in nbrs)
            best = min(counts, key=lambda x: (-counts[x], x)) if counts else labels[v]
            changed |= best != labels[v]
            labels[v] = best
        if not changed:
            break
    return labels


def communities(edges: DataFrame, components: DataFrame, a: str = "src", b: str = "dst", rounds: int = 20, local_edges: int = LOCAL_EDGES, near: Adjacent | None = None) -> DataFrame:
    """(component, id, community): the community is named by its smallest member; ``near`` as for ``articulation_points``.

    Vertices hear each other one after another in both ways; components of more than ``local_edges`` neighbours do so by
    the waves of ``propagation.spread``.
    """
    near = near or adjacent(edges, components, a, b, local_edges)
    labels = _in_parts(near.few, near.parts, lambda by: spread_labels(by, rounds).items(), "id KIND, label KIND")
    if not near.many.isEmpty():
        labels = labels.unionByName(propagation.spread(near.many, rounds))
    labels = stored(labels.withColumnRenamed("id", "number").join(near.names, "number").select("component", "id", "label"), "spread")
    named = labels.groupBy("component", "label").agg(F.min("id").alias("community"))
    return labels.join(named, ["component", "label"]).select("component", "id", "community")


def numbered(components: DataFrame) -> DataFrame:
    """(component, network_id, members): ids go over all components by their smallest member, single ones too."""
    sizes = stats.numbered(components.groupBy("component").agg(F.count(F.lit(1)).alias("members")), ["component"])
    digits = F.lpad(F.col("nth").cast("string"), F.greatest(F.lit(4), F.length(F.col("nth").cast("string"))), F.lit("0"))
    return sizes.select("component", "members", F.concat(F.lit("network:"), digits).alias("network_id"))


def network_metrics(components: DataFrame, edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """One row per component of two members or more: sizes, edge rows and density."""
    rows = edges.select(F.col(a).alias("id")).join(components, "id").groupBy("component").agg(F.count(F.lit(1)).alias("relationships"))
    out = numbered(components).where("members > 1").join(rows, "component", "left")
    density = F.round(2 * F.col("relationships") / (F.col("members") * F.greatest(F.col("members") - 1, F.lit(1))), 4)
    size = F.when(F.col("members") >= 25, "Large").when(F.col("members") >= 10, "Medium").otherwise("Small")
    return out.select("component", "network_id", "members", F.coalesce("relationships", F.lit(0)).alias("relationships"), F.coalesce(density, F.lit(0.0)).alias("density"), size.alias("size_label"))

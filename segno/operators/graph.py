"""The graph of artists heard in the same sessions, and its measures.

Edges and node measures are DataFrame plans.  Algorithms over the whole
structure run on the thresholded graph, of whatever size: communities and cut
vertices, a few passes over its edges, on the driver; centrality, a search
from every node, in tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.operators.pairs import counted_pairs
from segno.operators.sessions import assign_sessions
from segno.plans import durable

#: Nodes by whose distances edges are told that no shortest path takes.
HUBS = 32
#: Nodes whose searches are one task.
SOURCES = 128


def session_nodes(plays: DataFrame, entity: str, least: int, gap: int = 1800) -> DataFrame:
    """(entity, session_start, node): distinct artists of each session, of those with ``least`` plays; all rows shape the sessions."""
    named = assign_sessions(plays, entity, "uts", gap, "play_id").where("trim(artist) <> ''")
    # one row per session and artist, kept: what follows reads it several times
    held = durable(named.groupBy(entity, "session_start", F.lower("artist").alias("node")).agg(F.count("*").alias("n")))
    often = held.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("node")
    return held.drop("n").join(often, "node", "left_semi")


def session_edges(nodes: DataFrame, entity: str, least: int) -> DataFrame:
    """(source, target, shared_sessions, jaccard), source < target, of pairs that share ``least`` sessions.

    Nodes in fewer sessions than that can't have such an edge and aren't
    paired; each task adds up the pairs of its sessions before the shuffle.
    """
    n = nodes.groupBy("node").agg(F.count("*").alias("s")).where(F.col("s") >= least)
    kept = nodes.join(n.select("node"), "node", "left_semi")
    lists = kept.groupBy(entity, "session_start").agg(F.collect_set("node").alias("l")).where("size(l) > 1")
    pairs = counted_pairs(lists, "l").withColumnsRenamed({"a": "source", "b": "target", "n": "shared_sessions"})
    counted = pairs.where(F.col("shared_sessions") >= least)
    a, b = n.select(F.col("node").alias("source"), F.col("s").alias("sa")), n.select(F.col("node").alias("target"), F.col("s").alias("sb"))
    out = counted.join(a, "source").join(b, "target")
    return out.select("source", "target", "shared_sessions", F.round(F.col("shared_sessions") / (F.col("sa") + F.col("sb") - F.col("shared_sessions")), 12).alias("jaccard"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight): each edge from either end."""
    return edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))).alias("e"), F.col("shared_sessions").alias("weight")).select("e.*", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def participation(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(node, participation): 1 - Σ (share of a node's strength into each community)²."""
    into = both_ways(edges).join(communities.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("w"))
    return into.groupBy("node").agg(F.round(1 - F.sum(F.col("w") * F.col("w")) / (F.sum("w") * F.sum("w")), 12).alias("participation"))


def neighbourhood(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(node, distance): nodes at most ``hops`` edges from ``start``; a join per hop over what the hop before reached."""
    links = durable(both_ways(edges).select("node", "other"))  # read once per hop
    reached = links.where(F.col("node") == start).select("node").distinct().withColumn("distance", F.lit(0))
    for k in range(1, hops + 1):
        step = reached.where(F.col("distance") == k - 1).join(links, "node").select(F.col("other").alias("node")).distinct()
        reached = reached.unionByName(step.join(reached.select("node"), "node", "left_anti").withColumn("distance", F.lit(k)))
    return reached.withColumn("distance", F.col("distance").cast("bigint"))


def collected(edges: DataFrame) -> dict[str, dict[str, float]]:
    """The thresholded graph as adjacency, read part by part."""
    graph: dict[str, dict[str, float]] = defaultdict(dict)
    kept = durable(edges.select("source", "target", F.col("shared_sessions").alias("w")))
    for r in kept.orderBy("source", "target").toLocalIterator():
        a, b = sys.intern(r["source"]), sys.intern(r["target"])  # one copy of a name for all its edges
        graph[a][b] = graph[b][a] = float(r["w"])
    return dict(graph)


def communities(graph: dict[str, dict[str, float]], resolution: float = 1.0) -> dict[str, int]:
    """Communities of high modularity: nodes move to the best neighbouring one in the order of names until none gains, then communities become nodes.  Numbers go by the smallest member."""
    members = {v: [v] for v in graph}
    links = {v: dict(ws) for v, ws in graph.items()}
    loops: dict[str, float] = dict.fromkeys(graph, 0.0)
    total = sum(sum(ws.values()) for ws in graph.values())
    while total:
        home = {v: v for v in links}
        strength = {v: sum(links[v].values()) + loops[v] for v in links}
        mass = dict(strength)
        moved, any_moved = True, False
        while moved:
            moved = False
            for v in sorted(links):
                near: dict[str, float] = defaultdict(float)
                for u, w in links[v].items():
                    near[home[u]] += w
                old = home[v]
                mass[old] -= strength[v]
                gain = lambda c: near.get(c, 0.0) - resolution * strength[v] * mass[c] / total  # noqa: B023, E731
                best = max(sorted({old, *near}), key=lambda c: (round(gain(c), 12), c == old))
                mass[best] += strength[v]
                if best != old:
                    home[v], moved, any_moved = best, True, True
        if not any_moved:
            break
        merged: dict[str, list[str]] = defaultdict(list)
        for v, c in home.items():
            merged[c] += members[v]
        new_links: dict[str, dict[str, float]] = {c: defaultdict(float) for c in merged}
        new_loops: dict[str, float] = defaultdict(float)
        for v in links:
            new_loops[home[v]] += loops[v]
            for u, w in links[v].items():
                if home[u] == home[v]:
                    new_loops[home[v]] += w
                else:
                    new_links[home[v]][home[u]] += w
        members, links, loops = dict(merged), {c: dict(ws) for c, ws in new_links.items()}, {c: new_loops[c] for c in merged}
    return {v: k for k, group in enumerate(sorted(members.values(), key=min)) for v in group}


Links = list[list[tuple[int, float]]]


def _search(links: Links, s: int) -> tuple[dict[int, float], dict[int, float], dict[int, list[int]], list[int]]:
    """Distances from ``s``, numbers of shortest paths, the nodes before each on them, and nodes by distance."""
    dist, paths, before, order, seen = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], set()
    queue = [(0.0, s)]
    while queue:
        d, v = heapq.heappop(queue)
        if v in seen:
            continue
        seen.add(v)
        order.append(v)
        for u, length in links[v]:
            there = d + length
            if u not in dist or there < dist[u] - 1e-12:
                dist[u], paths[u], before[u] = there, paths[v], [v]
                heapq.heappush(queue, (there, u))
            elif abs(there - dist[u]) <= 1e-12 and u not in seen:
                paths[u] += paths[v]
                before[u].append(v)
    return dist, paths, before, order


def shortest_links(graph: dict[str, dict[str, float]]) -> Links:
    """Neighbours of each node, by number in the order of ``graph``, and the length 1 / weight, without edges longer than a way through a hub: no shortest path takes those."""
    at = {v: k for k, v in enumerate(graph)}
    links = [[(at[u], 1.0 / w) for u, w in ws.items()] for ws in graph.values()]
    source = np.repeat(np.arange(len(links)), [len(x) for x in links])
    target = np.fromiter((u for x in links for u, _ in x), dtype=np.int64, count=len(source))
    length = np.fromiter((d for x in links for _, d in x), dtype=np.float64, count=len(source))
    best = np.full(len(source), np.inf)
    for hub in heapq.nlargest(HUBS, range(len(links)), key=lambda v: sum(1.0 / d for _, d in links[v])):
        away = np.full(len(links), np.inf)
        for v, d in _search(links, hub)[0].items():
            away[v] = d
        np.minimum(best, away[source] + away[target], out=best)
    # far above the difference up to which two lengths are one
    kept = iter((length <= best + 1e-9).tolist())
    return [[e for e in x if next(kept)] for x in links]


def _between_and_close(links: Links, sources: Iterable[int], pivots: frozenset[int] | None = None) -> tuple[dict[int, float], dict[int, float]]:
    """What the shortest paths from ``sources`` (of ``pivots``, if given) add to betweenness, and the closeness of these."""
    n, between, close = len(links), defaultdict(float), {}
    for s in sources:
        dist, paths, before, order = _search(links, s)
        far = sum(dist.values())
        close[s] = (len(dist) - 1) / far * (len(dist) - 1) / (n - 1) if far and n > 1 else 0.0
        if pivots is not None and s not in pivots:
            continue
        flow: dict[int, float] = defaultdict(float)
        for v in reversed(order):
            for u in before[v]:
                flow[u] += paths[u] / paths[v] * (1 + flow[v])
            if v != s:
                between[v] += flow[v]
    return between, close


def chosen_pivots(graph: dict[str, dict[str, float]], most: int) -> frozenset[int] | None:
    """Numbers of ``most`` nodes by a hash of their names, the same at every run; None for all."""
    if most >= len(graph):
        return None
    order = sorted((hashlib.md5(v.encode()).digest(), k) for k, v in enumerate(graph))
    return frozenset(k for _, k in order[:most])


def centrality(graph: dict[str, dict[str, float]], spark: SparkSession | None = None, most: int | None = None) -> dict[str, tuple[float, float]]:
    """node → (betweenness, closeness), over distances 1 / weight; normalised, closeness scaled by the size of the component.

    With a session, tasks search from a share of the nodes each.  With
    ``most``, betweenness is what so many pivots add to it, scaled up.
    """
    links, n = shortest_links(graph), len(graph)
    pivots = None if most is None else chosen_pivots(graph, most)
    if spark is None or not n:
        between, close = _between_and_close(links, range(n), pivots)
    else:
        shared = spark.sparkContext.broadcast(links)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sources = [k for pdf in batches for k in pdf["id"].tolist()]
            part, near = _between_and_close(shared.value, sources, pivots)
            yield pd.DataFrame([(v, part.get(v, 0.0), near.get(v, 0.0)) for v in {**part, **near}], columns=["id", "between", "close"])

        parts = spark.range(0, n, 1, -(-n // SOURCES)).mapInPandas(search, "id bigint, between double, close double")
        rows = parts.groupBy("id").agg(F.sum("between").alias("between"), F.sum("close").alias("close")).collect()  # one a node
        between, close = {r["id"]: r["between"] for r in rows}, {r["id"]: r["close"] for r in rows}
    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (1 if pivots is None else n / len(pivots))
    return {v: (between.get(k, 0.0) * scale, close[k]) for k, v in enumerate(graph)}


def cut_vertices(graph: dict[str, dict[str, float]]) -> set[str]:
    """Nodes whose removal parts their component."""
    at, low, out, clock = {}, {}, set(), 0
    for root in graph:
        if root in at:
            continue
        children = 0
        stack = [(root, None, iter(graph[root]))]
        at[root] = low[root] = clock
        while stack:
            v, parent, rest = stack[-1]
            for u in rest:
                if u not in at:
                    clock += 1
                    at[u] = low[u] = clock
                    children += v == root
                    stack.append((u, v, iter(graph[u])))
                    break
                if u != parent:
                    low[v] = min(low[v], at[u])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if parent != root and low[v] >= at[parent]:
                        out.add(parent)
        if children > 1:
            out.add(root)
    return out


def node_measures(edges: DataFrame) -> DataFrame:
    """(node, community, betweenness, closeness, cut_vertex) of the thresholded graph."""
    graph = collected(edges)
    group, central, cuts = communities(graph), centrality(graph, edges.sparkSession), cut_vertices(graph)
    rows = [(v, group[v], round(central[v][0], 12), round(central[v][1], 12), v in cuts) for v in sorted(graph)]
    return edges.sparkSession.createDataFrame(rows, "node string, community bigint, betweenness double, closeness double, cut_vertex boolean")

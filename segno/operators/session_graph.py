"""The session graph with its nodes' identity: an artist's id, or its name where there is no id."""

from __future__ import annotations

import math
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segno.functions.text import match_key, stripped
from segno.operators.graph import centrality, collected, communities, cut_vertices
from segno.operators.pairs import counted_pairs
from segno.operators.sessions import assign_sessions
from segno.plans import durable, with_facts


@dataclass(frozen=True)
class GraphConfig:
    """What makes a node and an edge, which years count, and how the whole is measured."""

    gap: int = 1800
    least_plays: int = 10
    least_shared: int = 2
    first_year: int | None = None
    last_year: int | None = None
    resolution: float = 1.0
    pivots: int = 100

    def __post_init__(self):
        if min(self.gap, self.least_plays, self.least_shared, self.pivots) < 1 or not math.isfinite(self.resolution) or self.resolution <= 0:
            raise ValueError("sizes are at least 1, the resolution is finite and positive")
        if self.first_year is not None and self.last_year is not None and self.first_year > self.last_year:
            raise ValueError("the first year is after the last")


def identity(artist: Column, mbid: Column) -> Column:
    """``mbid:`` and the id in lower case, else ``name:`` and the matching key, else null."""
    code, key = stripped(F.lower(mbid)), match_key(artist)
    return F.when(code != "", F.concat(F.lit("mbid:"), code)).when(key != "", F.concat(F.lit("name:"), key))


@dataclass(frozen=True)
class SessionGraph:
    """``nodes`` (node, name, aliases, plays, sessions), ``edges`` (source, target, shared_sessions, distance, jaccard), and what was left out."""

    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame


def session_graph(plays: DataFrame, entity: str, config: GraphConfig = GraphConfig()) -> SessionGraph:
    """Artists heard in the same sessions of an owner.

    Years are filtered first, then all rows that are left shape the sessions,
    also those without an artist; then artists of few plays go, and pairs of
    few sessions.  A node shows its most frequent spelling, the first in order
    on ties; aliases are all spellings.
    """
    kept = plays
    if config.first_year is not None:
        kept = kept.where(F.col("year") >= config.first_year)
    if config.last_year is not None:
        kept = kept.where(F.col("year") <= config.last_year)
    named = assign_sessions(kept, entity, "uts", config.gap, "play_id").withColumn("node", identity(F.col("artist"), F.col("artist_mbid")))
    # a row per session, node and spelling: what follows reads it several times
    held = durable(named.groupBy(entity, "session_start", "node", "artist").agg(F.count("*").alias("n")))

    spelt = held.where("node IS NOT NULL").groupBy("node", "artist").agg(F.sum("n").alias("n"))
    shown = F.min(F.struct((-F.col("n")).alias("k"), "artist"))["artist"]
    all_nodes = durable(spelt.groupBy("node").agg(shown.alias("name"), F.array_join(F.array_sort(F.collect_set("artist")), "|").alias("aliases"), F.sum("n").alias("plays")))
    often = all_nodes.where(F.col("plays") >= config.least_plays)
    in_sessions = held.select(entity, "session_start", "node").where("node IS NOT NULL").distinct().join(often.select("node"), "node", "left_semi")
    lists = durable(in_sessions.groupBy(entity, "session_start").agg(F.collect_set("node").alias("l")))
    sizes = lists.select(F.explode("l").alias("node")).groupBy("node").agg(F.count("*").alias("sessions"))
    nodes = often.join(sizes, "node")

    pairs = durable(counted_pairs(lists.where("size(l) > 1"), "l"))
    a, b = (sizes.select(F.col("node").alias(x), F.col("sessions").alias(f"s_{x}")) for x in "ab")
    met = pairs.where(F.col("n") >= config.least_shared).join(a, "a").join(b, "b")
    edges = met.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("n").alias("shared_sessions"), F.round(1 / F.col("n"), 12).alias("distance"), F.round(F.col("n") / (F.col("s_a") + F.col("s_b") - F.col("n")), 12).alias("jaccard"))

    counts = held.agg(F.sum("n").alias("source_plays"), F.countDistinct(entity, "session_start").alias("sessions"), F.coalesce(F.sum(F.when(F.col("node").isNull(), F.col("n"))), F.lit(0)).alias("empty_artist"))
    found = all_nodes.agg(F.count("*").alias("artists"), F.count_if(F.col("plays") < config.least_plays).alias("artists_below"))
    weak = pairs.agg(F.count_if(F.col("n") < config.least_shared).alias("edges_below"))
    return SessionGraph(nodes, edges, with_facts(with_facts(counts, found), weak))


def both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))
    return edges.select(F.explode(ends).alias("e"), "shared_sessions").select("e.*", "shared_sessions")


def degree_measures(graph: SessionGraph) -> DataFrame:
    """(node, degree, strength, degree_centrality), isolated nodes included."""
    n = graph.nodes.agg(F.count("*").alias("_all"))
    links = both_ways(graph.edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("shared_sessions").alias("strength"))
    out = with_facts(graph.nodes.select("node").join(links, "node", "left").fillna(0, ["degree", "strength"]), n)
    # alone in the graph a node has all the links it can have
    share = F.when(F.col("_all") > 1, F.round(F.col("degree") / (F.col("_all") - 1), 12)).otherwise(1.0)
    return out.select("node", "degree", "strength", share.alias("degree_centrality"))


def participation(graph: SessionGraph, groups: DataFrame) -> DataFrame:
    """(node, participation): 1 - Σ (share of a node's strength into each community)²; 0 for nodes without edges."""
    into = both_ways(graph.edges).join(groups.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("shared_sessions").alias("w"))
    each = into.groupBy("node").agg((1 - F.sum(F.col("w") * F.col("w")) / (F.sum("w") * F.sum("w"))).alias("p"))
    return graph.nodes.select("node").join(each, "node", "left").select("node", F.round(F.coalesce("p", F.lit(0.0)), 12).alias("participation"))


def structure(graph: SessionGraph, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(node, community, betweenness, closeness, cut_vertex) of every node; paths are searched from ``pivots`` nodes for betweenness, from all for closeness.

    Communities are numbered by their smallest members, isolated nodes being
    communities of their own.
    """
    links = collected(graph.edges)
    names = sorted(r["node"] for r in graph.nodes.select("node").toLocalIterator())
    whole = {v: links.get(v, {}) for v in names}
    group, central, cuts = communities(whole, config.resolution), centrality(whole, graph.nodes.sparkSession, config.pivots), cut_vertices(whole)
    rows = [(v, group[v], round(central[v][0], 12), round(central[v][1], 12), v in cuts) for v in names]
    return graph.nodes.sparkSession.createDataFrame(rows, "node string, community bigint, betweenness double, closeness double, cut_vertex boolean")


def measured(graph: SessionGraph, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Nodes with all their measures."""
    shape = durable(structure(graph, config))
    return graph.nodes.join(degree_measures(graph), "node").join(shape, "node").join(participation(graph, shape), "node")


def focus(graph: SessionGraph, name: str, hops: int = 1) -> SessionGraph:
    """``around`` the node that shows this name, whatever its case; a name that no node or several have is an error."""
    found = sorted(r["node"] for r in graph.nodes.where(F.lower("name") == name.lower()).select("node").limit(10).collect())
    if len(found) != 1:
        raise ValueError("no node shows this name" if not found else f"several nodes show this name: {', '.join(found)}")
    return around(graph, found[0], hops)


def around(graph: SessionGraph, node: str, hops: int = 1) -> SessionGraph:
    """The part of a graph at most ``hops`` edges from a node; nodes and edges keep what they measure in the whole graph."""
    if hops < 1:
        raise ValueError("a neighbourhood needs a hop at least")
    links = durable(both_ways(graph.edges).select("node", "other"))
    reached = graph.nodes.where(F.col("node") == node).select("node")
    for _ in range(hops):
        reached = durable(reached.unionByName(reached.join(links, "node").select(F.col("other").alias("node"))).distinct())
    near = lambda end: reached.select(F.col("node").alias(end))
    edges = graph.edges.join(near("source"), "source", "left_semi").join(near("target"), "target", "left_semi")
    return SessionGraph(graph.nodes.join(reached, "node", "left_semi"), edges.select(*graph.edges.columns), graph.diagnostics)


def summary(graph: SessionGraph, measures: DataFrame) -> DataFrame:
    """(community, nodes, members): each community's nodes in order, joined by bars."""
    rows = graph.nodes.select("node").join(measures.select("node", "community"), "node")
    return rows.groupBy("community").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_list("node")), "|").alias("members"))


def graphml(graph: SessionGraph, measures: DataFrame) -> str:
    """GraphML of a graph small enough to be one text: nodes and edges in order, every column an attribute."""
    kinds = {"string": "string", "bigint": "long", "int": "int", "double": "double", "boolean": "boolean"}
    nodes = graph.nodes.select("node").join(measures, "node").orderBy("node")
    edges = graph.edges.orderBy("source", "target")
    lines = ["<?xml version='1.0' encoding='utf-8'?>", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for kind, df, ids in (("node", nodes, {"node"}), ("edge", edges, {"source", "target"})):
        lines += [f'<key id={quoteattr(c)} for="{kind}" attr.name={quoteattr(c)} attr.type="{kinds[t]}"/>' for c, t in df.dtypes if c not in ids]

    def data(row, ids) -> str:
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        return "".join(f"<data key={quoteattr(c)}>{quoteattr(text(v))[1:-1]}</data>" for c, v in row.asDict().items() if c not in ids and v is not None)

    lines.append('<graph edgedefault="undirected">')
    lines += [f"<node id={quoteattr(r['node'])}>{data(r, {'node'})}</node>" for r in nodes.toLocalIterator()]
    lines += [f"<edge source={quoteattr(r['source'])} target={quoteattr(r['target'])}>{data(r, {'source', 'target'})}</edge>" for r in edges.toLocalIterator()]
    return "\n".join([*lines, "</graph>", "</graphml>"])

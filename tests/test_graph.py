"""The session graph with identity: cases by hand."""

import pytest
from pyspark.sql import functions as F

from segno.operators import graph as G
from segno.operators import session_graph as SG
from segno.operators.pairs import counted_pairs
from segno.sources.playlog import with_time


@pytest.fixture
def heard(spark):
    def make(*rows):
        return with_time(spark.createDataFrame([(k, "u", t, a, m, "x") for k, (t, a, m) in enumerate(rows)], "play_id bigint, username string, uts bigint, artist string, artist_mbid string, node string"))

    return make


def edges_of(graph):
    return [(r.source, r.target, r.shared_sessions) for r in graph.edges.orderBy("source", "target").collect()]


def test_boundary_and_blank_rows(heard):
    p = heard((0, "A", ""), (180, "A", ""), (1800, "B", ""), (3601, "A", ""))
    g = SG.session_graph(p, "username", SG.GraphConfig(1800, 1, 1))
    assert edges_of(g) == [("name:a", "name:b", 1)] and g.diagnostics.first().sessions == 2
    g = SG.session_graph(heard((0, "A", ""), (1200, "", ""), (2400, "B", ""), (2500, None, None)), "username", SG.GraphConfig(1800, 1, 1))
    assert edges_of(g) == [("name:a", "name:b", 1)] and g.diagnostics.first().empty_artist == 2


def test_identity_and_aliases(heard):
    rows = [(0, "The A", "ABC"), (1, "the a", "abc"), (2, "THE A", ""), (3, "Rare", ""), (3600, "The A", "ABC"), (3601, "The A", "ABC"), (3602, "THE A", None)]
    g = SG.session_graph(heard(*rows), "username", SG.GraphConfig(1800, 2, 3))
    nodes = {r.node: r for r in g.nodes.collect()}
    assert sorted(nodes) == ["mbid:abc", "name:a"] and (nodes["mbid:abc"].name, nodes["mbid:abc"].aliases, nodes["mbid:abc"].plays, nodes["mbid:abc"].sessions) == ("The A", "The A|the a", 4, 2)
    assert edges_of(g) == []
    d = g.diagnostics.first()
    assert (d.source_plays, d.sessions, d.artists, d.artists_below, d.edges_below) == (7, 2, 3, 1, 1)
    m = {r.node: r for r in SG.measured(g).collect()}
    assert (m["name:a"].degree, m["name:a"].participation, m["name:a"].community, m["name:a"].closeness) == (0, 0.0, 1, 0.0)


def test_years_are_filtered_before_sessions(heard):
    y = 1704067200  # 2024-01-01
    g = SG.session_graph(heard((y - 600, "A", ""), (y, "A", ""), (y + 1200, "Rare", ""), (y + 2400, "B", "")), "username", SG.GraphConfig(1800, 1, 1, 2024, 2024))
    assert g.diagnostics.first().source_plays == 3 and ("name:a", "name:b", 1) in edges_of(g)


def test_jaccard_and_focus(heard):
    g = SG.session_graph(heard((0, "A", ""), (1, "B", ""), (9000, "A", ""), (19000, "B", ""), (29000, "B", ""), (29001, "C", ""), (39000, "C", ""), (39001, "D", "")), "username", SG.GraphConfig(1800, 1, 1))
    e = {(r.source, r.target): r for r in g.edges.collect()}
    assert e["name:a", "name:b"].jaccard == 0.25 and e["name:c", "name:d"].distance == 1.0
    near = SG.focus(g, "a", 1)
    assert sorted(r.node for r in near.nodes.collect()) == ["name:a", "name:b"] and edges_of(near) == [("name:a", "name:b", 1)]
    assert sorted(r.node for r in SG.focus(g, "A", 2).nodes.collect()) == ["name:a", "name:b", "name:c"]
    m = SG.measured(g)
    assert {r.node: r.degree_centrality for r in m.collect()}["name:b"] == 0.666666666667
    assert [r.members for r in SG.summary(g, m).orderBy("community").collect()] == ["name:a|name:b", "name:c|name:d"]
    text = SG.graphml(g, m)
    assert text.count("<node ") == 4 and text.count("<edge ") == 3 and '<key id="aliases" for="node" attr.name="aliases" attr.type="string"/>' in text
    with pytest.raises(ValueError, match="no node"):
        SG.focus(g, "nobody")
    with pytest.raises(ValueError):
        SG.focus(g, "a", 0)
    twice = SG.SessionGraph(g.nodes.withColumn("name", F.lit("same")), g.edges, g.diagnostics)
    with pytest.raises(ValueError, match="several"):
        SG.focus(twice, "SAME")


@pytest.mark.parametrize("bad", [{"gap": 0}, {"least_plays": 0}, {"least_shared": 0}, {"pivots": 0}, {"resolution": 0.0}, {"resolution": float("inf")}, {"first_year": 2020, "last_year": 2019}])
def test_config(bad):
    with pytest.raises(ValueError):
        SG.GraphConfig(**bad)


def test_participation_in_communities(heard):
    # two triangles and a node that belongs half to either
    sessions = ["ab", "bc", "ac", "de", "ef", "df", "xa", "xd"]
    g = SG.session_graph(heard(*[(9000 * k + i, a, "") for k, s in enumerate(sessions) for i, a in enumerate(s)]), "username", SG.GraphConfig(1800, 1, 1))
    groups = g.nodes.select("node", F.when(F.col("name").isin(*"abc"), 0).otherwise(1).alias("community"))
    assert {r.node: r.participation for r in SG.participation(g, groups).collect()}["name:x"] == 0.5


def test_pivots():
    ring = {str(k): {str((k - 1) % 40): 1.0, str((k + 1) % 40): 1.0} for k in range(40)}
    whole, part = G.centrality(ring), G.centrality(ring, most=10)
    assert G.centrality(ring, most=40) == whole and part == G.centrality(ring, most=10)
    assert abs(sum(b for b, _ in part.values()) / sum(b for b, _ in whole.values()) - 1) < 1e-9  # a ring looks alike from everywhere
    assert all(part[v][1] == whole[v][1] for v in ring)


def test_counted_pairs(spark, monkeypatch):
    monkeypatch.setattr("segno.operators.pairs.HELD_PAIRS", 1)
    df = spark.createDataFrame([(["b", "a", None, "a"],), (["a", "b", "c"],), ([],), (None,)], "l array<string>").repartition(2)
    assert sorted(tuple(r) for r in counted_pairs(df, "l").collect()) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_empty(heard):
    g = SG.session_graph(heard((0, "A", "")).limit(0), "username")
    assert g.nodes.count() == g.edges.count() == SG.measured(g).count() == 0

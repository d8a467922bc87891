import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from segno.operators import changepoints as CP
from segno.operators import counts as C
from segno.operators import critics as K
from segno.operators import evaluate as E
from segno.operators import graph as G
from segno.operators import sessions as S
from segno.operators import trajectory as T
from segno.operators import vectors as V
from segno.operators import windows as W
from segno.operators.heavy import artist_counts, heavy_artists
from segno.operators.plays import merged_plays
from segno.sources.playlog import picks, read_critic_json, read_csv, read_stream_history, release_rows, with_time, write_csv

DAY = 86_400


def brute_sessions(rows, gap):
    out = []
    for user in sorted({u for u, _ in rows}):
        times = sorted(t for u, t in rows if u == user)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > gap:
                out.append((user, times[start], times[i - 1], i - start))
                start = i
    return out


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_sessions_against_brute_force(spark, partitions, monkeypatch):
    rng = np.random.default_rng(partitions)
    # one user holds most rows, so that several partitions share them
    rows = [("hot" if rng.random() < 0.7 else f"u{rng.integers(4)}", int(t)) for t in rng.integers(0, 40_000, 400)]
    df = spark.createDataFrame([(u, t, "x", 1) for u, t in rows] + [(None, 5, "x", 1), ("u1", None, "x", 1)], "username string, uts bigint, gap string, n_events int")
    monkeypatch.setattr(S, "in_order", lambda d, e, t, f=S.in_order: f(d, e, t, partitions=partitions))
    tree = S.gap_tree(df, "username", "uts").cache()
    for gap in (0, 60, 300, 1800):
        got = sorted((r.username, r.start_ts, r.end_ts, r.n_events) for r in S.cut_tree(tree, gap).collect())
        assert got == sorted(brute_sessions(rows, gap))
    assigned = S.assign_sessions(df, "username", "uts", 300).groupBy("username", "session_start").agg(F.max("uts").alias("z"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, assigned)) == sorted(brute_sessions(rows, 300))


def test_a_gap_of_the_setting_is_no_cut(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1800), ("a", 3601)], "username string, uts bigint")
    assert sorted((r.start_ts, r.end_ts) for r in S.sessions(df, "username", "uts").collect()) == [(0, 1800), (3601, 3601)]
    assert S.sessions(df.limit(0), "username", "uts").count() == 0


def test_merged_plays(plays_of, artists_of):
    rows = [("u", 10, "Ab Cd", "x", "Song Tune"), ("u", 10, "ab cd", None, "song tume"), ("u", 10, "Ab Cd", None, None), ("u", 10, None, None, "Song Tune"), ("u", 10, "Ab Cd", "", "Song Tune (Live)"), ("v", 10, "Ab Cd", None, "Song Tune"), ("u", None, "Ab Cd", None, "Song Tune"), (None, 10, "Ab Cd", None, "Song Tune")]
    rows += [("u", 20, "Ab Cd", None, f"Tune {w}") for w in ("alpha", "bravo", "charlie", "delta", "echos", "foxtrot", "golfs", "hotel", "india", "juliet", "kilos", "limas", "mikes", "november", "oscars", "papas", "quebec", "romeos", "romeoss")]
    got = sorted(r.play_id for r in merged_plays(plays_of(rows), artists_of("Ab Cd")).collect())
    assert got == [1, 3, 4, 5, 6, *range(9, 27)]
    assert merged_plays(plays_of([]), artists_of("Ab Cd")).count() == 0


def test_heavy_artists(plays_of, artists_of):
    plays = plays_of([("u", None, "the ab", None, None)] * 50 + [("v", 1, "AB", None, None)] * 10 + [("v", 2, "Cd", None, None)] + [("v", 3, None, None, None), ("v", 3, "", None, None)] + [(None, 3, "Ef", None, None)] * 60)
    artists = artists_of("The Ab", "Cd", "Ef", "Gh", None)
    counts = {r.artist_id: (r.n_plays, r.n_listeners) for r in artist_counts(plays, artists).collect()}
    assert counts == {100: (60, 2), 101: (1, 1), 102: (60, 0), 103: (0, 0)}
    assert sorted(r.artist_id for r in heavy_artists(plays, artists).collect()) == [100, 102]
    assert heavy_artists(plays.limit(0), artists).count() == 0 and artist_counts(plays.limit(0), artists.limit(0)).count() == 0


def timed(plays_of, rows):
    return with_time(plays_of(rows))


def test_top_breaks_ties_by_name(plays_of):
    p = timed(plays_of, [("u", 1704067200, "Artist A", "Album A", "T1"), ("u", 1704153600, "Artist A", "Album A", "T2"), ("u", 1704240000, "Artist C", None, "T"), ("u", 1735689600, "Artist B", "", "T")])
    assert [(r.artist, r.plays, r["rank"]) for r in C.top(p, [], ["artist"], 2).orderBy("rank").collect()] == [("Artist A", 2, 1), ("Artist B", 1, 2)]
    assert [r.artist for r in C.discovered(p, [], 2025).collect()] == ["Artist B"]
    one = C.familiarity(p, []).collect()[0]
    assert (one.tracks, one.plays, round(one.dispersion, 9)) == (2, 2, round(0.9999999997, 9))


def month(year, m, day=1):
    return int((date(year, m, day) - date(1970, 1, 1)).days) * DAY


def test_timeline_summary_and_peak(spark, plays_of):
    p = timed(plays_of, [("u", month(2024, 1, 31), "A", "", ""), ("u", month(2024, 3, 1), "a", "", ""), ("u", month(2024, 3, 2), "A", "", "")])
    keys = spark.createDataFrame([("a",)], "key string")
    line = T.timeline(p, [], keys, 2023 * 12 + 11, 2024 * 12 + 3)
    assert [r.plays for r in line.orderBy("period").collect()] == [0, 1, 0, 2, 0]
    s = T.summary(line, []).collect()[0]
    assert (s.plays, s.active_share, s.span, s.span_share) == (3, 0.4, 3, 0.666667)
    k = T.peak_and_ramp(line, []).collect()[0]
    assert (k.peak_plays, k.peak_periods, k.distance, k.mean_change, k.slope) == (2, "2024-03", 2, 0.5, 0.5)


def test_dormancy(spark, plays_of):
    p = timed(plays_of, [("u", month(2024, m), "A", "", "") for m in (1, 3, 6, 10)])
    line = T.timeline(p, [], spark.createDataFrame([("a",)], "key string"), 2023 * 12 + 11, 2025 * 12)
    got = [(r.gap, r.return_period - 2024 * 12 + 1, r.complete6) for r in T.dormancy(line, [], 2).orderBy("return_period").collect()]
    assert got == [(2, 6, True), (3, 10, False)]


def test_cohort_retention(plays_of):
    a = [("u", month(2024, 1, 1), "A"), ("u", month(2024, 1, 2), "A"), ("u", month(2024, 2, 1), "A"), ("u", month(2024, 4, 1), "A"), ("u", month(2024, 1, 3), "B"), ("u", month(2024, 3, 1), "B"), ("u", month(2023, 12, 1), "Old"), ("u", month(2024, 1, 5), "Old")]
    p = timed(plays_of, [(u, t, x, "", "") for u, t, x in a])
    got = {r.offset: (r.eligible, r.retained, r.rate) for r in T.cohort_retention(p, [], [1, 2, 3, 5, 3]).where("cohort = '2024-01'").collect()}
    assert got == {1: (2, 1, 0.5), 2: (2, 1, 0.5), 3: (2, 1, 0.5), 5: (0, 0, None)}


def test_event_windows():
    parts = W.intervals(W.EventWindow(date(2024, 3, 10), 1, 1, 1, 1, "America/Los_Angeles"))
    start, end = next((a, z) for n, a, z, *_ in parts if n == "event")
    assert (start % DAY, end - start) == (8 * 3600, 23 * 3600)
    with pytest.raises(ValueError):
        W.intervals(W.EventWindow(date(2011, 12, 30), 1, 1, 1, 1, "Pacific/Apia"))
    assert [x[3:] for x in W.intervals(W.EventWindow(date(2011, 12, 29), 2, 1, 1, 1, "Pacific/Apia")) if x[0] == "event"] == [(1, 1)]
    clipped = {n: (a, b) for n, *_, a, b in W.intervals(W.EventWindow(date(2024, 1, 5), 1, 4, 4, 3), month(2024, 1, 3), month(2024, 1, 7))}
    assert clipped["pre"] == (4, 2) and clipped["post"] == (4, 2) and clipped["baseline_before"] == (3, 0)
    with pytest.raises(ValueError):
        W.EventWindow(date(2024, 1, 1), 0)


def test_bins_and_escaping(plays_of):
    p = timed(plays_of, [("u", month(2024, 1, 31), "__OTHER__", "", ""), ("u", month(2024, 1, 30), "__OTHER__", "", ""), ("u", month(2024, 1, 2), "A", "", ""), ("u", month(2024, 3, 2), "B", "", "")])
    rows = {(r.bin, r.artist): r.n for r in CP.bin_counts(p, [], CP.Segmentation("month", 2)).collect()}
    assert len(rows) == 9 and rows["2024-01-01", "\\__OTHER__"] == 2 and rows["2024-03-01", CP.OTHER] == 1 and rows["2024-02-01", "A"] == 0


def exhaustive(x, penalty, least):
    from itertools import combinations

    def cost(cuts):
        edges = [0, *cuts, len(x)]
        return sum(((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum() for a, b in zip(edges, edges[1:])) + penalty * len(cuts)

    options = [c for n in range(len(x)) for c in combinations(range(1, len(x)), n) if all(b - a >= least for a, b in zip([0, *c], [*c, len(x)]))]
    best = min(map(cost, options))
    return list(min((c for c in options if cost(c) <= best + 1e-9), key=lambda c: (len(c), c)))


def test_cuts_are_the_best():
    assert CP.best_cuts(np.array([[0.0]] * 3 + [[5.0]] * 3), 1, 3) == [3]
    rng = np.random.default_rng(20240612)
    for _ in range(60):
        x = rng.integers(-2, 3, (rng.integers(3, 8), 3)).astype(float)
        assert CP.best_cuts(x, 1.5, 1) == exhaustive(x, 1.5, 1)


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1e7])
def test_cuts_are_the_best_at_any_scale(scale):
    rng = np.random.default_rng(8675309)
    for n in range(3, 8):
        for _ in range(12):
            x = rng.normal(size=(n, 2))
            least, penalty = int(rng.integers(1, n // 2 + 1)), float(rng.choice([0.0, 0.1, 2.0]))
            want = exhaustive(x, penalty, least)
            assert CP.best_cuts(x * scale, penalty * scale**2, least) == want
    assert CP.best_cuts(np.array([[-1e-6, -2e-6], [-1e-6, 0.0], [1e-6, -1e-6]]), 1e-12, 1) == [1, 2]
    flat = [[0.0]] * 2
    assert CP.best_cuts(np.array(flat + [[3.0]] * 2 + [[9.0]] * 2), 1, 2) == [2, 4]
    assert CP.best_cuts(np.array([[0.0], [0.0], [1.0], [1.0], [0.0], [0.0]]), -0.5, 2) == [2, 4]


def test_change_points(plays_of):
    p = timed(plays_of, [("u", month(2024, m), "A" if m < 4 else "B", "", "") for m in range(1, 7)])
    got = [(r.first_bin, r.bins) for r in CP.change_points(p, ["username"], CP.Segmentation(penalty=0.01)).orderBy("segment").collect()]
    assert got == [("2024-01-01", 3), ("2024-04-01", 3)]


def test_graph_measures():
    def graph(*edges):
        g = {}
        for a, b, w in edges:
            g.setdefault(a, {})[b] = g.setdefault(b, {})[a] = w
        return g

    two = graph(*[(a, b, 1.0) for t in ("abc", "def") for a in t for b in t if a < b])
    assert G.communities(two) == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1}
    path = graph(("a", "b", 1.0), ("b", "c", 1.0))
    central = G.centrality(path)
    assert central["b"] == (1.0, 1.0) and round(central["a"][1], 6) == 0.666667 and G.cut_vertices(path) == {"b"}
    assert G.centrality(graph(("a", "b", 10.0), ("b", "c", 10.0), ("a", "c", 1.0)))["b"][0] == 1.0
    assert G.communities({}) == {} and G.cut_vertices({}) == set()


def test_session_graph(plays_of):
    p = timed(plays_of, [("u", 0, "A", "", ""), ("u", 180, "A", "", ""), ("u", 1800, "", "", ""), ("u", 3000, "B", "", ""), ("u", 9000, "C", "", "")])
    edges = G.session_edges(G.session_nodes(p, "username", 1), "username", 1).collect()
    assert [(e.source, e.target, e.shared_sessions, e.jaccard) for e in edges] == [("a", "b", 1, 1.0)]


def test_node_measures_of_a_graph_of_any_size(spark):
    # a ring of 210,000 edges between 700 nodes, each with its next 300; weights by distance, and a tail that hangs on one
    ring = spark.range(700).selectExpr("id AS a", "explode(sequence(1, 300)) AS k").selectExpr("a", "(a + k) % 700 AS b", "301 - k AS shared_sessions")
    edges = ring.unionByName(spark.createDataFrame([(0, 9999, 1)], "a bigint, b bigint, shared_sessions int")).selectExpr("lpad(least(a, b), 4, '0') AS source", "lpad(greatest(a, b), 4, '0') AS target", "shared_sessions")
    got = {r.node: r for r in G.node_measures(edges).collect()}
    assert len(got) == 701 and [v for v, r in got.items() if r.cut_vertex] == ["0000"] and got["9999"].betweenness == 0
    assert max(got.values(), key=lambda r: r.closeness).node == "0000"


def test_centrality_in_tasks(spark):
    rng = random.Random(4)
    graph = {}
    for _ in range(1500):
        a, b = rng.sample(range(200), 2)
        w = float(rng.choice([3, 4, 5, 8, 60]) * (20 if min(a, b) < 3 else 1))
        graph.setdefault(str(a), {})[str(b)] = graph.setdefault(str(b), {})[str(a)] = w
    links, at = G.shortest_links(graph), {v: k for k, v in enumerate(graph)}
    whole = [[(at[u], 1 / w) for u, w in graph[v].items()] for v in graph]
    assert sum(map(len, links)) < sum(map(len, whole))
    between, close = G._between_and_close(whole, range(len(whole)))
    scale = 1 / ((len(whole) - 1) * (len(whole) - 2))
    for got in (G.centrality(graph), G.centrality(graph, spark)):
        assert all(abs(got[v][0] - between[k] * scale) < 1e-12 and abs(got[v][1] - close[k]) < 1e-12 for v, k in at.items())


def test_nearest(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(m)] + [(99, None, "x")], "vec_id bigint, embedding array<double>, place string")
    got = {(r.query_id, r.place): r.vec_id for r in V.nearest(df, df.where("vec_id % 10 = 0"), 5).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = unit @ unit[q]
        s[q] = -2
        assert [got[q, k] for k in range(1, 6)] == np.argsort(-s)[:5].tolist()


def test_embedding_of_many_items(spark):
    rng = np.random.default_rng(5)
    n = 3200
    a, b = rng.integers(0, n, 12000), rng.integers(0, n, 12000)
    rows = {(int(min(x, y)), int(max(x, y))): float(w) for x, y, w in zip(a, b, rng.random(12000) * (1 + 9 * (a < 40)), strict=True) if x != y}
    rows |= {(k, k + 1): 0.1 for k in range(n - 1) if (k, k + 1) not in rows}
    df = spark.createDataFrame([(f"{x:04}", f"{y:04}", w) for (x, y), w in rows.items()], "a string, b string, weight double")
    got = np.array([r.embedding for r in V.embed(df, "weight", 8).orderBy("item").collect()])
    m = np.eye(n)
    for (x, y), w in rows.items():
        m[x, y] = m[y, x] = w
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:8]
    want = V._rows(list(vectors[:, order] * np.abs(values[order])))
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-5 and np.abs(got @ got.T - want @ want.T).max() < 1e-5


def test_diversified_and_sample(spark):
    df = spark.createDataFrame([("u", "a1", "a", 1.0), ("u", "a2", "a", 0.9), ("u", "b1", "b", 0.5), ("u", "c1", "c", 0.0)], "username string, item string, artist string, score double")
    assert [r.item for r in V.diversified(df, ["username"], "item", "artist", "score", 3).orderBy("place").collect()] == ["a1", "b1", "a2"]
    assert V.weighted_sample(df, "item", "score", 2).collect() == V.weighted_sample(df, "item", "score", 2).collect()


def test_diversified_chooses_from_all_items(spark):
    # the first 250 items are of one group; the lowest item of all bounds relevance
    rows = [("u", f"a{k:03}", "a", 1.0 - k / 1000) for k in range(250)] + [("u", "b", "b", 0.72), ("u", "c", "c", 0.71), ("u", "z", "a", 0.0)]
    rng = random.Random(6)
    rows += [("v", f"i{k}", rng.choice("abcdefgh"), float(rng.randint(0, 40))) for k in range(400)]
    want = []
    for user in "uv":
        left, used = sorted([r[1:] for r in rows if r[0] == user], key=lambda r: (-r[2], r[0])), set()
        low, high = left[-1][2], left[0][2]
        for place in range(1, 11):
            best = max(left, key=lambda r: 0.7 * ((r[2] - low) / (high - low)) + (1 - 0.7) * (r[1] not in used))
            want.append((user, place, best[0]))
            used.add(best[1])
            left.remove(best)
    df = spark.createDataFrame(rows, "username string, item string, artist string, score double")
    got = V.diversified(df, ["username"], "item", "artist", "score", 10).collect()
    assert sorted((r.username, r.place, r["item"]) for r in got) == want


def test_match_key(spark):
    names = [("  The Beat, les! ", "beat les"), ("Björk", "björk"), ("the  ", "the"), ("!!!", ""), (None, None)]
    rows = spark.createDataFrame(names, "n string, k string").withColumn("got", K.match_key(F.col("n"))).collect()
    assert all(r.got == r.k for r in rows)


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 3, 4), (1, 3, 1, 1)], "g int, place int, relevance int, popularity int")
    want = (3 / np.log2(3) + 1 / np.log2(4)) / (3 + 1 / np.log2(3))
    assert abs(E.ndcg(ranked, ["g"], 3).collect()[0].ndcg - want) < 1e-6
    assert E.hits(ranked, ["g"], 2, [1, 3]).collect()[0][1:] == (1, 1)
    assert E.kendall([(1, 1), (2, 2), (3, 3)])[0] == 1.0 and E.kendall([(1, 1), (2, 1)]) == (0.0, 1.0)


def test_sources(spark, tmp_path, plays_of):
    folder = tmp_path / "csv"
    write_csv(spark.createDataFrame([(5, "01 Jan 1970", "A,b", None, 'q"x', None, "T", None)], "uts bigint, utc_time string, artist string, artist_mbid string, album string, album_mbid string, track string, track_mbid string").coalesce(1), str(folder))
    row = read_csv(spark, str(folder)).collect()[0]
    assert (row.uts, row.artist, row.album_mbid, row.year) == (5, "A,b", "", 1970)
    (tmp_path / "critics-2014.json").write_text('[{"critic": "C", "publication": "P", "albums": [{"artist": "A", "title": "T", "rank": 2}]}]')
    lists = read_critic_json(spark, str(tmp_path / "critics-2014.json"))
    assert lists.collect()[0].year == 2014
    assert picks(lists.withColumn("list_id", F.lit(1))).collect()[0]["rank"] == 2
    (tmp_path / "h.json").write_text('[{"ts": "2024-01-01T00:00:00Z", "ms_played": 40000, "skipped": false, "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A"}, {"ts": "2024-01-01T00:00:00Z", "ms_played": 10, "master_metadata_track_name": "U"}]')
    assert [(r.uts, r.track, r.album) for r in read_stream_history(spark, str(tmp_path / "h.json")).collect()] == [(1704067200, "T", "")]
    (tmp_path / "d.json").write_text('{"id": "r", "title": "T", "date": "1999-03", "country": "XA", "artist-credit": [{"name": "A", "joinphrase": " & ", "artist": {"id": "m", "name": "A"}}, {"name": "B", "joinphrase": "", "artist": {"id": "n", "name": "B"}}], "release-group": {"primary-type": "Album", "secondary-types": ["Live"]}, "tags": [{"name": "x", "count": 1}, {"name": "y", "count": 3}], "label-info": [{"label": {"name": "L"}}]}')
    r = release_rows(spark.read.json(str(tmp_path / "d.json"))).collect()[0]
    assert (r.artist_credit, r.year, r.release_type, r.genres, r.labels) == ("A & B", 1999, "live", ["y", "x"], ["L"])


def test_fuzzy_match(spark):
    from segno.functions.similarity import common_letters, ratio

    rng = np.random.default_rng(11)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_letters(a, b) == table[-1][-1]
    words = ["amber", "harbour", "silver", "letter", "kitchen", "garden", "tunnel"]
    known = [(f"{rng.choice(words)} {k}x", f"{rng.choice(words)} {rng.choice(words)} {k}") for k in range(40)]
    asked = [(a, t.replace("e", "", 1)) for a, t in known[:20]] + known[20:25] + [("nobody at all", "nothing like it")]
    got = {(r.a_key, r.t_key): (r.known_a, r.known_t) for r in K.fuzzy_match(spark.createDataFrame(asked, "a_key string, t_key string"), spark.createDataFrame(known, "a_key string, t_key string")).collect()}
    want = {}
    for a, t in set(asked):
        if (a, t) in known:
            want[a, t] = (a, t)
            continue
        fits = [(-(0.7 * ratio(t, y) + 0.3 * ratio(a, x)), x, y) for x, y in known if ratio(a, x) >= 85 and ratio(t, y) >= 85]
        if fits:
            want[a, t] = min(fits)[1:]
    assert got == want


def test_eras(plays_of):
    from segno.operators.eras import eras, trends

    p = timed(plays_of, [("u", month(2010 + y, 2), "A" if y < 3 else "B", "", "") for y in range(6) for _ in range(y + 1)])
    assert [(r.year, r.era) for r in eras(p, ["username"]).orderBy("year").collect()] == [(2010 + y, int(y >= 3)) for y in range(6)]
    assert {r.measure: r.tau for r in trends(p, ["username"]).collect()}["plays"] == 1.0


def test_streaming_sessions(spark, tmp_path):
    from segno.streaming.sessions import streaming_sessions

    rows = [("a", 0), ("a", 600), ("a", 6000), ("b", 100), ("z", 900_000)]
    spark.createDataFrame(rows, "username string, t bigint").select("username", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("username string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming_sessions(stream, "username", "ts").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.username, r.a, r.z, r.n_events) for r in spark.sql("SELECT username, unix_timestamp(start_ts) a, unix_timestamp(end_ts) z, n_events FROM found").collect())
    assert got == [("a", 0, 600, 2), ("a", 6000, 6000, 1), ("b", 100, 100, 1)]


def test_the_rest_stands_without_llm():
    import ast
    from pathlib import Path

    for path in (Path(__file__).resolve().parents[1] / "segno").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_pages(spark):
    from segno.sources.pages import list_entries, wanted_links

    html = "<html><title>Ann's best of 2014</title><ol><li>1. <a href='/a'>Ab &amp; Cd</a> - <a href='/t'>The Tune</a></li><li>no entry</li><li>Ef – Other</li></ol></html>"
    rows = list_entries(spark.createDataFrame([("u", html, 1), ("v", None, 2), ("w", "", 3)], "url string, html string, title int")).orderBy("rank").collect()
    assert [(r.page_title, r["rank"], r.artist, r.title, r.album_url) for r in rows] == [("Ann's best of 2014", 1, "Ab & Cd", "The Tune", "/t"), ("Ann's best of 2014", 2, "Ef", "Other", None)]
    links = spark.createDataFrame([("http://x/lists/best-2014",), ("http://x/lists/",), ("http://x/about",)], "url string")
    assert [r.url for r in wanted_links(links, "http://x/lists/", ["best"]).collect()] == ["http://x/lists/best-2014"]


def test_alike_names(spark):
    """All names alike, also where a slip shifts every letter behind it."""
    import random

    from segno.functions.similarity import ratio

    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghé ") for _ in range(rng.randint(1, 24))) for _ in range(60)]
    for name in names[:60]:
        s = list(name)
        for _ in range(rng.randint(1, 4)):
            at = rng.randint(0, len(s) - 1) if s else 0
            s[at : at + rng.randint(0, 1)] = [rng.choice("abé")] * rng.randint(0, 1)
        names.append("".join(s) or "x")
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string")
    for least in (85.0, 75.0):
        got = {(r.x, r.y) for r in K.alike_names(of(names[:80]), of(names[40:]), least).collect()}
        assert got == {(x, y) for x in names[:80] for y in names[40:] if ratio(x, y) >= least}
    with_albums = [(f"{''.join(rng.choice('abcdefghijkl') for _ in range(14))}", f"songs from {k}") for k in range(50)]
    assert K.fuzzy_match(spark.createDataFrame(with_albums[:20], "a_key string, t_key string"), spark.createDataFrame(with_albums[20:], "a_key string, t_key string")).count() == 0

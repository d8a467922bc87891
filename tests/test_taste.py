"""Taste, evaluation, ranked lists and stores by hand."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from segno.operators import critics as K
from segno.operators import evaluate as E
from segno.operators import taste as T
from segno.operators import vectors as V
from segno.sources import pages, playlog, stores
from segno.sources.playlog import with_time

WEEK = 7 * 86_400


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def log(plays_of, *plays):
    return with_time(plays_of([("u", *r, *[""] * (4 - len(r))) for r in plays]))


@pytest.fixture
def listed(spark):
    def make(*picks):
        return spark.createDataFrame(picks, "list_id int, critic string, publication string, year bigint, artist string, title string, rank bigint, place bigint")

    return make


def test_temporal_matrix(plays_of):
    p = log(plays_of, (0, "A"), (1, "A"), (2, "B"), (WEEK, "A"), (2 * WEEK, "A"), (3 * WEEK, "B"), (3 * WEEK, "rare"))
    got = {(r.window, r.artist): r.value for r in T.temporal_matrix(p, [], 2).collect()}
    a, b = np.log1p(2) * np.log(4 / 4), np.log1p(1) * np.log(4 / 3)
    assert abs(got["1969-12-29", "B"] - b / np.hypot(a, b)) < 1e-12 and got["1970-01-05", "A"] == 0.0 and len(got) == 5


def test_taste_gaps_and_bridges(spark, plays_of):
    near = spark.createDataFrame([("x", b, k) for k, b in enumerate("abcd", 1)], "a string, b string, place int")
    flat = spark.createDataFrame([(c, [float(c == d) for d in "abcd"]) for c in "abcd"], "item string, embedding array<double>")
    assert rows(T.bridge_items(near, flat), "item", "diversity") == [("x", 1.0)]
    same = flat.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert T.bridge_items(near, same).count() == 0 and T.bridge_items(near.where("place < 4"), flat).count() == 0
    p = log(plays_of, (0, "X"), (1, "x"), (2, "Y"))
    given = spark.createDataFrame([("x", 0.1, "p", "q"), ("y", 0.5, "", "")], "a string, jaccard double, only_one string, only_other string")
    assert rows(T.taste_gaps(given, p, 2), "a", "plays", "label") == [("x", 2, "divergent")]
    assert {r.a: r.label for r in T.taste_gaps(given.withColumn("jaccard", F.lit(0.2)), p, 1).collect()} == {"x": None, "y": None}


def test_gateways_and_similar(spark, plays_of):
    near = spark.createDataFrame([("new", "old", 2), ("new", "late", 1), ("new", "older", 3), ("new", "oldest", 4)], "a string, b string, place int")
    y = 1_420_070_400  # 2015
    p = log(plays_of, (5, "Old"), (6, "Older"), (7, "Oldest"), (y, "New"), (y + 1, "Late"))
    assert rows(T.gateways(p, ["username"], 2015, near), "artist", "gateway", "place") == [("new", "old", 1), ("new", "older", 2)]
    s = T.similar_to(near, ["NEW", "none"], 2).orderBy("ordinal").collect()
    assert [(r.asked, r.status, r.similar) for r in s] == [("NEW", "ok", "late|old"), ("none", "unknown", "")]


def test_drift_and_similar_critics(spark):
    taste = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
    v = spark.createDataFrame([("c", 2010, [0.0, 1.0]), ("c", 2012, [1.0, 0.0]), ("d", 2011, [1.0, 0.0])], "critic string, year int, embedding array<double>")
    assert rows(T.drift(v, "critic", taste), "critic", "years", "first", "last", "trend") == [("c", 2, 0.0, 1.0, "rising"), ("d", 1, 1.0, 1.0, "stable")]
    assert [(r.critic, r.similarity) for r in T.most_similar(v, "critic", taste, 0.5).collect()] == [("c", 1.0), ("d", 1.0)]
    assert rows(T.dimension_shares(v), "dim", "share") == [(0, 0.5), (1, 0.5)]


def test_mode_weights(spark):
    df = spark.createDataFrame([(0.5, 0, 0.5, False), (0.5, 3, 0.05, True), (0.0, 0, 0.9, True), (0.01, 9, 0.0, False)], "al double, n int, s double, b boolean")
    got = {m: [r[0] for r in df.select(T.mode_weight(m, F.col("al"), F.col("n"), F.col("s"), F.col("b"))).collect()] for m in T.MODES}
    assert got == {"adventurous": [0.5, 0.15, 0.001, 0.01], "familiar": [3.0, 0.05, 0.001, 0.01], "bridge": [0.05, 5.0, 0.001, 0.01]}
    with pytest.raises(ValueError):
        T.mode_weight("bold", F.lit(1), F.lit(1), F.lit(1), F.lit(True))


def test_continuation(spark):
    near = spark.createDataFrame([("a", "b", 1), ("b", "a", 30), ("c", "x", 1)], "a string, b string, place int")
    baskets = spark.createDataFrame([(1, i) for i in "abcz"] + [(2, "a"), (2, "b")] + [(1, "a")], "s int, i string")
    r = E.continuation(baskets, ["s"], "i", near).first()
    assert (r.sessions, r.predictions, r.hits_10, r.hits_50, r.rate_10, r.mrr) == (1, 6, 1, 2, 0.166667, round((1 + 1 / 30) / 6, 6))
    none = E.continuation(baskets.limit(0), ["s"], "i", near).first()
    assert (none.sessions, none.predictions, none.mrr) == (0, 0, 0.0)


def test_window_neighbours(spark):
    """As neighbours of pairs, with spellings of one name, halves in the seventh place and ties, in one block and in many; and spaces side by side."""
    import random

    rng = random.Random(4)
    names = ["Ara", "ara", "ARA", "Bo", "bo", *[f"n{k}" for k in range(40)], "É", "z"]
    rows = [(u, w, n) for u in "uv" for w in range(40) for n in rng.sample(names, rng.randint(1, 12))]
    rows += [("x", w, n) for w in range(128) for n in ("one", "two")[: 1 if w else 2]] + [("y", w, "two") for w in range(127)]
    rows += [("z", 0, "rare"), ("z", 0, "z")]
    plays = spark.createDataFrame(rows * 2, "username string, w int, artist string")
    want = V.neighbours(V.weekly_pairs(plays, ["username"], 3, F.col("w")), "cosine", 5)
    in_order = lambda df: sorted(map(tuple, df.collect()))
    assert in_order(V.window_neighbours(plays, ["username"], 3, 5, F.col("w"))) == in_order(want) != []
    held, V.HELD_CELLS = V.HELD_CELLS, 1
    try:
        assert in_order(V.window_neighbours(plays, ["username"], 3, 5, F.col("w"))) == in_order(want)
    finally:
        V.HELD_CELLS = held
    assert V.window_neighbours(plays.limit(0), ["username"], 3, 5, F.col("w")).collect() == []
    baskets = plays.select("username", "w", F.lower("artist").alias("i"))
    got = E.continuations(baskets, ["username", "w"], "i", {"all": want, "none": want.limit(0), "few": want.where("a < 'n3'")}).collect()
    kept = {(r.a, r.b): r.place for r in want.collect()}
    for r in got:
        near = {k: p for k, p in kept.items() if r.space == "all" or r.space == "few" and k[0] < "n3"}
        known = {a for a, _ in near}
        lists = {}
        for u, w, n in rows:
            lists.setdefault((u, w), set()).add(n.lower())
        each = [x & known for x in lists.values() if len(x) >= 3 and len(x & known) > 1]
        places = [near[a, b] for x in each for a in x for b in x if (a, b) in near]
        assert (r.sessions, r.predictions, r.hits_10) == (len(each), sum(len(x) * (len(x) - 1) for x in each), len(places))
        assert r.mrr == pytest.approx(sum(1 / p for p in places) / max(1, r.predictions), abs=1e-6)


def test_holdout_and_runs(spark, tmp_path):
    items = lambda *xs: spark.createDataFrame([(x,) for x in xs], "item string")
    near = spark.createDataFrame([("s", "n1", 1), ("s", "o", 2), ("t", "n2", 1), ("q", "r", 1)], "a string, b string, place int")
    r = E.holdout(items(*"sss", "t", "o"), items("n1", "n2", "s", "n3"), near, 3, 20).first()
    assert (r.discoveries, r.seeds, r.pool, r.predicted, r.baseline, r.rate, r.lift) == (3, 1, 2, 1, 0, 0.333333, None)
    m = spark.createDataFrame([("hits", 3.0), ("ndcg", 0.5)], "metric string, value double")
    stores.save_run(m, str(tmp_path / "runs"), "one")
    stores.save_run(m.withColumn("value", F.col("value") * 2), str(tmp_path / "runs"), "two")
    stores.save_run(m.where("metric = 'hits'"), str(tmp_path / "runs"), "two")
    got = E.compare_runs(stores.load_runs(spark, str(tmp_path / "runs")), ["one", "two"])
    assert rows(got.fillna(-1.0), "metric", "one", "two") == [("hits", 3.0, 3.0), ("ndcg", 0.5, -1.0)]


def test_exact_kendall():
    for n in (2, 3, 5, 6):
        sums = [sum((p[j] > p[i]) - (p[j] < p[i]) for i in range(n) for j in range(i + 1, n)) for p in permutations(range(n))]
        for s in set(sums):
            assert abs(E.exact_kendall_p(n, s) - min(1.0, 2 * sum(x >= abs(s) for x in sums) / len(sums))) < 1e-12
    assert E.kendall([(1, 1), (2, 2), (3, 3), (4, 4)]) == (1.0, 2 / 24)


def test_lists_in_detail(listed, plays_of):
    picks = listed((1, "Ann", "P", 2014, "The Ab", "Tune", 1, 0), (2, "Ann", "P", 2015, "Ab", "tune", None, 0), (3, "Bob", "Q", 2014, "Ab", "Tune!", 2, 0), (3, "Bob", "Q", 2014, "Cd", "Song", 9, 1), (4, None, None, None, "Cd", "Song", 3, 0), (5, "Eve", "P", 2014, None, "x", 1, 0))
    p = log(plays_of, (1_388_534_400 - 5, "Ab", "Tune"), (1_400_000_000, "AB", "Tune"), (1_400_000_001, "the ab", "tune"), (5, "Zz", ""))
    assert rows(K.heard(p), "a_key", "t_key", "plays") == [("ab", "tune", 3)]
    assert rows(K.spellings(picks), "artist", "title", "critics") == [("Cd", "Song", 1), ("The Ab", "Tune", 2)]
    # one critic in 2014 and one in a list without a year
    assert rows(K.blind_spots(picks, p, 1), "a_key", "critics", "years") == [("cd", 1, 1)]
    assert rows(K.validated(picks, p, 2), "a_key", "before_critics") == [("ab", True)]
    i = K.validated_insights(picks, p, 1).first()
    assert (i.albums, i.mean_listings, i.top_artist, i.top_year) == (1, 3.0, "ab", 2014)
    assert rows(K.critic_picks(picks, p), "critic", "heard", "missed") == [("Ann", "ab - tune:3", ""), ("Bob", "ab - tune:3", "cd - song")]
    s = K.review_summary(picks).first()
    assert (s.lists, s.entries, s.mean_size, s.median_size, s.albums, s.artists) == (4, 5, 1.3, 1, 2, 2)
    assert rows(K.review_albums(picks, p, 2, 2, 1), "a_key", "consensus", "darling", "deep_cut") == [("ab", True, True, True), ("cd", False, False, False)]
    a = {r.a_key: r for r in K.album_listings(picks, p).collect()}
    assert a["ab"].critics == "Ann:2014:1|Bob:2014:2|Ann:2015:999" and a["ab"].years == "2014,2015" and a["ab"].peak_month == 2014 * 12 + 4 and a["cd"].plays is None
    assert rows(K.artist_in_lists(picks, p, "THE AB"), "t_key", "year", "listings", "critics", "plays") == [("tune", 2014, 3, "Ann|Bob", 3)]
    assert rows(K.champions(picks, p, "ab"), "critic", "times", "alignment") == [("Ann", 2, 1.0), ("Bob", 1, 0.5)]
    assert (K.resolve_critic(picks, "ann"), K.resolve_critic(picks, "o"), K.resolve_critic(picks, "zz")) == ("Ann", "Bob", None)
    assert rows(K.profiles(picks, p), "critic", "rank") == [("Ann", 1), ("Bob", 2)]
    assert K.in_years(picks, 2015, 2016).count() == 1
    e = picks.limit(0)
    assert K.blind_spots(e, p, 1).count() == K.critic_picks(e, p).count() == K.album_listings(e, p.limit(0)).count() == 0
    assert K.recommended(picks, p, 5).count() == 1 and K.overlap(picks, p.limit(0)).first().overlap == 0.0


def test_rarest_bigrams_meet(spark):
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("abcd "), rng.integers(1, 14))) for _ in range(400)})
    first = {r.n: set(r.prefix) for r in K.rarest_bigrams(spark.createDataFrame([(n,) for n in names], "n string"), "n", 85.0).collect()}
    from segno.functions.similarity import ratio

    assert all(first[a] & first[b] for a in names for b in names if ratio(a, b) >= 85)
    with pytest.raises(ValueError):
        K.rarest_bigrams(spark.createDataFrame([("a",)], "n string"), "n", 60.0)


def test_stores(spark, tmp_path, monkeypatch):
    assert stores.find_export(tmp_path, "NO_SUCH_VARIABLE") is None
    for n in ("recenttracks-b.csv", "recenttracks-a.csv", "other.csv"):
        (tmp_path / n).write_text("uts\n")
    assert stores.find_export(tmp_path, "NO_SUCH_VARIABLE").name == "recenttracks-b.csv"
    monkeypatch.setenv("AN_EXPORT", str(tmp_path / "other.csv"))
    assert stores.find_export(tmp_path, "AN_EXPORT").name == "other.csv"
    v = spark.createDataFrame([("a", [1.0])], "item string, embedding array<double>")
    stores.save_space(v, str(tmp_path / "spaces"), dims=1, least=2)
    assert stores.load_space(spark, str(tmp_path / "spaces"), least=2, dims=1).count() == 1 and stores.load_space(spark, str(tmp_path / "spaces"), dims=9) is None
    assert stores.as_json(spark.createDataFrame([(1, None)], "b int, a string")).first().json == '{"a":null,"b":1}'


def test_setup_and_views(spark, tmp_path, plays_of, artists_of):
    plays_of([("u", 1, "A", "", "t")]).write.parquet(str(tmp_path / "plays.parquet"))
    artists_of("A").drop("name").write.parquet(str(tmp_path / "artists.parquet"))
    got = {r.name: (r.status, r.details) for r in stores.check_setup(spark, str(tmp_path)).collect()}
    assert got["plays"] == ("ok", "1 rows") and got["artists"] == ("missing", "without name") and got["releases"][0] == "missing" and got["embeddings"][0] == "optional"
    assert stores.register_views(spark, str(tmp_path)) == ["plays"] and spark.sql("SELECT artist FROM plays").first().artist == "A"


def test_release_years(spark):
    albums = spark.createDataFrame([("A", "X", "m1"), ("A", "Y", ""), ("A", "Z", "m9"), ("A", "No", None)], "artist string, album string, album_mbid string")
    cache = spark.createDataFrame([("m1", 1999), ("a|||x", 1990), ("a|||y", 2001), (None, 1)], "key string, year int")
    found = spark.createDataFrame([("A", "Z", 2005), ("A", "Y", 1950)], "artist string, album string, year int")
    got = {r.album: (r.year, r.source) for r in stores.release_years(albums, cache, found).collect()}
    assert got == {"X": (1999, "cache by id"), "Y": (2001, "cache by name"), "Z": (2005, "releases"), "No": (None, None)}


def test_csv_counts_and_dump(spark, tmp_path):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "B")], "uts bigint, artist string").repartition(3)
    assert playlog.write_csv(df, str(tmp_path / "c"), F.col("artist").isNotNull()) == (3, 2) and playlog.write_csv(df, str(tmp_path / "d")) == (3, 3)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    good = '{"id": "r", "title": "T", "date": "1999-03", "artist-credit": [{"name": "A", "joinphrase": "", "artist": {"id": "m", "name": "A"}}], "release-group": {"primary-type": "Album"}, "tags": [{"name": "x", "count": 2}, {"name": "", "count": 1}], "label-info": [{"catalog-number": "c1", "label": {"id": "l", "name": "L"}}, {"label": null}]}'
    (tmp_path / "dump.json").write_text(f'{good}\n{{"id": "broken\n\n{{"id": "s", "title": ""}}\n')
    t = playlog.release_tables(playlog.read_dump(spark, str(tmp_path / "dump.json")))
    assert [(r.id, r.year, r.release_type) for r in t["releases"].collect()] == [("r", 1999, "album")]
    assert rows(t["release_genres"], "release_id", "genre", "count") == [("r", "x", 2)] and rows(t["release_labels"], "label_name", "catalog_number") == [("L", "c1")]


def test_critics_of_pages(spark):
    for title, url, want in (("Ann Lee: The Top 50", "x", "Ann Lee"), ("Best albums: a list", "http://x/2014/the-daily-post-top-50-albums-of-2014", "The Daily Post"), ("List", "http://x/2014/solo", "Solo"), ("", "", "")):
        assert pages.critic_of(title, url) == want
    df = spark.createDataFrame([("http://x/2014/ann-best-of", None)], "url string, page_title string")
    assert pages.with_critic(df).first().critic == "Ann"


def test_windows_of_pairs(plays_of):
    p = log(plays_of, (0, "A"), (86_400, "B"), (86_400, "A"))
    assert rows(V.weekly_pairs(p, [], 1, F.date_trunc("day", "ts")), "a", "b", "weeks") == [("A", "B", 1)]

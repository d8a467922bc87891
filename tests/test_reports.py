"""Reports by hand, with nulls, ties and empty logs."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from segno.operators import reports as R
from segno.sources.playlog import with_time

DAY = 86_400


def at(y, m=1, d=1, h=0):
    return int(datetime(y, m, d, h, tzinfo=timezone.utc).timestamp())


def log(plays_of, *rows):
    return with_time(plays_of([("u", *r, *[""] * (4 - len(r))) for r in rows]))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_last_days_and_first_seen(plays_of, spark):
    p = log(plays_of, (at(2024, 1, 1, 23), "A"), (at(2024, 1, 2), "B"), (at(2024, 1, 3), "A"))
    assert rows(R.last_days(p, at(2024, 1, 3, 15), 1), "artist") == [("A",), ("B",)]
    assert rows(R.first_seen(p.select("artist", "uts", "play_id"), ["artist"], ["uts", "play_id"]), "artist", "play_id") == [("A", 1), ("B", 2)]
    twice = spark.createDataFrame([(None, 2, "x"), (None, 1, "y")], "k string, o int, v string")
    assert rows(R.first_seen(twice, ["k"], ["o"]), "v") == [("y",)]


def test_known_albums_and_top_tracks(plays_of):
    p = log(plays_of, *[(k, "A", "X", f"t{k % 5}") for k in range(25)], (99, "A", "Y", None), (100, "A", "Z", "b"), (101, "A", "Z", "a"))
    assert rows(R.known_albums(p, ["username"]), "album") == [("X",)]
    assert rows(R.known_albums(p, ["username"], 0.6), "album") == [("X",)] and R.known_albums(p, ["username"], 0.1).count() == 2
    assert rows(R.top_track_of_albums(p, ["username"]).fillna(""), "album", "top_track", "plays") == [("X", "t0", 25), ("Y", "", 1), ("Z", "a", 2)]


def test_short_release_artists(plays_of, spark):
    p = log(plays_of, *[(k, "A", "Ep", "s") for k in range(6)], (10, "A", "Lp", "x"), (11, "A", "?", "x"), (12, "B", "Lp2", "x"))
    found = spark.createDataFrame([("A", "Ep", "ep", 1), ("A", "Lp", "album", 2), ("B", "Lp2", "album", 3)], "artist string, album string, release_type string, plays int")
    r = R.short_release_artists(p, ["username"], found, 0.5, 5).collect()
    assert [(x.artist, x.album_plays, x.short_plays, x.unknown_plays, x.plays, x.short_ratio, x.top_short, x.top_short_track) for x in r] == [("A", 1, 6, 1, 8, 0.857, "Ep", "s")]


def test_temporal(plays_of):
    p = log(plays_of, (at(2024, 1, 1, 5), "A"), (at(2024, 1, 3, 5), "A"), (at(2024, 3, 6, 7), "A"), (at(2024, 3, 4, 7), "A"))
    week = R.temporal(p, ["username"], "weekday").collect()
    # Monday and Wednesday tie; the first by name is the peak
    assert len(week) == 7 and [r.weekday for r in week if r.peak] == ["Monday"] and sum(r.plays for r in week) == 4
    assert rows(R.temporal(p, [], "hour"), "hour", "plays", "pct", "peak") == [(5, 2, 50.0, True), (7, 2, 50.0, False)]
    months = R.temporal(p, [], "month").collect()
    assert len(months) == 12 and [r.month for r in months if r.peak] == [1]
    assert R.temporal(p.limit(0), ["username"], "month").count() == 0


def test_totals_and_years(plays_of):
    p = log(plays_of, (at(2020), "A", "X"), (at(2020), None), (at(2022), "B", "Y"), (at(2022), "A", "X"), (at(2022), "", ""))
    assert rows(R.totals(p, ["username"]), "plays", "artists", "years", "plays_a_year", "peak_year", "peak_plays") == [(5, 2, 3, 1.67, 2022, 3)]
    assert [(r.year, r.plays, r.artists, r.albums, r.plays_before) for r in R.year_totals(p, []).orderBy("year").collect()] == [(2020, 2, 1, 1, None), (2022, 3, 2, 2, None)]
    y = R.yearly_tops(p, []).orderBy("year").collect()
    assert [(r.discoveries, r.top_artists) for r in y] == [("A", "A"), ("B", "A|B")]
    assert rows(R.year_albums(p, [], 2022), "rank", "album", "is_new") == [(1, "X", False), (2, "Y", True)]
    s = R.artist_sparklines(p, []).orderBy("rank").collect()
    assert [(r.artist, r.by_year, r.steps) for r in s] == [("A", "1,0,1", "8,0,8"), ("B", "0,0,1", "0,0,8")]
    assert rows(R.consistent_artists(p, []), "artist") == [("A",)]
    assert R.totals(p.limit(0), ["username"]).count() == 0
    assert rows(R.artist_years(p, [], "a"), "year", "plays") == [(2020, 1), (2022, 1)]
    assert rows(R.artist_albums(p, [], "a").fillna(0), "album", "plays", "familiarity") == [("X", 2, 0.32)]


def test_loyalty_groups(plays_of):
    years = {"Long": [(y, 1) for y in range(2015, 2020)], "Back": [(2015, 1), (2019, 1)], "Gap": [(2010, 12), (2014, 9)], "Gone": [(2015, 30)], "Few": [(2015, 29)]}
    p = log(plays_of, *[(at(y) + k, a) for a, ys in years.items() for y, n in ys for k in range(n)])
    assert rows(R.loyalty_groups(p, ["username"]), "group", "artist") == [("abandoned", "Gap"), ("abandoned", "Gone"), ("long_term", "Long"), ("rediscovered", "Back")]


def test_echo_score(plays_of):
    one = R.echo_score(log(plays_of, *[(k, "A") for k in range(1000)]), []).first()
    assert (one.top10_pct, one.artists_for_half, one.artists_per_1000, one.score, one.level) == (100.0, 1, 1.0, round(35 + 35 + 95 * 0.2 + 98 * 0.1, 2), "critical")


def test_calendar(plays_of):
    p = log(plays_of, *[(d * DAY + k, "BAC"[k % 3], "") for d in range(5) for k in range(d + 1)], (0, None), (1, ""))
    got = {r.day_of: r for r in R.calendar_days(p, ["username"]).collect()}
    assert got["1970-01-01"].plays == 3 and got["1970-01-01"].top_artists == "B" and got["1970-01-05"].top_artists == "A|B|C" and got["1970-01-05"].level == 5 and got["1970-01-02"].level == 0


def test_release_ages(plays_of, spark):
    p = log(plays_of, (at(2020), "A", "X"), (at(2021), "A", "X"), (at(2021), "A", "Y"), (at(2021), "A", "No"))
    found = spark.createDataFrame([("A", "X", 2020), ("A", "Y", 1990), ("A", "No", None)], "artist string, album string, year int")
    assert rows(R.lag_buckets(R.first_plays_of_albums(p, ["username"], found), ["username"]), "bucket", "albums", "pct") == [("10+ years", 1, 50.0), ("Same year", 1, 50.0)]
    assert rows(R.release_ages(p, ["username"], found), "year", "plays", "new_pct", "modern_pct") == [(2020, 1, 100.0, 100.0), (2021, 2, 0.0, 50.0)]


def test_streaks_and_discovery(plays_of):
    p = log(plays_of, (0, "A"), (DAY, "A"), (5 * DAY, "A"), (6 * DAY, "A"), (7 * DAY, "B"), (8 * DAY, "B"), (9 * DAY, "C"))
    assert rows(R.artist_streaks(p, ["username"]), "artist", "days", "first_day", "active") == [("A", 2, "1970-01-01", False), ("B", 2, "1970-01-08", True)]
    q = log(plays_of, (0, "X"), (DAY, "New", "Al", "Tr"), (DAY, "Same moment"), (DAY + 60, "Y"), (DAY + 60, ""), (2 * DAY, "Y"), (2 * DAY + 1, "late"))
    r = R.discovery_days(q, ["username"], "new").first()
    assert (r.first_track, r.first_album, r.session_plays, r.day_before, r.day_after) == ("Tr", "Al", 4, "X:1", "Y:2")
    assert R.discovery_days(q, ["username"], "nobody").count() == 0


def test_one_track_years(plays_of):
    p = log(plays_of, (at(2020), "A", "X", "t"), (at(2020), "A", "X", "t"), (at(2021), "A", "Y", "t"), (at(2021), "A", "Y", "o"))
    assert rows(R.one_track_years(p, []), "artist", "track", "peak_years") == [("A", "t", "2020,2021")]


@pytest.mark.parametrize("n", [1, 7])
def test_partitions_do_not_matter(plays_of, n):
    p = log(plays_of, *[(at(2010 + k % 7, 1 + k % 12), "ABCD"[k * k % 4], "XY"[k % 2], f"t{k % 3}") for k in range(120)])
    for make in (R.loyalty_groups, R.echo_score, R.calendar_days, R.artist_sparklines, R.peak_obsessions):
        assert sorted(map(str, make(p.repartition(n), ["username"]).collect())) == sorted(map(str, make(p, ["username"]).collect()))
    assert R.quantised(F.array(F.lit(1))) is not None

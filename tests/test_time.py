"""Trajectories, cohorts, event windows and change reports on hand-computed cases."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from segno.operators import changepoints as CP
from segno.operators import trajectory as T
from segno.operators import windows as W
from segno.sources.playlog import with_time


def at(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


def log(plays_of, *rows):
    return with_time(plays_of([("u", at(r[0]), *r[1:], *[""] * (4 - len(r))) for r in rows]))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def key(spark, name="a"):
    return spark.createDataFrame([(name,)], "key string")


def test_timeline_and_summary(spark, plays_of):
    p = log(plays_of, ("2024-01-31T23:59:59", "A"), ("2024-03-01T12:34:56", "a"), ("2024-03-02T01:02:03", "A"))
    low, high = T.window(p, "month", "2023-12", "2024-04")
    line = T.timeline(p, [], key(spark), low, high)
    assert [(r.month, r.plays) for r in line.orderBy("period").collect()] == [("2023-12", 0), ("2024-01", 1), ("2024-02", 0), ("2024-03", 2), ("2024-04", 0)]
    s = one(T.summary(line, []))
    assert (s.plays, s.active_share, s.span, s.span_share, s.first_uts, s.last_uts) == (3, 0.4, 3, 0.666667, at("2024-01-31T23:59:59"), at("2024-03-02T01:02:03"))
    o = one(T.observation(line, p, [], low, high))
    assert (o.left_truncated, o.right_truncated, o.right_censored, o.leading_inactive, o.trailing_inactive) == (False, False, True, 1, 1)
    o = one(T.observation(T.timeline(p, [], key(spark), low + 2, low + 2), p, [], low + 2, low + 2))
    assert (o.left_truncated, o.right_truncated, o.right_censored, o.leading_inactive, o.trailing_inactive) == (True, True, False, 1, 1)
    assert T.window(p, "month") == (low + 1, low + 3)


def test_yearly_peak_and_ramp(spark, plays_of):
    p = log(plays_of, ("2020-05-01", "beta"), ("2022-05-01", "Beta"), ("2022-05-02", "Beta"), ("2023-05-01", "BETA"), ("2023-05-02", "beta"))
    line = T.timeline(p, [], key(spark, "beta"), 2020, 2023, grain="year")
    r = one(T.peak_and_ramp(line, [], "year"))
    assert (r.peak_plays, r.peak_period, r.peak_periods, r.distance, r.change, r.mean_change, r.slope) == (2, 2022, "2022,2023", 2, 1, 0.5, 0.5)
    # Beta and beta tie: the first in order is shown
    b = T.trajectories(p, [], ["BETA", "gone"], 2020, 2021, 1, "year").orderBy("ordinal").collect()
    assert [(r.asked, r.status, r.shown, r.plays) for r in b] == [("BETA", "ok", "Beta", 1), ("gone", "not_found", None, 0)]
    alone = one(T.peak_and_ramp(T.timeline(p, [], key(spark, "beta"), 2022, 2022, grain="year"), [], "year"))
    assert (alone.distance, alone.mean_change, alone.slope) == (0, None, None)


def test_dormancy_and_segments(spark, plays_of):
    p = log(plays_of, *[(f"2024-{m:02}-05", "A") for m in (1, 3, 6, 10)])
    line = T.timeline(p, [], key(spark), *T.window(p, "month", "2023-12", "2025-01"))
    m = 2024 * 12 - 1
    got = [(r.gap, r.start_period - m, r.end_period - m, r.return_period - m, r.next6, r.complete6) for r in T.dormancy(line, [], 2).orderBy("return_period").collect()]
    assert got == [(2, 4, 5, 6, 2, True), (3, 7, 9, 10, 1, False)]
    parts = [(r.segment, r.start_period - m, r.end_period - m, r.active_periods) for r in T.active_segments(line, [], 2).orderBy("segment").collect()]
    assert parts == [(1, 1, 3, 2), (2, 6, 6, 1), (3, 10, 10, 1)]


def test_cohort_details(plays_of):
    rows = [("2024-01-01", "A"), ("2024-01-02", "A"), ("2024-02-01", "A"), ("2024-04-01", "A"), ("2024-01-03", "B"), ("2024-03-01", "B"), ("2023-12-01", "Old"), ("2024-01-05", "Old"), ("2024-01-05", " ")]
    p = log(plays_of, *rows)
    s = {r.cohort: r for r in T.cohort_summary(p, []).collect()}
    assert sorted(s) == ["2023-12", "2024-01", "2024-02", "2024-03", "2024-04"]
    r = s["2024-01"]
    assert (r["size"], r.mean_first, r.median_first, r.later, r.later_rate) == (2, 1.5, 1.5, 2, 1.0)
    empty = s["2024-03"]
    assert (empty["size"], empty.mean_first, empty.median_first, empty.later, empty.later_rate) == (0, None, None, 0, None)
    cells = T.cohort_retention(p, [], [3, 1, 3]).where("cohort = '2024-02'").orderBy("offset").collect()
    assert [(c.offset, c.eligible, c.retained, c.rate) for c in cells] == [(1, 0, 0, None), (3, 0, 0, None)]


def test_cohort_thresholds_and_grains(plays_of):
    p = log(plays_of, ("2023-12-31", "A"), ("2024-01-01", "A"), ("2023-12-01", "B"), ("2023-12-02", "B"), ("2024-01-02", "B"), ("2024-01-03", "B"))
    cells = {(r.cohort, r.offset): r.rate for r in T.cohort_retention(p, [], [1, 2], 2, 2).collect()}
    assert cells == {("2023-12", 1): 1.0, ("2023-12", 2): None, ("2024-01", 1): None, ("2024-01", 2): None}
    p = log(plays_of, ("2024-01-01", "January"), ("2024-01-02", "January"), ("2024-02-01", "January"), ("2024-02-02", "January"), *[(f"2024-{m}-0{d}", "November") for m in (11, 12) for d in (1, 2)])
    r = one(T.cohort_retention(p, [], [1], 2, 2, "year", "month"))
    assert (r.cohort, r.eligible, r.retained, r.rate) == ("2024", 2, 2, 1.0)
    # the window's end is the last period that counts
    r = one(T.cohort_retention(p, [], [1], 1, 1, "month", "month", "2024-11", "2024-11"))
    assert (r.eligible, r.rate) == (0, None)


def test_trajectory_errors(spark, plays_of):
    p = log(plays_of, ("2024-01-01", None))
    for grain, text in (("month", "2024"), ("month", "2024-13"), ("year", "2024-01"), ("week", "2024")):
        with pytest.raises(ValueError):
            T.bound(text, grain)
    with pytest.raises(ValueError):
        T.window(p, "month", "2024-03", "2024-02")
    for bad in (p.limit(0), p.drop("artist"), p.withColumn("ts", F.lit(None).cast("timestamp"))):
        with pytest.raises(ValueError):
            T.validated_history(bad)
    assert one(T.validated_history(p)).artist == ""
    for offsets, least in (([], 1), ([-1], 1), ([1], 0)):
        with pytest.raises(ValueError):
            T.cohort_retention(p, [], offsets, least)
    with pytest.raises(ValueError):
        T.trajectories(p, [], ["a", ""], 1, 2)


def test_event_by_hand(plays_of):
    rows = [("2024-01-01T12:00", "A", "One", "x"), ("2024-01-02T12:00", "A", "One", "x"), ("2024-01-03T12:00", "A", "One", "x"), ("2024-01-04T12:00", "B", "Two", "y")]
    rows += [(f"2024-01-0{d}T{h}:00", "A", "One", "x") for d, hs in ((5, (12, 13)), (6, (12, 13, 14)), (7, (12,)), (8, (12,))) for h in hs] + [("2024-01-09T12:00", "C", "Three", "z")]
    p, spec = log(plays_of, *rows), W.EventWindow(date(2024, 1, 5), 1, 1, 1, 3)
    parts = W.covered_intervals(p, spec)
    got = {r.artist: r for r in W.compare(p, [], parts, 10).collect()}
    a = got["A"]
    assert [a[f"{q}_plays"] for q in ("pre", "event", "post", "baseline")] == [0, 2, 3, 5] and a.event_expected == 0.833333 and a.change == 3
    assert a.event_residual == round((2 - 5 / 6) / (5 / 6) ** 0.5, 6) and (a.in_pre, a.in_event, a.in_post, a.in_baseline, a.first_in_event) == (False, True, True, True, False)
    # A gains the whole share of post, B loses that of pre; of equal changes the one with more plays in post is first
    assert [r.artist for r in sorted(got.values(), key=lambda r: r.place)] == ["A", "B", "C"]
    stats = {r.period: r for r in W.period_stats(p, [], parts).collect()}
    b = stats["baseline"]
    assert (b.plays, b.artists, b.albums, b.tracks, b.days, b.per_day) == (6, 2, 2, 2, 6, 1.0) and stats["baseline_before"].plays == 3
    tops = {r.period: (r.entities, r.returned, r.tops) for r in W.period_tops(p, [], parts, 1, "track").collect()}
    assert tops["baseline"] == (2, 1, "A - x:5")


def test_event_without_baseline(plays_of):
    p = log(plays_of, ("2023-12-31T12:00", "old"), ("2024-01-01T12:00", "old"), ("2024-01-02T00:00", " new "), ("2024-01-02T01:00", ""), ("2024-01-03T12:00", "old"), ("2024-01-04T12:00", "old"))
    rows = {r.artist: r for r in W.compare(p, [], W.covered_intervals(p, W.EventWindow(date(2024, 1, 2), 1, 1, 1, 1)), 10).collect()}
    assert (rows["new"].event_expected, rows["new"].event_residual, rows["new"].first_in_event, rows["new"].event_share) == (0.0, None, True, 0.5)
    short = W.compare(p, [], W.covered_intervals(p, W.EventWindow(date(2024, 1, 2), 1, 2, 2, 9)), 10)
    assert {(r.event_expected, r.event_residual) for r in short.collect()} == {(None, None)}
    with pytest.raises(ValueError):
        W.covered_intervals(p, W.EventWindow(date(2025, 1, 2), 1, 1, 1, 1))
    with pytest.raises(ValueError):
        W.covered_intervals(p.limit(0), W.EventWindow(date(2025, 1, 2), 1, 1, 1, 1))
    with pytest.raises(ValueError):
        W.entity_key("genre")


def test_change_report(plays_of):
    p = log(plays_of, *[(f"2024-{m:02}-0{d}", "A" if m < 4 else "B") for m in range(1, 7) for d in ((1,) if m < 4 else (1, 2))])
    spec = CP.Segmentation(penalty=0.01)
    cuts = CP.change_points(p, ["username"], spec)
    r = one(CP.change_report(p, ["username"], spec, cuts))
    assert (r.change, r.bin, r.distance, r.rate_change, r.top_changes) == (1, "2024-04-01", round(2**0.5, 10), 1.0, "A:-1.0|B:1.0")
    s = CP.segment_report(p, ["username"], spec, cuts).orderBy("segment").collect()
    assert [(x.plays, x.plays_per_bin, x.unique_artists, x.empty_bins, x.top_shares) for x in s] == [(3, 1.0, 1, 0, "A:1.0"), (6, 2.0, 1, 0, "B:1.0")]
    gap = log(plays_of, ("2024-01-01", "A"), ("2024-03-01", "A"))
    assert one(CP.segment_report(gap, [], CP.Segmentation(least=3), CP.change_points(gap, [], CP.Segmentation(least=3)))).empty_bins == 1


def test_rows_in_any_order(plays_of):
    p = log(plays_of, *[(f"20{y}-{m:02}-01", "AB"[(m + y) % 3 == 0]) for y in (20, 21, 22) for m in range(1, 13)])
    want = CP.change_points(p, ["username"]).collect()
    assert CP.change_points(p.repartition(7), ["username"]).collect() == want
    few = CP.change_points(p, ["username"], CP.Segmentation(penalty=9.0)).count()
    assert few <= len(want)

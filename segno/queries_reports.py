"""Queries of the reports over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segno.operators import counts as C
from segno.operators import reports as R
from segno.queries_core import BY, _matched, _plays

ARTIST = "The Paper Estuaries"
#: 2016-06-01 12:00 UTC, "now" of the reports that look back.
NOW = 1_464_782_400


def _recent(spark: SparkSession, d: str) -> DataFrame:
    return C.top(R.last_days(_plays(spark, d), NOW, 365), BY, ["artist"], 10)


def _first_albums(spark: SparkSession, d: str) -> DataFrame:
    rows = _plays(spark, d).where("album <> '' AND username IS NOT NULL").select("username", "artist", "album", "uts", "play_id")
    return R.first_seen(rows, ["username", "artist", "album"], ["uts", "play_id"])


QUERIES = {
    "recent_artists": _recent,
    "first_seen_albums": _first_albums,
    "known_albums": lambda s, d: R.known_albums(_plays(s, d), BY, 0.4),
    "known_albums_5x5": lambda s, d: R.known_albums(_plays(s, d), BY),
    "album_top_tracks": lambda s, d: R.top_track_of_albums(_plays(s, d), BY),
    "short_release_artists": lambda s, d: R.short_release_artists(_plays(s, d), BY, _matched(s, d), 0.3, 5),
    "one_track_years": lambda s, d: R.one_track_years(_plays(s, d), BY),
    "temporal_hours": lambda s, d: R.temporal(_plays(s, d), BY, "hour"),
    "temporal_weekdays": lambda s, d: R.temporal(_plays(s, d), BY, "weekday"),
    "temporal_months": lambda s, d: R.temporal(_plays(s, d), BY, "month"),
    "overview_totals": lambda s, d: R.totals(_plays(s, d), BY),
    "period_totals": lambda s, d: R.totals(_plays(s, d).where("year BETWEEN 2012 AND 2016"), BY),
    "period_top_artists": lambda s, d: C.top(_plays(s, d).where("year BETWEEN 2012 AND 2016"), BY, ["artist"], 20),
    "yearly_tops": lambda s, d: R.yearly_tops(_plays(s, d), BY),
    "artist_sparklines": lambda s, d: R.artist_sparklines(_plays(s, d), BY),
    "consistent_artists": lambda s, d: R.consistent_artists(_plays(s, d), BY),
    "peak_obsessions": lambda s, d: R.peak_obsessions(_plays(s, d), BY, 10),
    "year_totals": lambda s, d: R.year_totals(_plays(s, d), BY),
    "year_albums": lambda s, d: R.year_albums(_plays(s, d), BY, 2015),
    "artist_years": lambda s, d: R.artist_years(_plays(s, d), BY, ARTIST),
    "artist_albums": lambda s, d: R.artist_albums(_plays(s, d), BY, ARTIST),
    "loyalty_groups": lambda s, d: R.loyalty_groups(_plays(s, d), BY),
    "echo_score": lambda s, d: R.echo_score(_plays(s, d), BY),
    "calendar_days": lambda s, d: R.calendar_days(_plays(s, d), BY),
    "discovery_lags": lambda s, d: R.lag_buckets(R.first_plays_of_albums(_plays(s, d), BY, _matched(s, d)), BY),
    "release_ages": lambda s, d: R.release_ages(_plays(s, d), BY, _matched(s, d)),
    "artist_streaks": lambda s, d: R.artist_streaks(_plays(s, d), BY),
    "discovery_days": lambda s, d: R.discovery_days(_plays(s, d), BY, ARTIST),
}

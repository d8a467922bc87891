"""Reports on a play log: overviews, an artist in depth, a year, habits, streaks, discovery.

Every report takes the columns that make an owner (``by``) and serves all
owners in one plan.  Lists of names come as one text, joined by bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.functions.text import joined_first
from segno.operators.counts import familiarity, listened_albums, ranked
from segno.operators.sessions import assign_sessions
from segno.plans import with_facts

DAY = 86_400
#: The days of a week and the bounds of lags in years, in the order they are shown.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
LAGS = ((0, "Same year"), (1, "1 year later"), (3, "2-3 years"), (5, "4-5 years"), (10, "6-10 years"))


def _named(plays: DataFrame) -> DataFrame:
    return plays.where("artist <> ''")


def _years(plays: DataFrame, by: list[str]) -> DataFrame:
    return _named(plays).groupBy(*by, "artist", "year").agg(F.count("*").alias("n"))


def last_days(plays: DataFrame, now: int, days: int) -> DataFrame:
    """Plays from midnight UTC ``days`` days before ``now`` (epoch seconds) on."""
    return plays.where(F.col("uts") >= now // DAY * DAY - days * DAY)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit, total order; null keys are keys."""
    columns = rows.columns
    best = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def known_albums(plays: DataFrame, by: list[str], threshold: float | None = None) -> DataFrame:
    """Albums known: at least ``threshold`` familiar, or, without one, five tracks of five plays each."""
    if threshold is None:
        return listened_albums(plays, by).select(*by, "artist", "album")
    return familiarity(plays, by).where(F.col("familiarity") >= threshold).select(*by, "artist", "album")


def top_track_of_albums(plays: DataFrame, by: list[str]) -> DataFrame:
    """(…, artist, album, plays, top_track, top_plays): each album with its most played track, the first by name on ties; null without named tracks."""
    songs = _named(plays).where("album <> ''").groupBy(*by, "artist", "album", "track").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("track").isNotNull(), F.struct((-F.col("n")).alias("k"), "track", "n")))
    return songs.groupBy(*by, "artist", "album").agg(F.sum("n").alias("plays"), best.alias("b")).select(*by, "artist", "album", "plays", F.col("b.track").alias("top_track"), F.col("b.n").alias("top_plays"))


def short_release_artists(plays: DataFrame, by: list[str], releases: DataFrame, ratio: float = 0.5, least: int = 20) -> DataFrame:
    """Artists whose plays are mostly of EPs, singles and broadcasts: plays by kind, the ratio to these and albums, their top release and its top track.

    ``releases`` has artist, album, release_id and release_type of albums
    found; an album without one is of unknown kind.
    """
    kind = F.when(F.coalesce("release_type", F.lit("")) == "", "unknown").when(F.col("release_type") == "album", "album").when(F.col("release_type").isin("ep", "single", "broadcast"), "short").otherwise("other")
    albums = top_track_of_albums(plays, by).join(releases.select("artist", "album", "release_type"), ["artist", "album"], "left").withColumn("kind", kind)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("plays"))), F.lit(0))
    top = F.min(F.when(F.col("kind") == "short", F.struct((-F.col("plays")).alias("k"), "album", "top_track")))
    out = albums.groupBy(*by, "artist").agg(*[of(k).alias(f"{k}_plays") for k in ("album", "short", "unknown", "other")], F.sum("plays").alias("plays"), top.alias("t"))
    share = F.round(F.coalesce(F.try_divide(F.col("short_plays").cast("double"), F.col("short_plays") + F.col("album_plays")), F.lit(0.0)), 3)
    out = out.withColumn("short_ratio", share).where((F.col("short_ratio") >= ratio) & (F.col("plays") >= least) & (F.col("short_plays") > 0))
    return out.select(*by, "artist", "album_plays", "short_plays", "unknown_plays", "other_plays", "plays", "short_ratio", F.col("t.album").alias("top_short"), F.col("t.top_track").alias("top_short_track"))


def one_track_years(plays: DataFrame, by: list[str]) -> DataFrame:
    """(…, artist, track, peak_years): of the track and album most played of an artist, the years in which the track, on any album, has a quarter of those plays."""
    songs = _named(plays).where("track IS NOT NULL").groupBy(*by, "artist", "track", "album").agg(F.count("*").alias("n"))
    best = songs.groupBy(*by, "artist").agg(F.min(F.struct((-F.col("n")).alias("k"), "track", "album", "n")).alias("b")).select(*by, "artist", F.col("b.track").alias("track"), F.col("b.n").alias("n"))
    years = plays.groupBy(*by, "artist", "track", "year").agg(F.count("*").alias("y"))
    met = best.join(years, [*by, "artist", "track"])
    return met.groupBy(*by, "artist", "track").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("y") >= 0.25 * F.col("n"), F.col("year")))).cast("array<string>"), ",").alias("peak_years"))


def temporal(plays: DataFrame, by: list[str], part: str) -> DataFrame:
    """(…, part, plays, pct, peak): plays by hour (those there are), or by all weekdays or months; the peak is the first of the most, weekdays in the order of their names."""
    counted = plays.groupBy(*by, part).agg(F.count("*").alias("plays"))
    if part != "hour":
        spine = F.array(*map(F.lit, WEEKDAYS)) if part == "weekday" else F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))
        owners = counted.select(*by).distinct() if by else plays.sparkSession.range(1).select()
        counted = owners.select(*by, F.explode(spine).alias(part)).join(counted, [*by, part], "left").fillna(0, ["plays"])
    w = Window.partitionBy(*by)
    first = F.row_number().over(w.orderBy(F.desc("plays"), part)) == 1
    return counted.select(*by, part, "plays", F.round(F.try_divide(F.col("plays") * 100.0, F.sum("plays").over(w)), 1).alias("pct"), first.alias("peak"))


def totals(plays: DataFrame, by: list[str]) -> DataFrame:
    """In one row for each owner: plays, artists, years from first to last, plays a year, the year of most plays and its plays."""
    years = plays.groupBy(*by, "year").agg(F.count("*").alias("n"))
    span = F.max("year") - F.min("year") + 1
    out = years.groupBy(*by).agg(F.sum("n").alias("plays"), span.alias("years"), F.min(F.struct((-F.col("n")).alias("k"), "year", "n")).alias("p"))
    artists = _named(plays).select(*by, "artist").distinct().groupBy(*by).agg(F.count("*").alias("artists"))
    joined = with_facts(out, artists, by, "left")
    return joined.select(*by, "plays", F.coalesce("artists", F.lit(0)).alias("artists"), "years", F.round(F.col("plays") / F.col("years"), 2).alias("plays_a_year"), F.col("p.year").alias("peak_year"), F.col("p.n").alias("peak_plays"))


def yearly_tops(plays: DataFrame, by: list[str], found: int = 5, most: int = 10) -> DataFrame:
    """Per year: the artists first heard in it with most of its plays, and the most played ones."""
    rows = _years(plays, by).withColumn("first", F.min("year").over(Window.partitionBy(*by, "artist")))
    w = Window.partitionBy(*by, "year").orderBy(F.desc("n"), "artist")
    new = (F.col("first") == F.col("year")).cast("int")
    rows = rows.withColumns({"k": F.row_number().over(w), "new": new}).withColumn("d", F.when(F.col("new") == 1, F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.groupBy(*by, "year").agg(joined_first(found, "d", F.col("artist")).alias("discoveries"), joined_first(most, "k", F.col("artist")).alias("top_artists"))


def quantised(values: Column, steps: int = 8) -> Column:
    """Each of some counts as a step from 0 to ``steps`` of the greatest."""
    top = F.array_max(values)
    return F.transform(values, lambda v: F.coalesce(F.floor(v / top * steps), F.lit(0)))


def artist_sparklines(plays: DataFrame, by: list[str], limit: int = 25) -> DataFrame:
    """Top artists with first year, years active, plays of every year of the owner's log, and these as steps."""
    years = _years(plays, by)
    best = years.groupBy(*by, "artist").agg(F.sum("n").alias("plays"), F.min("year").alias("first_year"), F.count("*").alias("years_active"))
    best = ranked(best, by, [F.desc("plays"), F.asc("artist")], limit)
    spans = plays.groupBy(*by).agg(F.sequence(F.min("year"), F.max("year")).alias("all"))
    spine = with_facts(best, spans, by).select(*by, "artist", "plays", "first_year", "years_active", "rank", F.explode("all").alias("year"))
    filled = spine.join(years, [*by, "artist", "year"], "left").fillna(0, ["n"])
    line = F.transform(F.sort_array(F.collect_list(F.struct("year", "n"))), lambda r: r["n"])
    out = filled.groupBy(*by, "artist", "plays", "first_year", "years_active", "rank").agg(line.alias("v"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return out.select(*by, "artist", "plays", "rank", "first_year", "years_active", text(F.col("v")).alias("by_year"), text(quantised(F.col("v"))).alias("steps"))


def consistent_artists(plays: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """Artists played in all years of a log but one, or in ``most``."""
    years = _years(plays, by)
    spans = plays.groupBy(*by).agg((F.max("year") - F.min("year") + 1).alias("span"))
    active = years.groupBy(*by, "artist").agg(F.count("*").alias("years_active"), F.sum("n").alias("plays"))
    met = with_facts(active, spans, by)
    return met.where(F.col("years_active") >= F.least(F.lit(most), F.col("span") - 1)).drop("span")


def peak_obsessions(plays: DataFrame, by: list[str], least: int = 50) -> DataFrame:
    """Artists with a year of ``least`` plays: the earliest of the most, its plays and their share of all of the artist's."""
    best = _years(plays, by).groupBy(*by, "artist").agg(F.min(F.struct((-F.col("n")).alias("k"), "year", "n")).alias("p"), F.sum("n").alias("plays"))
    out = best.select(*by, "artist", F.col("p.year").alias("peak_year"), F.col("p.n").alias("peak_plays"), "plays")
    return out.where(F.col("peak_plays") >= least).withColumn("concentration", F.round(F.col("peak_plays") * 100.0 / F.col("plays"), 2))


def year_totals(plays: DataFrame, by: list[str]) -> DataFrame:
    """Per year: plays, artists, albums, and the change of plays against the year before in percent (null without one)."""
    album = F.when(F.col("album") != "", F.struct("artist", "album"))
    out = plays.groupBy(*by, "year").agg(F.count("*").alias("plays"), F.countDistinct(F.when(F.col("artist") != "", F.col("artist"))).alias("artists"), F.countDistinct(album).alias("albums"))
    w = Window.partitionBy(*by).orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("plays").over(w))
    return out.withColumn("plays_before", before).withColumn("change_pct", F.round((F.col("plays") - F.col("plays_before")) * 100.0 / F.col("plays_before"), 2))


def year_albums(plays: DataFrame, by: list[str], year: int, limit: int = 15) -> DataFrame:
    """A year's most played albums, with the year they were first played."""
    rows = _named(plays).where("album <> ''").groupBy(*by, "artist", "album").agg(F.count_if(F.col("year") == year).alias("plays"), F.min("year").alias("first_year"))
    return ranked(rows.where("plays > 0"), by, [F.desc("plays"), F.asc("artist"), F.asc("album")], limit).withColumn("is_new", F.col("first_year") == year)


def artist_years(plays: DataFrame, by: list[str], artist: str) -> DataFrame:
    """One artist's plays by year, whatever the name's case."""
    return plays.where(F.lower("artist") == artist.lower()).groupBy(*by, "year").agg(F.count("*").alias("plays"))


def artist_albums(plays: DataFrame, by: list[str], artist: str, limit: int = 10) -> DataFrame:
    """One artist's most played albums, with how well they are known."""
    mine = plays.where(F.lower("artist") == artist.lower())
    known = familiarity(mine, by).groupBy(*by, "album").agg(F.max("familiarity").alias("familiarity"), F.sum("tracks").alias("tracks"))
    albums = ranked(mine.where("album <> ''").groupBy(*by, "album").agg(F.count("*").alias("plays")), by, [F.desc("plays"), F.asc("album")], limit)
    return albums.join(known, [*by, "album"], "left")


def loyalty_groups(plays: DataFrame, by: list[str], long: int = 5) -> DataFrame:
    """(…, group, artist, plays, years_active, last_year, peak_year, peak_plays, gap): artists of ``long`` years, those found again after three years or more, and those given up.

    Given up is an artist with such a gap, 20 plays, a year of 10, and none in
    the last two years; or one with 30 plays, a year of 15, and none in the
    last three.
    """
    w = Window.partitionBy(*by, "artist").orderBy("year")
    years = _years(plays, by).withColumns({"gap": F.col("year") - F.lag("year").over(w), "now": F.max("year").over(Window.partitionBy(*by))})
    last_gap = F.max(F.when(F.col("gap") >= 3, F.struct("year", "gap")))["gap"]
    out = years.groupBy(*by, "artist").agg(
        F.sum("n").alias("plays"), F.count("*").alias("years_active"), F.max("year").alias("last_year"), F.min(F.struct((-F.col("n")).alias("k"), "year", "n")).alias("p"), last_gap.alias("gap"), F.max("now").alias("now")
    ).withColumns({"peak_year": F.col("p.year"), "peak_plays": F.col("p.n")})
    recent = F.col("last_year") >= F.col("now") - 1
    gone = (F.col("gap").isNotNull() & ~recent & (F.col("plays") >= 20) & (F.col("peak_plays") >= 10)) | ((F.col("plays") >= 30) & (F.col("last_year") <= F.col("now") - 3) & (F.col("peak_plays") >= 15))
    groups = F.array_compact(F.array(F.when(F.col("years_active") >= long, "long_term"), F.when(F.col("gap").isNotNull() & recent, "rediscovered"), F.when(gone, "abandoned")))
    return out.select(*by, F.explode(groups).alias("group"), "artist", "plays", "years_active", "last_year", "peak_year", "peak_plays", "gap")


def echo_score(plays: DataFrame, by: list[str]) -> DataFrame:
    """Per owner and year how few artists fill it: shares of the first 10 and 20, artists per 1,000 plays, artists that make half of it, and a score of these from 0 to 100 with its level."""
    artists = _years(plays, by)
    own = Window.partitionBy(*by, "year")
    order = own.orderBy(F.desc("n"), "artist")
    run = artists.withColumns({"k": F.row_number().over(order), "sum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(own)})
    pct = lambda k: F.sum(F.when(F.col("k") <= k, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")
    out = run.groupBy(*by, "year").agg(pct(10).alias("a"), pct(20).alias("b"), (F.count("*") * 1000.0 / F.sum("n")).alias("c"), (F.count_if(F.col("sum") * 2 <= F.col("total")) + 1).alias("half"))
    low = lambda c: F.greatest(F.lit(0.0), 100 - c)
    score = F.least(F.col("a"), F.lit(100.0)) * 0.35 + F.least(F.col("b"), F.lit(100.0)) * 0.35 + low(F.col("half") * 5) * 0.2 + low(F.col("c") * 2) * 0.1
    level = F.when(score >= 70, "critical").when(score >= 55, "high").when(score >= 40, "moderate").otherwise("low")
    return out.select(*by, "year", F.round("a", 2).alias("top10_pct"), F.round("b", 2).alias("top20_pct"), F.round("c", 2).alias("artists_per_1000"), F.col("half").alias("artists_for_half"), F.round(score, 2).alias("score"), level.alias("level"))


def calendar_days(plays: DataFrame, by: list[str]) -> DataFrame:
    """Per day: plays, the three most played artists, and a level from 0 to 5: how many of the fifths of daily plays (and the most) it reaches."""
    day = F.floor(F.col("uts") / DAY).cast("bigint")
    each = plays.groupBy(*by, day.alias("d"), "artist").agg(F.count("*").alias("n"))
    place = F.when(F.coalesce("artist", F.lit("")) != "", F.row_number().over(Window.partitionBy(*by, "d").orderBy((F.coalesce("artist", F.lit("")) == "").cast("int"), F.desc("n"), "artist")))
    days = each.withColumn("k", place).groupBy(*by, "d").agg(F.sum("n").alias("plays"), joined_first(3, "k", F.col("artist")).alias("top_artists"))
    w = Window.partitionBy(*by)
    cuts = F.expr("percentile(plays, array(0.2D, 0.4D, 0.6D, 0.8D, 1.0D))").over(w)
    level = F.aggregate("cuts", F.lit(0), lambda acc, c: acc + (F.col("plays") >= c).cast("int"))
    return days.withColumn("cuts", cuts).select(*by, F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).cast("string").alias("day_of"), "plays", "top_artists", level.cast("bigint").alias("level"))


def lag_buckets(albums: DataFrame, by: list[str]) -> DataFrame:
    """(…, bucket, albums, pct): albums (first_year, release_year) by how many years after their release they were first played; the share is of all of them."""
    lag = F.col("first_year") - F.col("release_year")
    bucket = F.when(lag < 0, "Before release")
    for most, name in LAGS:
        bucket = bucket.when(lag <= most, name)
    out = albums.where("release_year IS NOT NULL").groupBy(*by, bucket.otherwise("10+ years").alias("bucket")).agg(F.count("*").alias("albums"))
    return out.withColumn("pct", F.round(F.col("albums") * 100.0 / F.sum("albums").over(Window.partitionBy(*by)), 2))


def release_ages(plays: DataFrame, by: list[str], releases: DataFrame) -> DataFrame:
    """Per year of plays whose album has a release year: matched plays, the share released that year, and the share released since ten years before the log's last decade."""
    dated = plays.where("artist <> '' AND album <> ''").join(releases.where("year IS NOT NULL").select("artist", "album", F.col("year").alias("release_year")), ["artist", "album"])
    years = dated.groupBy(*by, "year", "release_year").agg(F.count("*").alias("n"))
    since = (F.floor(F.max("year").over(Window.partitionBy(*by)) / 10) * 10 - 10)
    marked = years.withColumn("modern", F.col("release_year") >= since)
    pct = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 2)
    return marked.groupBy(*by, "year").agg(F.sum("n").alias("plays"), pct(F.col("release_year") == F.col("year")).alias("new_pct"), pct(F.col("modern")).alias("modern_pct"))


def first_plays_of_albums(plays: DataFrame, by: list[str], releases: DataFrame) -> DataFrame:
    """(…, artist, album, first_year, release_year) of albums found."""
    first = plays.where("artist <> '' AND album <> ''").groupBy(*by, "artist", "album").agg(F.min("year").alias("first_year"))
    return first.join(releases.select("artist", "album", F.col("year").alias("release_year")), ["artist", "album"])


def artist_streaks(plays: DataFrame, by: list[str]) -> DataFrame:
    """(…, artist, days, first_day, last_day, active): the longest run of days of each artist, of two days or more, the earliest on ties; active if it reaches the day before the log's last."""
    day = F.floor(F.col("uts") / DAY).cast("bigint")
    days = _named(plays).select(*by, "artist", day.alias("d")).distinct()
    island = F.col("d") - F.row_number().over(Window.partitionBy(*by, "artist").orderBy("d"))
    runs = days.withColumn("i", island).groupBy(*by, "artist", "i").agg(F.count("*").alias("days"), F.min("d").alias("a"), F.max("d").alias("z"))
    best = runs.where("days >= 2").groupBy(*by, "artist").agg(F.min(F.struct((-F.col("days")).alias("k"), "a", "z", "days")).alias("b"))
    last = plays.groupBy(*by).agg(F.max(day).alias("now"))
    met = with_facts(best, last, by)
    text = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int")).cast("string")
    return met.select(*by, "artist", F.col("b.days").alias("days"), text(F.col("b.a")).alias("first_day"), text(F.col("b.z")).alias("last_day"), (F.col("b.z") >= F.col("now") - 1).alias("active"))


def discovery_days(plays: DataFrame, by: list[str], artist: str, most: int = 5) -> DataFrame:
    """How each owner found an artist: first play, plays of its session, and the artists of the day before and the day after, by plays.

    A day is 86,400 seconds before or after the first play; its own moment is
    in neither.  One row an owner is joined with the log.
    """
    mine = plays.where(F.lower("artist") == artist.lower())
    first = mine.groupBy(*by).agg(F.min(F.struct("uts", "play_id", "track", "album")).alias("f")).select(*by, F.col("f.uts").alias("t"), F.col("f.track").alias("first_track"), F.col("f.album").alias("first_album"))
    near = with_facts(plays, first, by)
    side = F.when((F.col("uts") >= F.col("t") - DAY) & (F.col("uts") < F.col("t")), "before").when((F.col("uts") > F.col("t")) & (F.col("uts") <= F.col("t") + DAY), "after")
    around = near.withColumn("side", side).where("side IS NOT NULL AND artist <> ''").where(F.lower("artist") != artist.lower()).groupBy(*by, "side", "artist").agg(F.count("*").alias("n"))
    placed = around.withColumn("k", F.row_number().over(Window.partitionBy(*by, "side").orderBy(F.desc("n"), "artist")))
    text = F.concat_ws(":", "artist", F.col("n").cast("string"))
    sides = placed.groupBy(*by).agg(*[joined_first(most, F.when(F.col("side") == s, F.col("k")), text).alias(f"day_{s}") for s in ("before", "after")])
    session = assign_sessions(plays, by[0], "uts", 1800, "play_id").groupBy(by[0], "session_start").agg(F.count("*").alias("session_plays"), F.max("uts").alias("e"))
    held = first.join(session, (first[by[0]] == session[by[0]]) & (F.col("t") >= F.col("session_start")) & (F.col("t") <= F.col("e"))).select(first[by[0]], "t", "first_track", "first_album", "session_plays")
    return held.join(sides, by, "left").select(*by, F.col("t").alias("first_uts"), "first_track", "first_album", "session_plays", F.coalesce("day_before", F.lit("")).alias("day_before"), F.coalesce("day_after", F.lit("")).alias("day_after"))

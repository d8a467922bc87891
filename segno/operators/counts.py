"""Counts, first and last plays, and yearly habits of a play log.

Every operator takes the columns that make an owner of plays (``by``, for one
listener's log an empty list) and works on all owners in one plan.  Rankings
break ties by name, so that they are the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _n() -> Column:
    return F.count(F.lit(1))


def ranked(df: DataFrame, by: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each owner in a total order; without owners every task sends its own first rows only."""
    df = df if by else df.orderBy(*order).limit(limit)
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return out.where(F.col(rank) <= limit)


def top(plays: DataFrame, by: list[str], what: list[str], limit: int) -> DataFrame:
    """Most played artists, albums or tracks; null or empty names have no rank."""
    named = plays
    for c in what:
        named = named.where(F.coalesce(F.col(c), F.lit("")) != "")
    counted = named.groupBy(*by, *what).agg(_n().alias("plays"))
    return ranked(counted, by, [F.desc("plays"), *map(F.asc, what)], limit)


def distinct_counts(plays: DataFrame, by: list[str]) -> DataFrame:
    """Plays, distinct artists, albums and tracks, first and last time, years."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    # one expansion per distinct is what a single aggregate would do; grouped sets first keep each small
    return plays.groupBy(*by).agg(
        _n().alias("plays"), F.countDistinct(filled("artist")).alias("artists"), F.countDistinct(F.when(F.col("album") != "", F.struct("artist", "album"))).alias("albums"),
        F.countDistinct(F.when(F.col("track") != "", F.struct("artist", "track"))).alias("tracks"), F.min("uts").alias("first_uts"), F.max("uts").alias("last_uts"), F.countDistinct("year").alias("years"),
    )


def first_last(plays: DataFrame, by: list[str]) -> DataFrame:
    """Per artist the first and the last play and what was played then."""
    at = F.struct("uts", "play_id")
    named = plays.where("artist <> ''")
    return named.groupBy(*by, "artist").agg(
        _n().alias("plays"), F.min("uts").alias("first_uts"), F.min_by("track", F.when(F.col("track").isNotNull(), at)).alias("first_track"), F.max("uts").alias("last_uts"), F.max_by("track", F.when(F.col("track").isNotNull(), at)).alias("last_track"),
    )


def spans(plays: DataFrame, by: list[str]) -> DataFrame:
    """Per artist first and last year, years active, all plays."""
    return plays.where("artist <> ''").groupBy(*by, "artist").agg(_n().alias("plays"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("years_active"))


def discovered(plays: DataFrame, by: list[str], year: int) -> DataFrame:
    """Artists first played in a year, with that year's plays."""
    named = plays.where("artist <> ''")
    return named.groupBy(*by, "artist").agg(F.min("year").alias("first_year"), F.count_if(F.col("year") == year).alias("plays")).where(F.col("first_year") == year).drop("first_year")


def abandoned(plays: DataFrame, by: list[str], year: int) -> DataFrame:
    """Artists last played in a year, with all plays and that year's."""
    named = plays.where("artist <> ''")
    return named.groupBy(*by, "artist").agg(F.max("year").alias("last_year"), _n().alias("plays"), F.count_if(F.col("year") == year).alias("plays_in_year")).where(F.col("last_year") == year).drop("last_year")


def new_between(plays: DataFrame, by: list[str], low: int, high: int) -> DataFrame:
    """Artists whose first play lies within bounds, both included."""
    return plays.where("artist <> ''").groupBy(*by, "artist").agg(F.min("uts").alias("first_uts"), _n().alias("plays")).where(F.col("first_uts").between(low, high))


def listened_albums(plays: DataFrame, by: list[str], tracks: int = 5, each: int = 5) -> DataFrame:
    """Albums with at least ``tracks`` tracks of at least ``each`` plays."""
    songs = plays.where("artist <> '' AND album <> '' AND track IS NOT NULL").groupBy(*by, "artist", "album", "track").agg(_n().alias("n")).where(F.col("n") >= each)
    return songs.groupBy(*by, "artist", "album").agg(_n().alias("tracks"), F.sum("n").alias("plays")).where(F.col("tracks") >= tracks)


def familiarity(plays: DataFrame, by: list[str]) -> DataFrame:
    """How well an album is known: 0.4 coverage + 0.4 depth + 0.2 dispersion.

    Coverage is tracks/10, depth plays per track/10, both up to 1; dispersion
    the entropy of plays over tracks as a share of the most possible, 1 for
    one track.
    """
    songs = plays.where("artist <> '' AND album <> '' AND track IS NOT NULL").groupBy(*by, "artist", "album", "track").agg(_n().alias("n"))
    # the entropy needs the album's total: a window over the grouped tracks, partitioned as the next step groups
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "artist", "album"))
    albums = songs.withColumn("h", -p * F.log2(p + F.lit(1e-10))).groupBy(*by, "artist", "album").agg(_n().alias("tracks"), F.sum("n").alias("plays"), F.sum("h").alias("entropy"))
    coverage, depth = F.least(F.col("tracks") / 10, F.lit(1.0)), F.least(F.col("plays") / F.col("tracks") / 10, F.lit(1.0))
    dispersion = F.when(F.col("tracks") == 1, 1.0).otherwise(F.col("entropy") / F.log2("tracks"))
    return albums.select(*by, "artist", "album", "tracks", "plays", coverage.alias("coverage"), depth.alias("depth"), dispersion.alias("dispersion"), F.round(0.4 * coverage + 0.4 * depth + 0.2 * dispersion, 4).alias("familiarity"))


def obsessions(plays: DataFrame, by: list[str], least: int = 8, known_below: float = 0.4, few: int = 3, dominance: float = 0.5) -> DataFrame:
    """Tracks played again and again from albums hardly known otherwise, with the years of at least a quarter of their plays."""
    songs = plays.where("artist <> '' AND album <> '' AND track IS NOT NULL").groupBy(*by, "artist", "album", "track", "year").agg(_n().alias("y"))
    total = Window.partitionBy(*by, "artist", "album", "track")
    tracks = songs.withColumn("n", F.sum("y").over(total)).groupBy(*by, "artist", "album", "track").agg(F.max("n").alias("plays"), F.array_sort(F.collect_list(F.when(F.col("y") >= 0.25 * F.col("n"), F.col("year")))).alias("peak_years"))
    known = familiarity(plays, by).select(*by, "artist", "album", F.col("tracks").alias("album_tracks"), F.col("plays").alias("album_plays"), "familiarity")
    joined = tracks.join(known, [*by, "artist", "album"]).withColumn("share_pct", F.round(F.col("plays") * 100.0 / F.col("album_plays"), 1))
    kept = joined.where((F.col("plays") >= least) & ((F.col("familiarity") < known_below) | ((F.col("album_tracks") <= few) & (F.col("share_pct") >= dominance * 100))))
    return kept.withColumn("peak_years", F.array_join(F.col("peak_years").cast("array<string>"), ","))


def one_track_artists(plays: DataFrame, by: list[str], share: float = 0.7, others: int = 3, least: int = 10) -> DataFrame:
    """Artists of whom one track makes most plays."""
    songs = plays.where("artist <> '' AND track IS NOT NULL").groupBy(*by, "artist", "track", "album").agg(_n().alias("n"))
    w = Window.partitionBy(*by, "artist")
    out = songs.withColumns({"plays": F.sum("n").over(w), "others": F.count("*").over(w) - 1, "k": F.row_number().over(w.orderBy(F.desc("n"), "track", "album"))}).where("k = 1")
    out = out.withColumn("concentration", F.round(F.col("n") / F.col("plays"), 3))
    return out.where((F.col("concentration") >= share) & (F.col("others") <= others) & (F.col("n") >= least)).select(*by, "artist", "track", "album", F.col("n").alias("top_plays"), "plays", "others", "concentration")


def per_hour(plays: DataFrame, by: list[str], part: str) -> DataFrame:
    """Plays by hour, weekday or month and their share in percent."""
    counted = plays.groupBy(*by, part).agg(_n().alias("plays"))
    return counted.withColumn("pct", F.round(F.col("plays") * 100.0 / F.sum("plays").over(Window.partitionBy(*by)), 1))


def yearly(plays: DataFrame, by: list[str]) -> DataFrame:
    """Per year: plays, artists, artists discovered and abandoned, share of the first three and ten artists; one pass over artist-years."""
    years = plays.where("artist <> ''").groupBy(*by, "artist", "year").agg(_n().alias("n"))
    w = Window.partitionBy(*by, "artist")
    order = Window.partitionBy(*by, "year").orderBy(F.desc("n"), "artist")
    marked = years.withColumns({"first": F.min("year").over(w), "last": F.max("year").over(w), "k": F.row_number().over(order)})
    part = lambda k: F.round(F.sum(F.when(F.col("k") <= k, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 2)
    return marked.groupBy(*by, "year").agg(
        F.sum("n").alias("plays"), _n().alias("artists"), F.count_if(F.col("first") == F.col("year")).alias("discovered"), F.count_if(F.col("last") == F.col("year")).alias("abandoned"),
        part(3).alias("top3_pct"), part(10).alias("top10_pct"), F.max(F.when(F.col("k") == 1, F.col("artist"))).alias("top_artist"),
    )


def loyalty(plays: DataFrame, by: list[str]) -> DataFrame:
    """Artists heard in many years, with the longest gap between active years, and whether they were rediscovered."""
    years = plays.where("artist <> ''").groupBy(*by, "artist", "year").agg(_n().alias("n"))
    gap = F.col("year") - F.lag("year").over(Window.partitionBy(*by, "artist").orderBy("year"))
    newest = Window.partitionBy(*by)
    out = years.withColumns({"gap": gap, "now": F.max("year").over(newest)}).groupBy(*by, "artist").agg(_n().alias("years_active"), F.sum("n").alias("plays"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max("gap").alias("longest_gap"), F.max("now").alias("now"))
    return out.select(*by, "artist", "years_active", "plays", "first_year", "last_year", F.coalesce("longest_gap", F.lit(0)).cast("bigint").alias("longest_gap"), (F.coalesce(F.col("longest_gap") >= 3, F.lit(False)) & (F.col("last_year") >= F.col("now") - 1)).alias("rediscovered"), (F.col("years_active") >= 5).alias("loyal"))


def funnel(plays: DataFrame, by: list[str]) -> DataFrame:
    """Per year artists of at least 1, 5, 50 and 200 plays, and what share goes on from step to step."""
    years = plays.where("artist <> ''").groupBy(*by, "artist", "year").agg(_n().alias("n")).groupBy(*by, "year")
    steps = {f"at_{k}": F.count_if(F.col("n") >= k) for k in (1, 5, 50, 200)}
    out = years.agg(*[v.alias(k) for k, v in steps.items()])
    rate = lambda a, b: F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 2)
    return out.withColumns({"to_5": rate("at_5", "at_1"), "to_50": rate("at_50", "at_5"), "to_200": rate("at_200", "at_50")})


def echo_chamber(plays: DataFrame, by: list[str]) -> DataFrame:
    """How few artists fill a log: shares of the first 10 and 20, artists per 1,000 plays, artists that make half of it."""
    artists = plays.where("artist <> ''").groupBy(*by, "artist").agg(_n().alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "artist")
    run = artists.withColumns({"k": F.row_number().over(order), "sum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*by))})
    pct = lambda k: F.round(F.sum(F.when(F.col("k") <= k, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 2)
    return run.groupBy(*by).agg(pct(10).alias("top10_pct"), pct(20).alias("top20_pct"), F.round(_n() * 1000.0 / F.sum("n"), 2).alias("artists_per_1000"), (F.count_if(F.col("sum") * 2 <= F.col("total")) + 1).alias("artists_for_half"))


def streaks(plays: DataFrame, by: list[str]) -> DataFrame:
    """Runs of consecutive days with plays: first and last day and days."""
    days = plays.select(*by, F.to_date("ts").alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(*by).orderBy("d")))
    runs = days.withColumn("island", island).groupBy(*by, "island").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), _n().alias("days"))
    return runs.where("days >= 2").select(*by, F.col("first_day").cast("string"), F.col("last_day").cast("string"), "days")


def rank_margins(plays: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Top artists with the lead over the next in percent, and a band: ~ under 5, + under 15."""
    ranks = top(plays, by, ["artist"], limit + 1)
    after = F.lead("plays").over(Window.partitionBy(*by).orderBy("rank"))
    lead = F.round((F.col("plays") - F.col("next")) * 100.0 / F.col("plays"), 2)
    out = ranks.withColumn("next", after).where(F.col("rank") <= limit).withColumn("margin_pct", lead)
    return out.select(*by, "artist", "plays", "rank", "margin_pct", F.when(F.col("margin_pct") < 5, "~").when(F.col("margin_pct") < 15, "+").otherwise("").alias("band"))


def daily(plays: DataFrame, by: list[str]) -> DataFrame:
    """Plays of each day, and a level from 0 to 4 by the fifths of daily plays."""
    days = plays.groupBy(*by, F.to_date("ts").cast("string").alias("day_of")).agg(_n().alias("plays"))
    w = Window.partitionBy(*by)
    cut = F.expr("percentile(plays, array(0.2D, 0.4D, 0.6D, 0.8D))").over(w)
    level = F.aggregate(F.col("cut"), F.lit(0), lambda acc, c: acc + (F.col("plays") > c).cast("int"))
    return days.withColumn("cut", cut).select(*by, "day_of", "plays", level.cast("bigint").alias("level"))


def peaks(plays: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Top artists with their peak year (the earliest of the most), its plays, and years active."""
    years = plays.where("artist <> ''").groupBy(*by, "artist", "year").agg(_n().alias("n"))
    artists = years.groupBy(*by, "artist").agg(F.sum("n").alias("plays"), _n().alias("years_active"), F.max("n").alias("peak_plays"), F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.min("year").alias("first_year"))
    return ranked(artists, by, [F.desc("plays"), F.asc("artist")], limit)


def core_years(plays: DataFrame, by: list[str], share: float = 0.7) -> DataFrame:
    """The fewest years, by falling plays, that make up a share of an artist's plays."""
    years = plays.where("artist <> ''").groupBy(*by, "artist", "year").agg(_n().alias("n"))
    order = Window.partitionBy(*by, "artist").orderBy(F.desc("n"), "year")
    run = years.withColumns({"sum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*by, "artist"))})
    return run.where((F.col("sum") - F.col("n")) < share * F.col("total")).groupBy(*by, "artist").agg(_n().alias("core_years"), F.min("year").alias("from_year"), F.max("year").alias("to_year"))


def artist_profile(plays: DataFrame, by: list[str], artist: str) -> DataFrame:
    """One artist, whatever its case: plays, first and last time, years active from first to last, peak year, albums and tracks."""
    mine = plays.where(F.lower("artist") == artist.lower())
    years = mine.groupBy(*by, "year").agg(_n().alias("n")).groupBy(*by).agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.max("n").alias("peak_plays"))
    base = mine.groupBy(*by).agg(_n().alias("plays"), F.min("uts").alias("first_uts"), F.max("uts").alias("last_uts"), (F.max("year") - F.min("year") + 1).alias("years_active"), F.countDistinct(F.when(F.col("album") != "", F.col("album"))).alias("albums"), F.countDistinct("track").alias("tracks"))
    return base.join(years, by) if by else base.withColumn("_o", F.lit(1)).join(years.withColumn("_o", F.lit(1)), "_o").drop("_o")


def year_review(plays: DataFrame, by: list[str], year: int, limit: int = 15) -> DataFrame:
    """A year's first artists with the plays of the year before, the year they were found, and whether it is their peak."""
    years = plays.where("artist <> ''").groupBy(*by, "artist", "year").agg(_n().alias("n"))
    wide = years.groupBy(*by, "artist").agg(F.max(F.when(F.col("year") == year, F.col("n"))).alias("plays"), F.coalesce(F.max(F.when(F.col("year") == year - 1, F.col("n"))), F.lit(0)).alias("plays_before"), F.min("year").alias("first_year"), F.max("n").alias("most"))
    out = ranked(wide.where("plays IS NOT NULL"), by, [F.desc("plays"), F.asc("artist")], limit)
    return out.select(*by, "artist", "rank", "plays", "plays_before", "first_year", (F.col("first_year") == year).alias("is_new"), (F.col("plays") == F.col("most")).alias("is_peak"))


def period_summary(plays: DataFrame, by: list[str], low: int, high: int) -> DataFrame:
    """Per year of a span: plays, artists, and artists never heard before, over the whole log."""
    years = plays.where("artist <> ''").groupBy(*by, "artist", "year").agg(_n().alias("n"))
    first = years.withColumn("first", F.min("year").over(Window.partitionBy(*by, "artist"))).where(F.col("year").between(low, high))
    return first.groupBy(*by, "year").agg(F.sum("n").alias("plays"), _n().alias("artists"), F.count_if(F.col("first") == F.col("year")).alias("discovered"))


def containing(plays: DataFrame, by: list[str], text: str) -> DataFrame:
    """Artists whose name holds a text, whatever its case, or is held by it, with plays."""
    name, want = F.lower("artist"), F.lit(text.lower())
    return plays.where("artist <> ''").where(name.contains(want) | want.contains(name)).groupBy(*by, "artist").agg(_n().alias("plays"))


def rollup_plays(plays: DataFrame, by: list[str]) -> DataFrame:
    """Plays by year and month with subtotals: null stands for all."""
    return plays.rollup(*by, "year", "month").agg(_n().alias("plays"))

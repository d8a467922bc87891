"""Ranked lists of critics against what was played, and album metadata."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.functions.similarity import ratio_col
from segno.functions.text import joined_first, match_key, stripped
from segno.plans import durable, small_or_shuffled, with_facts


def keyed(df: DataFrame, artist: str = "artist", title: str = "title") -> DataFrame:
    """With ``a_key`` and ``t_key``; rows with an empty key are left out."""
    return df.withColumns({"a_key": match_key(F.col(artist)), "t_key": match_key(F.col(title))}).where("a_key <> '' AND t_key <> ''")


def heard(plays: DataFrame) -> DataFrame:
    """(a_key, t_key, plays, first_uts) of played albums; plays are counted by spelling before names are keyed."""
    spelt = plays.where("artist IS NOT NULL AND album <> ''").groupBy("artist", "album").agg(F.count("*").alias("n"), F.min("uts").alias("u"))
    return keyed(spelt, "artist", "album").groupBy("a_key", "t_key").agg(F.sum("n").alias("plays"), F.min("u").alias("first_uts"))


def consolidated(picks: DataFrame) -> DataFrame:
    """Albums over all lists: critics, listings, mean rank, first and last year."""
    return keyed(picks).groupBy("a_key", "t_key").agg(F.countDistinct("critic").alias("critics"), F.count("*").alias("listings"), F.round(F.avg("rank"), 4).alias("mean_rank"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def spellings(picks: DataFrame) -> DataFrame:
    """(a_key, t_key, artist, title, critics): each listed album in its most common spelling, the first seen (by list, then place) on ties."""
    each = keyed(picks).groupBy("a_key", "t_key", "artist", "title").agg(F.count("*").alias("n"), F.min(F.struct("list_id", "place")).alias("first"))
    best = each.groupBy("a_key", "t_key").agg(F.min(F.struct((-F.col("n")).alias("k"), "first", "artist", "title")).alias("b"))
    critics = keyed(picks).groupBy("a_key", "t_key").agg(F.countDistinct("critic").alias("critics"))
    return best.join(critics, ["a_key", "t_key"]).select("a_key", "t_key", F.col("b.artist").alias("artist"), F.col("b.title").alias("title"), "critics")


def blind_spots(picks: DataFrame, plays: DataFrame, least: int) -> DataFrame:
    """(a_key, t_key, critics, years): albums that nobody played, by each year's critics added up over the years (a list without a year makes one of its own)."""
    years = keyed(picks).groupBy("a_key", "t_key", "year").agg(F.countDistinct("critic").alias("n"))
    albums = years.groupBy("a_key", "t_key").agg(F.sum("n").alias("critics"), F.count("year").alias("years")).where(F.col("critics") >= least)
    return albums.join(heard(plays), ["a_key", "t_key"], "left_anti")


def validated(picks: DataFrame, plays: DataFrame, least: int) -> DataFrame:
    """Albums of many critics that were played, and whether in a year before that of the first list."""
    both = consolidated(picks).where(F.col("critics") >= least).join(heard(plays), ["a_key", "t_key"])
    return both.withColumn("before_critics", F.year(F.timestamp_seconds("first_uts")) < F.col("first_year"))


def validated_insights(picks: DataFrame, plays: DataFrame, least: int) -> DataFrame:
    """In one row: validated albums, their mean listings, the year of most of them and the artist of most, the first on ties."""
    albums = durable(validated(picks, plays, least))
    base = albums.agg(F.count("*").alias("albums"), F.round(F.avg("listings"), 1).alias("mean_listings"))
    artist = albums.groupBy("a_key").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), "a_key"))["a_key"].alias("top_artist"))
    years = keyed(picks).where("year IS NOT NULL").select("a_key", "t_key", "year").distinct().join(albums.select("a_key", "t_key"), ["a_key", "t_key"], "left_semi")
    year = years.groupBy("year").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), "year"))["year"].alias("top_year"))
    return with_facts(with_facts(base, artist), year)


def in_years(picks: DataFrame, low: int, high: int) -> DataFrame:
    """Picks of lists of a span of years; critics without a pick in it are gone with their picks."""
    return picks.where(F.col("year").between(low, high))


def alignment(picks: DataFrame, plays: DataFrame) -> DataFrame:
    """Per critic: picks, heard picks, and their share."""
    mine = heard(plays).select("a_key", "t_key", F.lit(1).alias("h"))
    met = keyed(picks).where("critic IS NOT NULL").join(mine, ["a_key", "t_key"], "left")
    return met.groupBy("critic").agg(F.count("*").alias("picks"), F.count("h").alias("heard"), F.round(F.count("h") / F.count("*"), 3).alias("alignment"))


def recommended(picks: DataFrame, plays: DataFrame, limit: int) -> DataFrame:
    """Unheard albums by the summed alignment of the critics who list them."""
    met = keyed(picks).where("critic IS NOT NULL").join(heard(plays).select("a_key", "t_key", F.lit(1).alias("h")), ["a_key", "t_key"], "left")
    # a critic's alignment from the same join that tells heard from new
    weighed = met.withColumn("alignment", F.round(F.count("h").over(Window.partitionBy("critic")) / F.count("*").over(Window.partitionBy("critic")), 3))
    new = weighed.where("h IS NULL")
    scored = new.groupBy("a_key", "t_key").agg(F.round(F.sum("alignment"), 6).alias("score"), F.countDistinct("critic").alias("critics"))
    return scored.orderBy(F.desc("score"), F.desc("critics"), "a_key", "t_key").limit(limit)


def overlap(picks: DataFrame, plays: DataFrame) -> DataFrame:
    """Per critic the shared albums over the smaller of the two sets; 0 where nothing was heard."""
    mine = durable(heard(plays).select("a_key", "t_key", F.lit(1).alias("h")))
    sets = keyed(picks).where("critic IS NOT NULL").select("critic", "a_key", "t_key").distinct()
    total = mine.count()
    out = sets.join(mine, ["a_key", "t_key"], "left").groupBy("critic").agg(F.count("h").alias("shared"), F.count("*").alias("albums"))
    return out.withColumn("overlap", F.round(F.coalesce(F.try_divide(F.col("shared").cast("double"), F.least(F.col("albums"), F.lit(total))), F.lit(0.0)), 6))


def accuracy(picks: DataFrame, plays: DataFrame, year: int) -> DataFrame:
    """Per critic of a year: picks, and how many were played after that year at all and ten times."""
    later = heard(plays.where(F.col("year") > year)).select("a_key", "t_key", F.col("plays").alias("n"))
    met = keyed(picks.where((F.col("year") == year) & F.col("critic").isNotNull())).select("critic", "a_key", "t_key").distinct().join(later, ["a_key", "t_key"], "left")
    return met.groupBy("critic").agg(F.count("*").alias("picks"), F.count("n").alias("played"), F.count_if(F.col("n") >= 10).alias("played_10"))


def tracker(picks: DataFrame, plays: DataFrame, reference: int, target: int, least: int) -> DataFrame:
    """Unheard albums of a year, by how many albums of a year before their critics share with the log."""
    mine = heard(plays).select("a_key", "t_key")
    shared = keyed(picks.where(F.col("year") == reference)).select("critic", "a_key", "t_key").distinct().join(mine, ["a_key", "t_key"], "left_semi").groupBy("critic").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    new = keyed(picks.where(F.col("year") == target)).select("critic", "a_key", "t_key").distinct().join(mine, ["a_key", "t_key"], "left_anti")
    return new.join(shared, "critic").groupBy("a_key", "t_key").agg(F.sum("shared").alias("score"), F.count("*").alias("critics"))


def review(picks: DataFrame) -> DataFrame:
    """Artists of the lists: listings, albums, critics, mean rank."""
    return keyed(picks).groupBy("a_key").agg(F.count("*").alias("listings"), F.countDistinct("t_key").alias("albums"), F.countDistinct("critic").alias("critics"), F.round(F.avg("rank"), 4).alias("mean_rank"))


def lists_summary(picks: DataFrame) -> DataFrame:
    return picks.groupBy("critic", "publication", "year").agg(F.countDistinct("list_id").alias("lists"), F.count("*").alias("albums"))


def release_lookup(albums: DataFrame, releases: DataFrame) -> DataFrame:
    """(artist, album, release_id): the release of a played album: equal lower-case names first, else an equal title whose credit holds the artist; the smallest id on ties."""
    named = albums.withColumns({"artist_norm": F.lower(stripped(F.col("artist"))), "title_norm": F.lower(stripped(F.col("album")))}).where("artist_norm <> '' AND title_norm <> ''")
    rows = releases.select(F.col("id").alias("release_id"), "artist_norm", "title_norm")
    exact = named.join(rows.groupBy("artist_norm", "title_norm").agg(F.min("release_id").alias("release_id")), ["artist_norm", "title_norm"], "left")
    rest = exact.where("release_id IS NULL").drop("release_id")
    loose = rest.join(rows.withColumnRenamed("artist_norm", "credit"), "title_norm").where(F.col("credit").contains(F.col("artist_norm"))).groupBy("artist", "album").agg(F.min("release_id").alias("release_id"))
    return exact.where("release_id IS NOT NULL").select("artist", "album", "release_id").unionByName(loose)


def played_releases(plays: DataFrame, releases: DataFrame) -> DataFrame:
    """(artist, album, plays, release_id, year, …) of played albums that have a release."""
    albums = plays.where("artist <> '' AND album <> ''").groupBy("artist", "album").agg(F.count("*").alias("plays"))
    found = release_lookup(albums.select("artist", "album"), releases)
    return albums.join(found, ["artist", "album"]).join(releases.select(F.col("id").alias("release_id"), F.col("year").cast("bigint").alias("year"), "release_type", "country"), "release_id")


def by_attribute(matched: DataFrame, column: str) -> DataFrame:
    """Plays and albums by an attribute of the release, with the share of all matched plays."""
    total = matched.agg(F.sum("plays")).first()[0] or 0
    out = matched.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.sum("plays").alias("plays"), F.count("*").alias("albums"))
    return out.withColumn("pct", F.round(F.col("plays") * 100.0 / F.lit(total), 2))


def by_genre(matched: DataFrame, genres: DataFrame, most: int = 5) -> DataFrame:
    """Plays by genre, of each release's first ``most`` genres by count."""
    first = genres.withColumn("k", F.row_number().over(Window.partitionBy("release_id").orderBy(F.desc("count"), "genre"))).where(F.col("k") <= most).select("release_id", "genre")
    return _share_of_matched(matched, matched.join(first, "release_id").groupBy("genre").agg(F.sum("plays").alias("plays"), F.count("*").alias("albums")))


def _share_of_matched(matched: DataFrame, out: DataFrame) -> DataFrame:
    """With ``pct``, the share of the plays of all matched albums: those of several genres count for each, so shares add up to more."""
    total = matched.agg(F.sum("plays")).first()[0] or 0
    return out.withColumn("pct", F.round(F.col("plays") * 100.0 / F.lit(total), 2))


def by_label(matched: DataFrame, labels: DataFrame, most: int = 3) -> DataFrame:
    """Plays by label, of each release's first ``most`` labels by name."""
    named = labels.where(F.coalesce("label_name", F.lit("")) != "").select("release_id", "label_name").distinct()
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("release_id").orderBy("label_name"))).where(F.col("k") <= most).select("release_id", "label_name")
    return _share_of_matched(matched, matched.join(first, "release_id").groupBy("label_name").agg(F.sum("plays").alias("plays"), F.count("*").alias("albums")))


def catalog(matched: DataFrame) -> DataFrame:
    """Plays by the decade of release."""
    return matched.where("year IS NOT NULL").groupBy((F.floor(F.col("year") / 10) * 10).cast("bigint").alias("decade")).agg(F.sum("plays").alias("plays"), F.count("*").alias("albums"), F.countDistinct("artist").alias("artists"))


def release_mix(matched: DataFrame) -> DataFrame:
    """Per artist the plays of albums and of shorter releases, and the latter's share of both."""
    kind = F.when(F.col("release_type") == "album", "album").when(F.col("release_type").isin("ep", "single", "broadcast"), "short").when(F.coalesce("release_type", F.lit("")) == "", "unknown").otherwise("other")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("plays"))), F.lit(0))
    out = matched.withColumn("kind", kind).groupBy("artist").agg(*[of(k).alias(f"{k}_plays") for k in ("album", "short", "unknown", "other")])
    return out.withColumn("short_ratio", F.round(F.try_divide(F.col("short_plays").cast("double"), F.col("short_plays") + F.col("album_plays")), 3))


def bigrams(key: str) -> list[str]:
    """The pairs of neighbouring letters of a padded key, each with the number of its occurrence, so that a list is a set."""
    padded, seen, out = f"#{key}#", Counter(), []
    for i in range(len(padded) - 1):
        g = padded[i : i + 2]
        seen[g] += 1
        out.append(f"{g}{seen[g]}")
    return out


def rarest_bigrams(names: DataFrame, column: str, least: float) -> DataFrame:
    """(column, prefix): of each name the rarest bigrams, as many that two names alike to ``least`` share one of them at least.

    For names of n and m letters alike to r = least / 100, letters dropped and
    added are at most (1 - r)(n + m); a dropped one takes two bigrams of a
    name, an added one one.  So at most c * n are lost, with the shortest m,
    n * r / (2 - r); of one order of all bigrams both names' first c * n + 1
    meet.
    """
    r = least / 100
    if r <= 2 / 3:
        raise ValueError("names less alike than two thirds need not share any pair of letters")
    lost = ((4 - 3 * r) + (2 - 3 * r) * r / (2 - r)) / 2

    @F.pandas_udf("array<string>")
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(bigrams)

    each = names.select(column).distinct()
    rows = each.select(column, F.explode(pieces(F.col(column))).alias("_g"))
    often = small_or_shuffled(durable(rows.groupBy("_g").agg(F.count("*").alias("_n"))))
    place = F.row_number().over(Window.partitionBy(column).orderBy("_n", "_g"))
    first = rows.join(often, "_g").withColumn("_k", place).where(F.col("_k") <= F.floor(F.length(column) * lost + 1e-9) + 1)
    return first.groupBy(column).agg(F.collect_list("_g").alias("prefix"))


def slips(n: int, m: int, least: float) -> int:
    """Letters that two names of ``n`` and ``m`` letters may differ by, dropped and added ones, to be alike to ``least``; -1 if their lengths alone tell them apart."""
    most = math.floor((1 - least / 100) * (n + m) + 1e-9)
    most -= (most - n - m) % 2
    return most if most >= abs(n - m) else -1


def _lengths(n: int, least: float) -> list[int]:
    r = least / 100
    return [m for m in range(max(1, math.floor(n * r / (2 - r))), math.ceil(n * (2 - r) / r) + 1) if slips(n, m, least) >= 0]


def _parts(n: int, parts: int) -> list[tuple[int, int]]:
    ends = [n * k // parts for k in range(parts + 1)]
    return list(zip(ends, ends[1:], strict=False))


def own_parts(name: str, least: float) -> list[str]:
    """The parts of a name, for each length of another: one more than letters may be dropped and added, so that one stays whole."""
    n = len(name)
    return [f"{n},{m},{a},{name[a:b]}" for m in _lengths(n, least) for a, b in _parts(n, slips(n, m, least) + 1)]


def parts_of_others(name: str, least: float) -> list[str]:
    """What ``own_parts`` of a name of any length may read if it is alike to this one: a part is moved only as far as letters before and after it leave slips for."""
    m, out = len(name), set()
    for n in _lengths(m, least):
        t = slips(n, m, least)
        for a, b in _parts(n, t + 1):
            for moved in range(-((t - m + n) // 2), (t + m - n) // 2 + 1):
                if 0 <= a + moved and b + moved <= m:
                    out.add(f"{n},{m},{a},{name[a + moved : b + moved]}")
    return sorted(out)


def alike_names(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(x, y, alike): each of the names in the one column of ``asked`` with those of ``known`` that are alike to ``least``; exact."""

    def keys(df: DataFrame, fn, to: str) -> DataFrame:
        cut = F.pandas_udf(lambda s: s.map(lambda name: fn(name, least)), "array<string>")
        names = df.select(F.col(df.columns[0]).alias(to)).distinct()
        return names.select(to, F.explode(cut(to)).alias("_part")).select(to, F.xxhash64("_part").alias("_part"))

    # what parts there are is not known before they are cut: neither side may be broadcast
    met = keys(asked, own_parts, "x").hint("merge").join(keys(known, parts_of_others, "y"), "_part").where(_within("x", "y", least)).select("x", "y").distinct()
    return met.withColumn("alike", ratio_col(F.col("x"), F.col("y"))).where(F.col("alike") >= least)


def _within(x: str, y: str, least: float) -> Column:
    """What holds for names alike to ``least``: a letter exchanged costs one here and two there."""
    both = F.length(x) + F.length(y)
    return (F.least(F.length(x), F.length(y)) * 200 >= least * both) & (F.levenshtein(x, y) <= F.floor(both * (1 - least / 100) + 1e-9))


def fuzzy_match(wanted: DataFrame, known: DataFrame, least: float = 85.0) -> DataFrame:
    """(a_key, t_key, known_a, known_t, score): for each wanted album the best known one of equal key, else with both names alike to ``least``.

    Alike means twice the common subsequence over all letters, in percent; the
    score weighs the title 0.7 and the artist 0.3, ties go by name.  Exact:
    artists that are alike share a part at nearly one place (``own_parts``);
    then only titles of such artists are compared.  Null and empty keys are
    matched with nothing.
    """
    filled = lambda df, a, t: df.where(f"{a} <> '' AND {t} <> ''")
    ask = filled(wanted.select("a_key", "t_key").distinct(), "a_key", "t_key")
    have = filled(known.select(F.col("a_key").alias("known_a"), F.col("t_key").alias("known_t")).distinct(), "known_a", "known_t")
    ask, have = durable(ask), durable(have)
    exact = ask.join(have, (F.col("a_key") == F.col("known_a")) & (F.col("t_key") == F.col("known_t"))).withColumn("score", F.lit(100.0))
    rest = durable(ask.join(have.select(F.col("known_a").alias("a_key"), F.col("known_t").alias("t_key")), ["a_key", "t_key"], "left_anti"))
    artists = durable(alike_names(rest.select("a_key"), have.select("known_a"), least).withColumnsRenamed({"x": "a_key", "y": "known_a", "alike": "sa"}))
    pairs = rest.join(artists, "a_key").join(have, "known_a").where(_within("t_key", "known_t", least))
    scored = pairs.withColumn("st", ratio_col(F.col("t_key"), F.col("known_t"))).where(F.col("st") >= least)
    alike = scored.withColumn("score", 0.7 * F.col("st") + 0.3 * F.col("sa"))
    best = alike.withColumn("k", F.row_number().over(Window.partitionBy("a_key", "t_key").orderBy(F.desc("score"), "known_a", "known_t"))).where("k = 1")
    return exact.unionByName(best.select("a_key", "t_key", "known_a", "known_t", "score"))


def who_listed(picks: DataFrame, artist: str) -> DataFrame:
    """Listings of one artist's albums, by year and title, with critics and the best rank."""
    wanted = keyed(picks).where(F.col("a_key") == match_key(F.lit(artist)))
    return wanted.groupBy("year", "t_key").agg(F.countDistinct("critic").alias("critics"), F.min("rank").alias("best_rank"))


def regrets(picks: DataFrame, plays: DataFrame, year: int, ago: int) -> DataFrame:
    """Albums listed ``ago`` years before ``year`` or earlier that were never played, of artists that were."""
    albums = consolidated(picks).where(F.lit(year) - F.col("last_year") >= ago).join(heard(plays), ["a_key", "t_key"], "left_anti")
    known = plays.withColumn("a_key", match_key(F.col("artist"))).where("a_key <> ''").groupBy("a_key").agg(F.count("*").alias("artist_plays"))
    return albums.join(known, "a_key").withColumn("years_ago", F.lit(year).cast("bigint") - F.col("last_year"))


def frequent_listings(picks: DataFrame, plays: DataFrame, least: int) -> DataFrame:
    """Unheard albums by listings (a critic who lists one twice counts twice), with the first three critics by name."""
    new = keyed(picks).join(heard(plays), ["a_key", "t_key"], "left_anti")
    out = new.groupBy("a_key", "t_key").agg(F.count("*").alias("listings"), F.array_join(F.slice(F.array_sort(F.collect_set("critic")), 1, 3), "|").alias("critics"))
    return out.where(F.col("listings") >= least)


def profiles(picks: DataFrame, plays: DataFrame, signature: int = 2) -> DataFrame:
    """Per critic: picks, heard, rank among critics by share heard, lists' first and last year, artists listed ``signature`` times."""
    mine = heard(plays).select("a_key", "t_key", F.lit(1).alias("h"))
    rows = keyed(picks).where("critic IS NOT NULL").join(mine, ["a_key", "t_key"], "left")
    artists = rows.groupBy("critic", "a_key").agg(F.count("*").alias("n")).groupBy("critic").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") >= signature, F.col("a_key")))), "|").alias("signature"))
    base = rows.groupBy("critic").agg(F.count("*").alias("picks"), F.count("h").alias("heard"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    scored = base.withColumn("s", F.round(F.col("heard") / F.col("picks"), 6))
    # critics ahead of each score: one row a score, of which there are few, is all that one task orders
    scores = scored.groupBy("s").agg(F.count("*").alias("n"))
    ahead = scores.select("s", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("s").orderBy("critic"))
    return scored.join(ahead, "s").withColumn("rank", rank.cast("bigint")).drop("s", "ahead").join(artists, "critic")


def unheard_weighted(picks: DataFrame, plays: DataFrame) -> DataFrame:
    """(a_key, t_key, critics, years, weight): unheard albums, with the ``overlap`` of the critics who list them added up."""
    albums = keyed(picks).where("critic IS NOT NULL").groupBy("a_key", "t_key", "critic").agg(F.collect_set("year").alias("y"))
    new = albums.join(heard(plays), ["a_key", "t_key"], "left_anti").join(overlap(picks, plays).select("critic", "overlap"), "critic")
    years = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("y")))).cast("array<string>"), ",")
    return new.groupBy("a_key", "t_key").agg(F.count("*").alias("critics"), years.alias("years"), F.round(F.sum("overlap"), 6).alias("weight"))


def resolve_critic(picks: DataFrame, name: str) -> str | None:
    """The critic of this name, whatever its case, else the first in order whose name holds it; None if there is none."""
    names = picks.where("critic IS NOT NULL").select("critic").distinct()
    same, held = F.lower("critic") == name.lower(), F.lower("critic").contains(name.lower())
    first = names.where(held).orderBy(F.when(same, 0).otherwise(1), "critic").first()
    return first["critic"] if first else None


def critic_picks(picks: DataFrame, plays: DataFrame, most: int = 15) -> DataFrame:
    """Per critic the first picks heard, with plays, and those missed, by year, rank (none last) and title, joined by bars."""
    rows = keyed(picks).where("critic IS NOT NULL").groupBy("critic", "a_key", "t_key").agg(F.min(F.struct(F.coalesce("year", F.lit(9999)).alias("y"), F.coalesce("rank", F.lit(999)).alias("r"))).alias("o"))
    met = rows.join(heard(plays).select("a_key", "t_key", "plays"), ["a_key", "t_key"], "left").withColumn("h", F.col("plays").isNotNull())
    placed = met.withColumn("k", F.row_number().over(Window.partitionBy("critic", "h").orderBy("o", "t_key", "a_key")))
    title = F.concat_ws(" - ", "a_key", "t_key")
    return placed.groupBy("critic").agg(
        joined_first(most, F.when(F.col("h"), F.col("k")), F.concat_ws(":", title, F.col("plays").cast("string"))).alias("heard"), joined_first(most, F.when(~F.col("h"), F.col("k")), title).alias("missed")
    )


def review_summary(picks: DataFrame) -> DataFrame:
    """In one row: lists, entries with names, albums, artists, mean size of a list and the upper median."""
    rows = keyed(picks)
    sizes = rows.groupBy("list_id").agg(F.count("*").alias("n"))
    base = sizes.agg(F.count("*").alias("lists"), F.sum("n").alias("entries"), F.round(F.avg("n"), 1).alias("mean_size"), F.expr("percentile_disc(0.5000001) WITHIN GROUP (ORDER BY n)").cast("bigint").alias("median_size"))
    distinct = rows.agg(F.countDistinct("a_key", "t_key").alias("albums"), F.countDistinct("a_key").alias("artists"))
    return with_facts(base, distinct)


def review_albums(picks: DataFrame, plays: DataFrame, darling: int = 5, consensus: int = 10, most: int = 15) -> DataFrame:
    """(a_key, t_key, critics, mean_rank, heard, consensus, darling, deep_cut): darlings are the ``most`` best ranked albums of ``darling`` critics (ties by name), deep cuts are heard and of three critics at most."""
    albums = consolidated(picks).select("a_key", "t_key", "critics", "mean_rank").join(heard(plays).select("a_key", "t_key", "plays"), ["a_key", "t_key"], "left").withColumn("heard", F.col("plays").isNotNull())
    best = albums.where((F.col("critics") >= darling) & F.col("mean_rank").isNotNull()).orderBy("mean_rank", "a_key", "t_key").limit(most).select("a_key", "t_key", F.lit(True).alias("darling"))
    out = albums.join(F.broadcast(best), ["a_key", "t_key"], "left")
    return out.select(
        "a_key", "t_key", "critics", "mean_rank", "heard", (F.col("critics") >= consensus).alias("consensus"), F.coalesce("darling", F.lit(False)).alias("darling"), (F.col("heard") & F.col("critics").between(1, 3)).alias("deep_cut")
    )


def album_listings(picks: DataFrame, plays: DataFrame) -> DataFrame:
    """Per listed album: its critics by year and rank (none last), years, and, if played, plays, first play and the month of most plays, the earliest on ties."""
    order = F.struct(F.coalesce("year", F.lit(9999)).alias("y"), F.coalesce("rank", F.lit(999)).alias("r"), F.coalesce("critic", F.lit("")).alias("c"))
    rows = F.sort_array(F.collect_list(order))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["c"], r["y"].cast("string"), r["r"].cast("string"))), "|")
    years = F.array_join(F.array_sort(F.collect_set("year")).cast("array<string>"), ",")
    listed = keyed(picks).groupBy("a_key", "t_key").agg(F.count("*").alias("listings"), years.alias("years"), text.alias("critics"))
    spelt = plays.where("artist IS NOT NULL AND album <> ''").groupBy("artist", "album", "year", "month").agg(F.count("*").alias("n"), F.min("uts").alias("u"))
    months = keyed(spelt, "artist", "album").groupBy("a_key", "t_key", (F.col("year") * 12 + F.col("month") - 1).alias("m")).agg(F.sum("n").alias("n"), F.min("u").alias("u"))
    mine = months.groupBy("a_key", "t_key").agg(F.sum("n").alias("plays"), F.min("u").alias("first_uts"), F.min(F.struct((-F.col("n")).alias("k"), "m"))["m"].alias("peak_month"))
    return listed.join(mine, ["a_key", "t_key"], "left")


def artist_in_lists(picks: DataFrame, plays: DataFrame, artist: str) -> DataFrame:
    """One artist's listed albums: first year, listings, critics, plays (0 if not heard)."""
    rows = keyed(picks).where(F.col("a_key") == match_key(F.lit(artist)))
    albums = rows.groupBy("t_key").agg(F.min("year").alias("year"), F.count("*").alias("listings"), F.array_join(F.array_sort(F.collect_set("critic")), "|").alias("critics"))
    mine = heard(plays).where(F.col("a_key") == match_key(F.lit(artist))).select("t_key", "plays")
    return albums.join(mine, "t_key", "left").withColumn("plays", F.coalesce("plays", F.lit(0)))


def champions(picks: DataFrame, plays: DataFrame, artist: str) -> DataFrame:
    """Critics who list an artist: how often, and the share of all their picks that was heard."""
    mine = keyed(picks).where((F.col("a_key") == match_key(F.lit(artist))) & F.col("critic").isNotNull()).groupBy("critic").agg(F.count("*").alias("times"))
    return alignment(picks, plays).select("critic", "alignment").join(mine, "critic")


def catalog_stats(releases: DataFrame, genres: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, years and distinct names of the release tables, in one row."""
    r = releases.agg(F.count("*").alias("releases"), F.min("year").cast("bigint").alias("first_year"), F.max("year").cast("bigint").alias("last_year"), F.countDistinct("artist_norm").alias("artists"))
    g = genres.agg(F.countDistinct("genre").alias("genres"), F.sum("count").cast("bigint").alias("tags"))
    n = labels.agg(F.countDistinct("label_name").alias("labels"))
    one = F.lit(1)
    return r.withColumn("_o", one).join(g.withColumn("_o", one), "_o").join(n.withColumn("_o", one), "_o").drop("_o")


def most_used(df: DataFrame, name: str, weight: Column, limit: int) -> DataFrame:
    """The first ``limit`` genres or labels by weight, then name."""
    return df.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(name).agg(F.sum(weight).cast("bigint").alias("n")).orderBy(F.desc("n"), name).limit(limit)

"""What a taste is like: spaces of artists compared, ways from one artist to another, critics over the years, picks by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.operators.vectors import dot, unit
from segno.plans import with_facts

MODES = ("adventurous", "familiar", "bridge")


def temporal_matrix(plays: DataFrame, by: list[str], least: int = 5, window: str = "week") -> DataFrame:
    """(…, window, artist, value): artists against windows of an owner, as a sparse matrix.

    A cell is log(1 + plays) times log(windows / (windows with the artist + 1));
    every window's column has length 1.  Artists of fewer than ``least`` plays
    are left out.
    """
    rows = plays.where("artist <> ''").select(*by, F.date_trunc(window, "ts").cast("date").cast("string").alias("window"), "artist")
    often = rows.groupBy("artist").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("artist")
    cells = rows.join(often, "artist", "left_semi").groupBy(*by, "window", "artist").agg(F.count("*").alias("n"))
    windows = cells.select(*by, "window").distinct().agg(F.count("*").alias("w"))
    met = with_facts(cells.withColumn("df", F.count("*").over(Window.partitionBy("artist"))), windows)
    value = F.log1p("n") * F.log(F.col("w") / (F.col("df") + 1))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*by, "window")))
    return met.withColumn("v", value).select(*by, "window", "artist", F.when(norm > 0, F.col("v") / norm).otherwise(0.0).alias("value"))


def dimension_shares(vectors: DataFrame) -> DataFrame:
    """(dim, share): the share of each dimension in the variance of all."""
    long = vectors.select(F.posexplode("embedding").alias("dim", "v")).groupBy("dim").agg(F.var_pop(F.col("v").cast("double")).alias("s"))
    return long.select(F.col("dim").cast("bigint").alias("dim"), F.round(F.try_divide("s", F.sum("s").over(Window.partitionBy())), 6).alias("share"))  # a row a dimension


def taste_gaps(bridges: DataFrame, plays: DataFrame, least: int = 50, apart: float = 0.15, alike: float = 0.3) -> DataFrame:
    """``bridges`` of artists of ``least`` plays with a label: divergent where two spaces share few neighbours, aligned where they share many, else none."""
    known = plays.where("artist <> ''").groupBy(F.lower("artist").alias("a")).agg(F.count("*").alias("plays")).where(F.col("plays") >= least)
    label = F.when(F.col("jaccard") < apart, "divergent").when(F.col("jaccard") > alike, "aligned")
    return bridges.join(known, "a").select("a", "plays", "jaccard", label.alias("label"), "only_one", "only_other")


def bridge_items(near: DataFrame, vectors: DataFrame, k: int = 8, fewest: int = 4, below: float = 0.6) -> DataFrame:
    """(item, diversity): items whose ``k`` neighbours (a, b, place) are unlike one another: 1 - the mean cosine of their pairs.

    Pairs are of an item's k neighbours only.  Items of fewer than ``fewest``
    neighbours with a vector, or whose neighbours are alike, are left out.
    """
    held = near.where(F.col("place") <= k).join(vectors.select(F.col("item").alias("b"), unit(F.col("embedding")).alias("v")), "b")
    one, other = held.select("a", F.col("b").alias("x"), F.col("v").alias("vx")), held.select("a", F.col("b").alias("y"), F.col("v").alias("vy"))
    pairs = one.join(other, "a").where("x < y").select("a", dot(F.col("vx"), F.col("vy")).alias("c"))
    out = pairs.groupBy(F.col("a").alias("item")).agg(F.avg("c").alias("m"), F.count("*").alias("n")).where((F.col("n") >= fewest * (fewest - 1) / 2) & (F.col("m") < below))
    return out.select("item", F.round(1 - F.col("m"), 6).alias("diversity"))


def gateways(plays: DataFrame, by: list[str], year: int, near: DataFrame, k: int = 20, n: int = 2) -> DataFrame:
    """(…, artist, gateway, place): for artists an owner first heard in a year, the ``n`` nearest neighbours heard before them.

    ``near`` (a, b, place) has lower-case names.
    """
    first = plays.where("artist <> ''").groupBy(*by, F.lower("artist").alias("artist")).agg(F.min("uts").alias("t"), F.min("year").alias("y"))
    found = first.where(F.col("y") == year).select(*by, "artist", F.col("t").alias("found"))
    met = found.join(near.where(F.col("place") <= k).select(F.col("a").alias("artist"), F.col("b").alias("gateway"), F.col("place").alias("p")), "artist")
    before = first.select(*by, F.col("artist").alias("gateway"), "t")
    kept = met.join(before, [*by, "gateway"]).where("t < found")
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy(*by, "artist").orderBy("p", "gateway")).cast("bigint"))
    return placed.where(F.col("place") <= n).select(*by, "artist", "gateway", "place")


def similar_to(near: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """(ordinal, asked, status, similar): the first ``k`` neighbours of each name asked for, in the order asked, by bars; unknown names say so."""
    asked = near.sparkSession.createDataFrame([(i, x, x.lower()) for i, x in enumerate(names)], "ordinal bigint, asked string, a string")
    rows = near.where(F.col("a").isin([x.lower() for x in names]) & (F.col("place") <= k)).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "b"))).alias("l"))
    out = F.broadcast(asked).join(rows, "a", "left")
    return out.select("ordinal", "asked", F.when(F.col("l").isNull(), "unknown").otherwise("ok").alias("status"), F.coalesce(F.array_join(F.col("l.b"), "|"), F.lit("")).alias("similar"))


def most_similar(vectors: DataFrame, key: str, taste: DataFrame, least: float = -1.0, limit: int = 10) -> DataFrame:
    """(key, similarity): owners' unit vectors nearest to one taste vector (one row), first by similarity, then key."""
    scored = with_facts(vectors, taste.select(F.col("embedding").alias("_t"))).select(key, F.round(dot(F.col("embedding"), F.col("_t")), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(limit)


def drift(vectors: DataFrame, key: str, taste: DataFrame, step: float = 0.05) -> DataFrame:
    """(key, years, first, last, trend): how near an owner's yearly unit vectors come to a taste vector (one row), in the first and the last year; the trend is rising or falling by ``step``."""
    each = with_facts(vectors, taste.select(F.col("embedding").alias("_t"))).select(key, "year", dot(F.col("embedding"), F.col("_t")).alias("s"))
    out = each.groupBy(key).agg(F.count("*").alias("years"), F.round(F.min_by("s", "year"), 6).alias("first"), F.round(F.max_by("s", "year"), 6).alias("last"))
    moved = F.col("last") - F.col("first")
    return out.withColumn("trend", F.when(moved > step, "rising").when(moved < -step, "falling").otherwise("stable"))


def mode_weight(mode: str, alignment: Column, plays: Column, similarity: Column, is_bridge: Column) -> Column:
    """How much a candidate counts in a draw: new artists, ones like favourites, or ones in both spaces first; never nothing."""
    if mode not in MODES:
        raise ValueError("a mode is adventurous, familiar or bridge")
    boost = {
        "adventurous": F.when(plays == 0, 1.0).otherwise(0.3),
        "familiar": F.when(similarity > 0.1, 2.0 + 8.0 * similarity).otherwise(0.1),
        "bridge": F.when(is_bridge, 10.0).otherwise(0.1),
    }[mode]
    return F.when(alignment > 0, F.greatest(alignment * boost, F.lit(0.01))).otherwise(0.001)

"""Queries of taste, similarity and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.operators import counts as C
from segno.operators import critics as K
from segno.operators import evaluate as E
from segno.operators import sessions as S
from segno.operators import taste as T
from segno.operators import vectors as V
from segno.queries_core import BY, _bridges, _picks, _plays, _ranked_picks
from segno.queries_reports import ARTIST
from segno.plans import durable
from segno.sources.tables import table


def _near(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return V.neighbours(V.weekly_pairs(_plays(spark, d), BY, 20), "cosine", k)


def _space(spark: SparkSession, d: str) -> DataFrame:
    """A given space: an artist's vector is one of ``embeddings``, by its id."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    named = table(spark, d, "artists").groupBy(F.lower("name").alias("item")).agg((F.min("artist_id") % 500).alias("v"))
    return named.join(vectors, "v").select("item", "embedding")


def _taste(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the 100 artists most played, by the logarithm of plays."""
    top = C.top(_plays(spark, d).withColumn("artist", F.lower("artist")), [], ["artist"], 100)
    return V.mean_vectors(top.select(F.lit(1).alias("one"), "artist", F.log1p("plays").alias("w")), ["one"], "artist", "w", _space(spark, d))


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    weight = 1 / F.log2(F.coalesce("rank", F.lit(50)) + 1)
    return _picks(spark, d).where("critic IS NOT NULL").select("critic", "year", F.lower("artist").alias("artist"), weight.alias("w"))


def _similar_critics(spark: SparkSession, d: str) -> DataFrame:
    return T.most_similar(V.mean_vectors(_weighed(spark, d), ["critic"], "artist", "w", _space(spark, d)), "critic", _taste(spark, d))


def _drift(spark: SparkSession, d: str) -> DataFrame:
    yearly = V.mean_vectors(_weighed(spark, d).where("year IS NOT NULL"), ["critic", "year"], "artist", "w", _space(spark, d))
    return T.drift(yearly, "critic", _taste(spark, d))


def _bridge_items(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    near = V.nearest(vectors, vectors.where("vec_id % 100 = 0"), 8).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "place")
    return T.bridge_items(near, vectors.select(F.col("vec_id").alias("item"), "embedding"), below=2.0)


def _pick_weights(spark: SparkSession, d: str) -> DataFrame:
    """Unheard listed albums with their weight in a draw that looks for new artists."""
    picks, plays = _picks(spark, d), _plays(spark, d)
    mine = plays.where("artist IS NOT NULL").groupBy("artist").agg(F.count("*").alias("n")).withColumn("a_key", K.match_key(F.col("artist"))).groupBy("a_key").agg(F.sum("n").alias("n"))
    new = K.keyed(picks).join(K.heard(plays), ["a_key", "t_key"], "left_anti").join(K.alignment(picks, plays).select("critic", "alignment"), "critic")
    albums = new.groupBy("a_key", "t_key").agg(F.max("alignment").alias("alignment")).join(mine, "a_key", "left")
    weight = T.mode_weight("adventurous", F.col("alignment"), F.coalesce("n", F.lit(0)), F.lit(0.0), F.lit(False))
    return albums.select("a_key", "t_key", F.round(weight, 6).alias("weight"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return durable(S.assign_sessions(_plays(spark, d), "username", "uts", 1800, "play_id").where("artist <> ''").select("username", "session_start", "ts", "artist"))


def _continuations(spark: SparkSession, d: str, windows: dict[str, Column | None]) -> DataFrame:
    rows = _sessions(spark, d)
    spaces = {name: V.window_neighbours(rows, BY, 20, 100, window) for name, window in windows.items()}
    baskets = rows.select("username", "session_start", F.lower("artist").alias("node"))
    return E.continuations(baskets, ["username", "session_start"], "node", spaces).withColumnRenamed("space", "granularity")


def _granularities(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours from weeks, days, months and sessions."""
    return _continuations(spark, d, {"weekly": None, "daily": F.date_trunc("day", "ts"), "monthly": F.date_trunc("month", "ts"), "session30": F.col("session_start")})


def _holdout(spark: SparkSession, d: str) -> DataFrame:
    """Lists up to 2014 against what was first heard in 2015 and 2016."""
    named = _plays(spark, d).where("artist <> ''").select("year", F.lower("artist").alias("item"))
    near = V.neighbours(V.listed_together(_picks(spark, d).where("year <= 2014")), "weight", 20)
    return E.holdout(named.where("year <= 2014"), named.where("year BETWEEN 2015 AND 2016"), near, 3)


def _follow_unheard(spark: SparkSession, d: str) -> DataFrame:
    """Follow-through of the picks that nobody had heard by the end of the list's year."""
    played = K.heard(_plays(spark, d)).select("a_key", "t_key", F.year(F.timestamp_seconds("first_uts")).alias("first"))
    new = _ranked_picks(spark, d).join(played, ["a_key", "t_key"], "left").where("first IS NULL OR first > year")
    return E.follow_through(new, ["year"], [1, 5, 10, 50])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked_picks(spark, d)
    rows = lambda k: E.ndcg(ranked, ["year"], k).select(F.lit(f"first_{k}").alias("run"), F.concat(F.lit("ndcg_"), F.col("year").cast("string")).alias("metric"), F.col("ndcg").alias("value"))
    return E.compare_runs(rows(10).unionByName(rows(20)), ["first_10", "first_20"])


QUERIES = {
    "temporal_matrix": lambda s, d: T.temporal_matrix(_plays(s, d), BY, 20).withColumn("value", F.round("value", 6)),
    "dimension_shares": lambda s, d: T.dimension_shares(table(s, d, "embeddings")),
    "taste_gaps": lambda s, d: T.taste_gaps(_bridges(s, d), _plays(s, d), 50),
    "bridge_items": _bridge_items,
    "gateways": lambda s, d: T.gateways(_plays(s, d), BY, 2015, _near(s, d)),
    "similar_artists": lambda s, d: T.similar_to(_near(s, d), [ARTIST, "Nobody At All"]),
    "similar_critics_given": _similar_critics,
    "critic_drift": _drift,
    "pick_weights": _pick_weights,
    "continuation_weekly": lambda s, d: _continuations(s, d, {"weekly": None}),
    "continuation_granularities": _granularities,
    "holdout": _holdout,
    "follow_unheard": _follow_unheard,
    "runs_compared": _runs,
}

"""Queries of the core operators over the input tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segno.operators import changepoints as CP
from segno.operators import counts as C
from segno.operators import critics as K
from segno.operators import eras as R
from segno.operators import evaluate as E
from segno.operators import graph as G
from segno.operators import session_graph as SG
from segno.operators import sessions as S
from segno.operators import trajectory as T
from segno.operators import vectors as V
from segno.operators import windows as W
from segno.operators.heavy import artist_counts, heavy_artists
from segno.operators.plays import merged_plays
from segno.operators.sessions import sessions
from segno.plans import durable
from segno.sources.playlog import picks, with_time
from segno.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_artists(table(spark, d, "plays"), table(spark, d, "artists"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return artist_counts(table(spark, d, "plays"), table(spark, d, "artists"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = sessions(table(spark, d, "plays"), "username", "uts")
    return found.select("username", F.col("start_ts").alias("start_uts"), F.col("end_ts").alias("end_uts"))


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    merged = merged_plays(table(spark, d, "plays"), table(spark, d, "artists"))
    found = sessions(merged, "username", "uts")
    return found.select("username", F.col("start_ts").alias("start_uts"), F.col("end_ts").alias("end_uts"), "duration", F.col("n_events").alias("n_plays"))


BY = ["username"]


def _plays(spark: SparkSession, d: str) -> DataFrame:
    return with_time(table(spark, d, "plays"))


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _picks(spark: SparkSession, d: str) -> DataFrame:
    return picks(table(spark, d, "critic_lists"))


def _line(spark: SparkSession, d: str) -> DataFrame:
    """Months of 2010 to 2015 of each listener's first five artists."""
    plays = _plays(spark, d)
    keys = C.top(plays, BY, ["artist"], 5).select(*BY, F.lower("artist").alias("key"))
    return T.timeline(plays, BY, keys, 2010 * 12, 2015 * 12 + 11)


#: A week in summer 2015, 30 days on either side, 90 days of baseline beyond.
EVENT = W.EventWindow(date(2015, 6, 1), 7, 30, 30, 90)
MONTHS = CP.Segmentation("month", 5)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.session_edges(G.session_nodes(_plays(spark, d), "username", 5), "username", 3)


def _participation(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    groups = G.degrees(edges).select("node", (F.length("node") % 3).alias("community"))
    return _six(G.participation(edges, groups), "participation")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    return G.node_measures(_edges(spark, d))


GRAPH = SG.GraphConfig(1800, 3, 2, 2012, 2018, pivots=200)


def _session_graph(spark: SparkSession, d: str) -> SG.SessionGraph:
    return SG.session_graph(_plays(spark, d), "username", GRAPH)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Participation in communities given by the first letter of what the node shows."""
    graph = _session_graph(spark, d)
    return _six(SG.participation(graph, graph.nodes.select("node", F.ascii("name").alias("community"))), "participation")


def _focused(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the neighbours of the artist of most plays."""
    graph = _session_graph(spark, d)
    first = graph.nodes.orderBy(F.desc("plays"), "node").first()
    return SG.around(graph, first["node"] if first else "", 1).edges


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return K.played_releases(_plays(spark, d), table(spark, d, "releases"))


def _ranked_picks(spark: SparkSession, d: str) -> DataFrame:
    """Per year the listed albums by the number of critics, with the plays of later years as relevance."""
    listed = K.keyed(_picks(spark, d)).where("year IS NOT NULL").groupBy("year", "a_key", "t_key").agg(F.countDistinct("critic").alias("popularity"))
    played = K.keyed(_plays(spark, d), "artist", "album").groupBy("a_key", "t_key", F.col("year").alias("y")).agg(F.count("*").alias("n"))
    later = listed.join(played, ["a_key", "t_key"]).where("y > year").groupBy("year", "a_key", "t_key").agg(F.sum("n").alias("relevance"))
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("popularity"), "a_key", "t_key"))
    return listed.join(later, ["year", "a_key", "t_key"], "left").select("year", "a_key", "t_key", "popularity", F.coalesce("relevance", F.lit(0)).alias("relevance"), place.alias("place"))


def _colisting_space(spark: SparkSession, d: str) -> DataFrame:
    return V.embed(V.listed_together(_picks(spark, d)), "weight", 32)


def _bridges(spark: SparkSession, d: str) -> DataFrame:
    one = V.neighbours(V.weekly_pairs(_plays(spark, d), BY, 20), "cosine", 15)
    return V.bridges(one, V.neighbours(V.listed_together(_picks(spark, d)), "weight", 15))


def _similar_critics(spark: SparkSession, d: str) -> DataFrame:
    """Critics by how close the mean of their artists' vectors is to that of what was played."""
    space = _colisting_space(spark, d)
    picked = _picks(spark, d).where("critic IS NOT NULL").select("critic", F.lower("artist").alias("artist"), (1 / F.log2(F.coalesce("rank", F.lit(50)) + 1)).alias("w"))
    played = C.top(_plays(spark, d).withColumn("artist", F.lower("artist")), [], ["artist"], 100).select(F.lit(1).alias("one"), "artist", F.log1p("plays").alias("w"))
    taste = V.mean_vectors(played, ["one"], "artist", "w", space).first()
    critics = V.mean_vectors(picked, ["critic"], "artist", "w", space)
    return V.similar_owners(critics, "critic", taste["embedding"] if taste else [])


def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return K.fuzzy_match(K.consolidated(_picks(spark, d)), K.heard(_plays(spark, d)))


def _era_plays(spark: SparkSession, d: str) -> DataFrame:
    """Plays of albums released in the nineties."""
    return _matched(spark, d).where("year BETWEEN 1990 AND 1999").groupBy("artist", "album").agg(F.sum("plays").alias("plays"), F.min("year").alias("year"))


def _acclaim(spark: SparkSession, d: str) -> DataFrame:
    """Albums of two critics or more with what the log has of them."""
    return K.consolidated(_picks(spark, d)).where("critics >= 2").join(K.heard(_plays(spark, d)), ["a_key", "t_key"], "left").select("a_key", "t_key", "critics", "mean_rank", F.coalesce("plays", F.lit(0)).alias("plays"))


def _diverse(spark: SparkSession, d: str) -> DataFrame:
    albums = C.familiarity(_plays(spark, d), BY).select(*BY, F.concat_ws(" - ", "artist", "album").alias("item"), "artist", "familiarity")
    return V.diversified(albums, BY, "item", "artist", "familiarity", 10)


QUERIES = {
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p7_found": p7_found,
    "p7_sessions": p7_sessions,
    "top_artists": lambda s, d: C.top(_plays(s, d), BY, ["artist"], 20),
    "top_albums": lambda s, d: C.top(_plays(s, d), BY, ["artist", "album"], 20),
    "top_tracks": lambda s, d: C.top(_plays(s, d), BY, ["artist", "track"], 20),
    "distinct_counts": lambda s, d: C.distinct_counts(_plays(s, d), BY),
    "first_last": lambda s, d: C.first_last(_plays(s, d), BY),
    "spans": lambda s, d: C.spans(_plays(s, d), BY),
    "discovered": lambda s, d: C.discovered(_plays(s, d), BY, 2015),
    "abandoned": lambda s, d: C.abandoned(_plays(s, d), BY, 2015),
    "new_between": lambda s, d: C.new_between(_plays(s, d), BY, 1_400_000_000, 1_500_000_000),
    "albums_5x5": lambda s, d: C.listened_albums(_plays(s, d), BY, 2, 2),
    "familiarity": lambda s, d: _six(C.familiarity(_plays(s, d), BY), "coverage", "depth", "dispersion"),
    "obsessions": lambda s, d: C.obsessions(_plays(s, d), BY),
    "one_track_artists": lambda s, d: C.one_track_artists(_plays(s, d), BY, least=3),
    "temporal_hour": lambda s, d: C.per_hour(_plays(s, d), BY, "hour"),
    "temporal_weekday": lambda s, d: C.per_hour(_plays(s, d), BY, "weekday"),
    "temporal_month": lambda s, d: C.per_hour(_plays(s, d), BY, "month"),
    "taste_evolution": lambda s, d: C.yearly(_plays(s, d), BY),
    "loyalty": lambda s, d: C.loyalty(_plays(s, d), BY),
    "funnel": lambda s, d: C.funnel(_plays(s, d), BY),
    "echo_chamber": lambda s, d: C.echo_chamber(_plays(s, d), BY),
    "streaks": lambda s, d: C.streaks(_plays(s, d), BY),
    "rank_margins": lambda s, d: C.rank_margins(_plays(s, d), BY, 20),
    "calendar": lambda s, d: C.daily(_plays(s, d), BY),
    "peaks": lambda s, d: C.peaks(_plays(s, d), BY, 50),
    "core_years": lambda s, d: C.core_years(_plays(s, d), BY),
    "session_ids": lambda s, d: S.assign_sessions(_plays(s, d), "username", "uts", 1800, "play_id").select("play_id", "username", "uts", "session_start"),
    "session_stats": lambda s, d: S.session_stats(_plays(s, d), "username", "uts"),
    "transitions": lambda s, d: S.transitions(_plays(s, d), "username"),
    "discovery_context": lambda s, d: S.discovery_context(_plays(s, d), "username"),
    "trajectory_timeline": lambda s, d: _line(s, d).drop("first_uts", "last_uts"),
    "trajectory_summary": lambda s, d: T.summary(_line(s, d), BY),
    "trajectory_batch": lambda s, d: T.trajectories(_plays(s, d), BY, ["the paper estuaries", "Nobody At All", "THE SOFT BEACONS"], 2010 * 12, 2015 * 12 + 11, 2),
    "trajectory_observation": lambda s, d: T.observation(_line(s, d), _plays(s, d), BY, 2010 * 12, 2015 * 12 + 11),
    "trajectory_segments": lambda s, d: T.active_segments(_line(s, d), BY, 3),
    "peak_ramp": lambda s, d: T.peak_and_ramp(_line(s, d), BY),
    "dormancy": lambda s, d: T.dormancy(_line(s, d), BY, 3),
    "cohort_retention": lambda s, d: T.cohort_retention(_plays(s, d), BY, [1, 3, 6, 12], 2),
    "cohort_summary": lambda s, d: T.cohort_summary(_plays(s, d), BY, 2),
    "cohort_years": lambda s, d: T.cohort_retention(_plays(s, d), BY, [1, 12], 1, 1, "year", "month", "2011", "2014"),
    "event_periods": lambda s, d: W.period_stats(_plays(s, d), BY, W.covered_intervals(_plays(s, d), EVENT)),
    "event_tops": lambda s, d: W.period_tops(_plays(s, d), BY, W.covered_intervals(_plays(s, d), EVENT), 5, "album"),
    "event_compare": lambda s, d: W.compare(_plays(s, d), BY, W.covered_intervals(_plays(s, d), EVENT), 10),
    "event_compare_tracks": lambda s, d: W.compare(_plays(s, d), BY, W.covered_intervals(_plays(s, d), EVENT), 5, "track"),
    "month_bins_vocab": lambda s, d: CP.bin_counts(_plays(s, d), BY, MONTHS),
    "share_vectors": lambda s, d: _six(CP.share_vectors(CP.bin_counts(_plays(s, d), BY, MONTHS), BY), "value"),
    "change_points": lambda s, d: CP.change_points(_plays(s, d), BY),
    "change_segments": lambda s, d: CP.segment_report(_plays(s, d), BY, CP.Segmentation(), durable(CP.change_points(_plays(s, d), BY))),
    "change_report": lambda s, d: CP.change_report(_plays(s, d), BY, CP.Segmentation(), durable(CP.change_points(_plays(s, d), BY))),
    "session_graph_edges": _edges,
    "graph_strength": lambda s, d: G.degrees(_edges(s, d)),
    "participation": _participation,
    "hop_neighbourhood": lambda s, d: G.neighbourhood(_edges(s, d), "the paper estuaries", 2),
    "graph_measures": _measures,
    "identity_nodes": lambda s, d: _session_graph(s, d).nodes,
    "identity_edges": lambda s, d: _session_graph(s, d).edges,
    "identity_diagnostics": lambda s, d: _session_graph(s, d).diagnostics,
    "identity_degrees": lambda s, d: SG.degree_measures(_session_graph(s, d)),
    "identity_participation": _groups,
    "identity_focus": _focused,
    "identity_measures": lambda s, d: SG.measured(_session_graph(s, d), GRAPH),
    "normalize_key": lambda s, d: _plays(s, d).where("artist IS NOT NULL").select("artist", "album").distinct().select("artist", "album", K.match_key(F.col("artist")).alias("a_key"), K.match_key(F.col("album")).alias("t_key")),
    "critics_consolidated": lambda s, d: K.consolidated(_picks(s, d)),
    "blind_spots": lambda s, d: K.blind_spots(_picks(s, d), _plays(s, d), 2),
    "validated": lambda s, d: K.validated(_picks(s, d), _plays(s, d), 2),
    "critic_alignment": lambda s, d: K.alignment(_picks(s, d), _plays(s, d)),
    "critic_recommended": lambda s, d: K.recommended(_picks(s, d), _plays(s, d), 20),
    "critic_overlap": lambda s, d: K.overlap(_picks(s, d), _plays(s, d)),
    "critic_accuracy": lambda s, d: K.accuracy(_picks(s, d), _plays(s, d), 2015),
    "critic_tracker": lambda s, d: K.tracker(_picks(s, d), _plays(s, d), 2015, 2016, 1),
    "critics_review": lambda s, d: K.review(_picks(s, d)),
    "lists_summary": lambda s, d: K.lists_summary(_picks(s, d)),
    "release_lookup": lambda s, d: _matched(s, d).select("artist", "album", "release_id"),
    "genres": lambda s, d: K.by_genre(_matched(s, d), table(s, d, "release_genres")),
    "labels": lambda s, d: K.by_label(_matched(s, d), table(s, d, "release_labels")),
    "countries": lambda s, d: K.by_attribute(_matched(s, d), "country"),
    "release_types": lambda s, d: K.by_attribute(_matched(s, d), "release_type"),
    "catalog": lambda s, d: K.catalog(_matched(s, d)),
    "release_mix": lambda s, d: K.release_mix(_matched(s, d)),
    "knn": lambda s, d: _six(V.nearest(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 100 = 0"), 10), "similarity"),
    "dim_poles": lambda s, d: V.poles(table(s, d, "embeddings"), 3),
    "cooccurrence_cosine": lambda s, d: V.weekly_pairs(_plays(s, d), BY, 20),
    "colisting": lambda s, d: V.listed_together(_picks(s, d)),
    "colisting_space": _colisting_space,
    "diversified": _diverse,
    "random_pick": lambda s, d: V.weighted_sample(C.spans(_plays(s, d), []), "artist", "plays", 20),
    "ndcg": lambda s, d: E.ndcg(_ranked_picks(s, d), ["year"], 20),
    "hits": lambda s, d: E.hits(_ranked_picks(s, d), ["year"], 20, [1, 5, 10]),
    "novelty": lambda s, d: E.novelty(_ranked_picks(s, d), ["year"], 20),
    "follow_through": lambda s, d: E.follow_through(_ranked_picks(s, d), ["year"], [1, 5, 10]),
    "gini_coverage": lambda s, d: E.coverage(K.keyed(_picks(s, d)).where("year IS NOT NULL"), ["year"], "a_key"),
    "musical_bridges": _bridges,
    "similar_critics": _similar_critics,
    "fuzzy_match": _fuzzy,
    "eras": lambda s, d: R.eras(_plays(s, d), BY),
    "trends": lambda s, d: R.trends(_plays(s, d), BY),
    "trend_taus": lambda s, d: R.trends(_plays(s, d), BY).drop("p_value"),
    "release_era_plays": _era_plays,
    "album_acclaim": _acclaim,
    "who_listed": lambda s, d: K.who_listed(_picks(s, d), "The Paper Estuaries"),
    "regrets": lambda s, d: K.regrets(_picks(s, d), _plays(s, d), 2025, 3),
    "frequent_listings": lambda s, d: K.frequent_listings(_picks(s, d), _plays(s, d), 2),
    "critic_profiles": lambda s, d: K.profiles(_picks(s, d), _plays(s, d)),
    "catalog_stats": lambda s, d: K.catalog_stats(table(s, d, "releases"), table(s, d, "release_genres"), table(s, d, "release_labels")),
    "top_genres": lambda s, d: K.most_used(table(s, d, "release_genres"), "genre", F.col("count"), 20),
    "top_labels": lambda s, d: K.most_used(table(s, d, "release_labels"), "label_name", F.lit(1), 20),
    "artist_profile": lambda s, d: C.artist_profile(_plays(s, d), BY, "The Paper Estuaries"),
    "year_review": lambda s, d: C.year_review(_plays(s, d), BY, 2015),
    "period_summary": lambda s, d: C.period_summary(_plays(s, d), BY, 2012, 2016),
    "artists_containing": lambda s, d: C.containing(_plays(s, d), BY, "paper"),
    "plays_rollup": lambda s, d: C.rollup_plays(_plays(s, d), BY),
}

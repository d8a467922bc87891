"""The play log with artists and recordings resolved, and its repeated deliveries merged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.functions.names import artist_key_col, one_slip, play_keys_col, same_recording
from segno.operators.ordered import in_order
from segno.plans import is_small

MERGED = "play_id bigint, username string, uts bigint, artist_id bigint, base string, mark string"


def artist_names(artists: DataFrame) -> DataFrame:
    """(artist_key, artist_id): one row per key; of artists with one key the smallest id stands.  Rows without a name or id have no key."""
    keyed = artists.select(F.col("artist_id").cast("bigint").alias("artist_id"), artist_key_col(F.col("name")).alias("artist_key"))
    return keyed.where("artist_key IS NOT NULL AND artist_id IS NOT NULL").groupBy("artist_key").agg(F.min("artist_id").alias("artist_id"))


def with_artist(plays: DataFrame, artists: DataFrame, *, recordings: bool = False) -> DataFrame:
    """Add ``artist_id`` (null for no artist), and with ``recordings`` also ``base`` and ``mark``.

    The list of artists is broadcast when it is counted small; else the join
    is shuffled, and AQE splits the partitions of hot artists.
    """
    names = artist_names(artists)
    if recordings:
        keyed = plays.withColumn("_k", play_keys_col(F.col("artist"), F.col("track"))).select(*plays.columns, "_k.artist_key", "_k.base", "_k.mark")
    else:
        keyed = plays.withColumn("artist_key", artist_key_col(F.col("artist")))
    names = F.broadcast(names) if is_small(artists.select("artist_id")) else names
    return keyed.join(names, "artist_key", "left").drop("artist_key")


def plays_in_order(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Plays with a listener and a ``uts``, resolved, in partitions sorted by (username, uts, play_id)."""
    base = plays.select(F.col("play_id").cast("bigint").alias("play_id"), "username", F.col("uts").cast("bigint").alias("uts"), "artist", "track")
    if is_small(artists.select("artist_id")):
        placed = with_artist(in_order(base, "username", "uts"), artists, recordings=True)
    else:
        placed = in_order(with_artist(base, artists, recordings=True), "username", "uts")
    return placed.select("play_id", "username", "uts", "artist_id", "base", "mark").sortWithinPartitions("username", "uts", "play_id")


class _Moment:
    """Recordings already seen at one time of one listener."""

    def __init__(self):
        self.kept: dict[tuple, list[tuple[str, str]]] = {}
        self.exact: set[tuple] = set()
        self.near: dict[tuple, list[tuple[str, str]]] = {}

    def repeats(self, artist, rec: tuple[str, str]) -> bool:
        if (artist, rec) in self.exact:
            return True
        self.exact.add((artist, rec))
        seen = self.kept.setdefault(artist, [])
        if len(seen) < 16:
            if any(same_recording(k, rec) for k in seen):
                return True
            seen.append(rec)
            if len(seen) == 16:
                for k in seen:
                    self._index(artist, k)
            return False
        keys = {rec[0], *(rec[0][:i] + rec[0][i + 1 :] for i in range(len(rec[0])))}
        if any(one_slip(k[0], rec[0]) and same_recording(k, rec) for key in keys for k in self.near.get((artist, key), ())):
            return True
        self._index(artist, rec)
        return False

    def _index(self, artist, rec: tuple[str, str]) -> None:
        for key in {rec[0], *(rec[0][:i] + rec[0][i + 1 :] for i in range(len(rec[0])))}:
            self.near.setdefault((artist, key), []).append(rec)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name, at, moment, held = None, None, None, None
    for pdf in batches:
        keep = [True] * len(pdf)
        artists = [None if a != a else a for a in pdf["artist_id"].tolist()]
        for i, (user, uts, artist, base, mark) in enumerate(zip(pdf["username"].tolist(), pdf["uts"].tolist(), artists, pdf["base"].tolist(), pdf["mark"].tolist(), strict=True)):
            if uts != at or user != name:
                name, at, moment, held = user, uts, None, None
            if artist is None or base is None:
                continue
            rec = (artist, (base, mark))
            if moment is None:
                if held is None:  # most moments hold one play
                    held = rec
                    continue
                moment = _Moment()
                moment.repeats(*held)
            keep[i] = not moment.repeats(*rec)
        yield pdf[keep]


def merged_plays(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """``plays_in_order`` with rows of one listener, time and recording merged into the one of the smallest play_id.

    Nulls: rows without listener or time are left out; rows without artist or
    track have no recording and are never merged, repeated rows included.  Partitions keep the order (username, uts, play_id).
    """
    return plays_in_order(plays, artists).mapInPandas(_merge, MERGED)

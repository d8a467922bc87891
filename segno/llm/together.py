"""Items that appear together in a session, and how far beyond chance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.operators.ordered import Rows, in_order, stitch
from segno.operators.plays import with_artist
from segno.plans import durable, is_small, small_or_shuffled

#: Pairs a task counts before it gives them out.
HELD_PAIRS = 500_000
_BASKET = "username string, start_uts bigint, end_uts bigint, items array<bigint>"


def session_baskets(plays: DataFrame, artists: DataFrame, gap: int = 1800) -> DataFrame:
    """(username, start_uts, end_uts, items): the distinct artists of each session, also of sessions without any (an empty list).

    Plays without listener or time are in no session.  Sessions at a
    partition's ends are joined in a second pass over those alone.
    """
    base = plays.select("username", F.col("uts").cast("bigint").alias("uts"), "artist")
    if is_small(artists.select("artist_id")):
        placed = with_artist(in_order(base, "username", "uts"), artists)
    else:
        placed = in_order(with_artist(base, artists), "username", "uts")
    rows = placed.select("username", "uts", "artist_id").sortWithinPartitions("username", "uts")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Rows(["username", "start_uts", "end_uts", "items", "open"])
        name, start, last, items, opening = None, 0, 0, set(), True

        def finish(closing: bool) -> None:
            if name is not None:
                out.rows.append((name, start, last, sorted(items), opening or closing))

        for pdf in batches:
            for user, uts, artist in zip(pdf["username"].tolist(), pdf["uts"].tolist(), pdf["artist_id"].tolist(), strict=True):
                if user != name or uts - last > gap:
                    finish(False)
                    opening = name is None
                    name, start, items = user, uts, set()
                last = uts
                if artist == artist and artist is not None:
                    items.add(int(artist))
            if out.full():
                yield out.frame()
        finish(True)
        if out.rows:
            yield out.frame()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = Rows(["username", "start_uts", "end_uts", "items"]), None
        for user, start, end, items in pdf.sort_values(["start_uts", "end_uts"], kind="stable")[["username", "start_uts", "end_uts", "items"]].itertuples(index=False):
            if held is not None and start - held[2] <= gap:
                held[2] = max(end, held[2])
                held[3] |= set(map(int, items))
                continue
            if held is not None:
                out.rows.append((*held[:3], sorted(held[3])))
            held = [user, start, end, set(map(int, items))]
        if held is not None:
            out.rows.append((*held[:3], sorted(held[3])))
        return out.frame()

    scanned = rows.mapInPandas(scan, _BASKET + ", open boolean")
    return stitch(scanned, "username", join, _BASKET)


def pair_counts(baskets: DataFrame, items: str, least: int = 1, share: int | None = None, times: int | None = None) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n_baskets, lift, pmi) of pairs a < b, exact.

    Pairs are kept with n_ab >= ``least``, ``share`` * n_ab >= S and
    n_ab * S >= ``times`` * n_a * n_b, S counting all baskets; without these
    every pair in a basket comes out.  As n_ab is at most n_a and n_b, with
    ``share`` only items in as many baskets are paired: no more than ``share``
    times the mean number of items of a basket, however many items there are;
    without it all items are, and none are collected.  Each task adds up its
    pairs before the shuffle.  ``baskets`` hold distinct items; a null or empty
    list counts as a basket without items.
    """
    baskets = durable(baskets.select(F.col(items).alias("items")))
    total = baskets.count()
    schema = "a bigint, b bigint, n_ab bigint, n_a bigint, n_b bigint, n_baskets bigint, lift double, pmi double"
    if not total:
        return baskets.sparkSession.createDataFrame([], schema)
    floor = max(least, -(-total // share)) if share else least
    marginal = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= floor)
    frequent = {r["item"] for r in marginal.select("item").collect()} if share else None  # at most share * (items per basket) rows
    shared = baskets.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, held = shared.value, Counter()

        def given() -> pd.DataFrame:
            keys = np.array(list(held), dtype=np.int64).reshape(-1, 2)
            out = pd.DataFrame({"a": keys[:, 0], "b": keys[:, 1], "n": np.fromiter(held.values(), dtype=np.int64, count=len(held))})
            held.clear()
            return out

        for pdf in batches:
            for basket in pdf["items"]:
                if basket is None:
                    continue
                kept = sorted(i for i in basket.tolist() if frequent is None or i in frequent)
                for k, a in enumerate(kept):
                    held.update((a, b) for b in kept[k + 1 :])
                    if len(held) > HELD_PAIRS:
                        yield given()
        if held:
            yield given()

    pairs = baskets.mapInPandas(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= floor)
    known = small_or_shuffled(marginal)
    joined = pairs.join(known.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(known.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    exact = joined.where(F.col("n_ab").cast("decimal(38,0)") * total >= F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)") * times) if times else joined
    lift = F.col("n_ab") * F.lit(float(total)) / F.col("n_a") / F.col("n_b")
    return exact.select("a", "b", "n_ab", "n_a", "n_b", F.lit(total).cast("bigint").alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))


def artists_together(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Pairs of artists with three sessions in common or more, one in 500 of all sessions, three times as often as by chance."""
    return pair_counts(session_baskets(plays, artists), "items", 3, 500, 3)


def all_artists_together(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Every pair of artists with a session in common."""
    return pair_counts(session_baskets(plays, artists), "items")

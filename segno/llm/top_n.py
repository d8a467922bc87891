"""The N items of the highest score within every group, by bounded heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.operators.ordered import Rows
from segno.operators.plays import merged_plays

#: Groups whose heaps a task holds before it gives them out.
HELD_GROUPS = 100_000


def top_n(scored: DataFrame, groups: list[str], scores: list[str], item: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``scores`` downwards, then ``item`` upwards, with their ``place`` from 1.

    Scores and item are whole numbers; the item is unique in its group, so the
    order is total.  A heap of ``n`` per group is kept by every task before
    the shuffle, and the heaps are merged after it: a group of any size sends
    at most ``n`` rows from each task.  Null scores count as lowest; rows with
    a null item are left out; null groups are groups.  Columns other than
    those named aren't carried.
    """
    columns = [*groups, *scores, item]
    rows = scored.where(F.col(item).isNotNull()).select(*columns)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    whole = {c for c in groups if rows.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    low = -(2**63)

    def entries(pdf: pd.DataFrame) -> Iterator[tuple[tuple, tuple]]:
        """(group, entry): of two entries the greater is the better; nulls of numbers come as NaN."""
        keys = [[None if v is None or v != v else int(v) if c in whole else v for v in pdf[c].tolist()] for c in groups]
        marks = [[low if v is None or v != v else int(v) for v in pdf[c].tolist()] for c in scores]
        return zip(zip(*keys, strict=True) if groups else [()] * len(pdf), zip(*marks, [-int(i) for i in pdf[item].tolist()], strict=True), strict=True)

    def push(heap: list[tuple], entry: tuple) -> None:
        if len(heap) < n:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def row(group: tuple, entry: tuple) -> tuple:
        return (*group, *(None if s == low else s for s in entry[:-1]), -entry[-1])

    def heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[tuple]] = {}
        out = Rows(columns)

        def empty() -> None:
            for group, heap in held.items():
                out.rows += [row(group, entry) for entry in heap]
            held.clear()

        for pdf in batches:
            for group, entry in entries(pdf):
                push(held.setdefault(group, []), entry)
            if len(held) > HELD_GROUPS:
                empty()
                yield out.frame()
        empty()
        if out.rows:
            yield out.frame()

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Heaps of one group lie next to each other; only one is held."""
        now, heap, out = None, [], Rows([*columns, "place"])

        def finish() -> None:
            out.rows += [(*row(now, entry), k) for k, entry in enumerate(sorted(heap, reverse=True), 1)]
            heap.clear()

        for pdf in batches:
            for group, entry in entries(pdf):
                if group != now:
                    finish()
                    now = group
                push(heap, entry)
            if out.full():
                yield out.frame()
        finish()
        if out.rows:
            yield out.frame()

    bounded = rows.mapInPandas(heaps, schema)
    # a group's heaps, n rows from each task at most, come together
    met = bounded.repartition(*groups).sortWithinPartitions(*groups) if groups else bounded.repartition(1)
    return met.mapInPandas(merged, schema + ", place int")


def monthly_artist_counts(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """(username, play_month, artist_id, n_plays, last_uts) over merged plays; a play without track counts for its artist."""
    merged = merged_plays(plays, artists).where("artist_id IS NOT NULL")
    # by way of a date, so that the session's time zone doesn't matter
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("uts") / 86_400).cast("int"))
    month = F.date_format(day, "yyyy-MM").alias("play_month")
    return merged.groupBy("username", month, "artist_id").agg(F.count("*").alias("n_plays"), F.max("uts").alias("last_uts"))


def top_artists_by_month(plays: DataFrame, artists: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` artists of each listener and month by plays, then the later last play, then the smaller id."""
    return top_n(monthly_artist_counts(plays, artists), ["username", "play_month"], ["n_plays", "last_uts"], "artist_id", n)

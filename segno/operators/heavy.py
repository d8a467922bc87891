"""Counts per key where a few keys hold most rows.

Keys become dense codes; each input split adds into accumulator arrays with
``bincount`` and gives out blocks of them; equal blocks are added up across
splits.  A row's key decides only which cell it adds to, never which task
works on it, so a hot key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segno.operators.plays import artist_names, with_artist
from segno.plans import durable, small_or_shuffled

#: Cells of an accumulator block.
BLOCK = 1024
#: Blocks a split holds before it gives them out (8 bytes a cell).
HELD_BLOCKS = 4096


def dense_codes(keys: DataFrame, key: str) -> DataFrame:
    """(key, code): distinct keys numbered 0, 1, … without gaps between a task's keys of one range; nulls have no code."""
    known = keys.select(key).where(F.col(key).isNotNull()).distinct()
    parts = known.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    parts = durable(parts)
    sizes = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row per partition
    offsets, total = {}, 0
    for p, n in sizes:
        offsets[p] = total
        total += n
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else None
    code = (place + (offset[F.col("_p")] if offset is not None else 0)).cast("bigint")
    return parts.select(key, code.alias("code"))


def dense_counts(coded: DataFrame, code: str) -> DataFrame:
    """(code, n): rows per code, through accumulator blocks.  Rows without a code aren't counted; an empty table gives no rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, np.ndarray] = {}

        def given() -> pd.DataFrame:
            out = pd.DataFrame({"block": list(blocks), "cells": [b.tolist() for b in blocks.values()]})
            blocks.clear()
            return out

        for pdf in batches:
            codes = pdf[code].dropna().to_numpy(dtype=np.int64)
            if not len(codes):
                continue
            low, high = codes.min() // BLOCK, codes.max() // BLOCK
            if high - low < 64:  # a narrow range of codes: one bincount
                cells = np.bincount(codes - low * BLOCK, minlength=(high - low + 1) * BLOCK).reshape(-1, BLOCK)
                found = zip(range(low, high + 1), cells, strict=True)
            else:
                values, ns = np.unique(codes, return_counts=True)
                at = np.flatnonzero(np.diff(values // BLOCK, prepend=-1))
                found = []
                for a, b in zip(at, [*at[1:], len(values)], strict=True):
                    cells = np.zeros(BLOCK, dtype=np.int64)
                    cells[values[a:b] % BLOCK] = ns[a:b]
                    found.append((int(values[a]) // BLOCK, cells))
            for b, cells in found:
                if b in blocks:
                    blocks[b] += cells
                else:
                    blocks[b] = cells.astype(np.int64)
            if len(blocks) > HELD_BLOCKS:
                yield given()
        if blocks:
            yield given()

    added = coded.select(F.col(code).cast("bigint").alias(code)).mapInPandas(add, "block bigint, cells array<bigint>")
    cells = added.select("block", F.posexplode("cells").alias("cell", "n")).where("n > 0")
    total = cells.groupBy("block", "cell").agg(F.sum("n").alias("n"))
    return total.select((F.col("block") * BLOCK + F.col("cell")).cast("bigint").alias(code), F.col("n").cast("bigint").alias("n"))


def artist_counts(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """(artist_id, n_plays, n_listeners) of every artist of ``artists``, 0 where nobody played them.

    ``n_plays`` counts delivered rows, with or without time; ``n_listeners``
    distinct listeners, nulls not counted.  Rows without artist count nowhere.
    """
    codes = dense_codes(artist_names(artists), "artist_id")
    coded = with_artist(plays.select("artist", "username"), artists).select("artist_id", "username")
    coded = coded.join(small_or_shuffled(codes), "artist_id")
    n_plays = dense_counts(coded, "code").withColumnRenamed("n", "n_plays")
    listeners = coded.where("username IS NOT NULL").select("code", "username").distinct()
    n_listeners = dense_counts(listeners, "code").withColumnRenamed("n", "n_listeners")
    counted = codes.join(n_plays, "code", "left").join(n_listeners, "code", "left")
    return counted.select("artist_id", F.coalesce("n_plays", F.lit(0)).cast("bigint").alias("n_plays"), F.coalesce("n_listeners", F.lit(0)).cast("bigint").alias("n_listeners"))


def heavy_artists(plays: DataFrame, artists: DataFrame, share: int = 100) -> DataFrame:
    """Artists of at least one ``share``-th of all delivered rows."""
    counts = plays_per_artist(plays, artists)
    total = plays.count()
    return counts.where(F.col("n_plays") * share >= F.lit(total)).where("n_plays > 0").select("artist_id")


def plays_per_artist(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """(artist_id, n_plays) of played artists, by dense accumulation."""
    codes = dense_codes(artist_names(artists), "artist_id")
    coded = with_artist(plays.select("artist"), artists).select("artist_id")
    coded = coded.join(small_or_shuffled(codes), "artist_id")
    return codes.join(dense_counts(coded, "code"), "code").select("artist_id", F.col("n").alias("n_plays"))

"""Sessions from a tree over the gaps between events.

The Cartesian tree over an entity's consecutive gaps, the largest gap at the
root, holds the sessions of every threshold: a session is a subtree whose own
largest gap is within the threshold while its parent's is beyond it.  The tree
is a table, one row per subtree, so that a cut is a filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segno.operators.ordered import by_entity, in_order, stitch

#: The parent's gap of a root, beyond every threshold.
OPEN = 2**62
#: The own gap of a single event, within every threshold.
LEAF = -1


def subtrees(start: np.ndarray, end: np.ndarray, count: np.ndarray, left: int, right: int, known: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, end, count, own gap, parent's gap) of every subtree over blocks in order, the whole lying between the gaps ``left`` and ``right``.

    Blocks marked in ``known`` were given out before and aren't again.  One pass with a stack.
    """
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, int]] = []  # gap, start and count of what lies left of it
    starts, ends, counts = start.tolist(), end.tolist(), count.tolist()
    skip = known.tolist() if known is not None else None
    last = len(starts) - 1
    for i, (s, e, c) in enumerate(zip(starts, ends, counts, strict=True)):
        gap, after = LEAF, starts[i + 1] - e if i < last else right
        quiet = skip is not None and skip[i]
        while stack and stack[-1][0] < after:
            g, s0, c0 = stack.pop()
            if not quiet:
                out.append((s, e, c, gap, g))
            s, c, gap, quiet = s0, c + c0, g, False
        if i < last:
            if not quiet:
                out.append((s, e, c, gap, min(after, stack[-1][0] if stack else left)))
            stack.append((after, s, c))
        else:
            while stack:
                g, s0, c0 = stack.pop()
                if not quiet:
                    out.append((s, e, c, gap, g))
                s, c, gap, quiet = s0, c + c0, g, False
            if not quiet:
                out.append((s, e, c, gap, min(left, right)))
    return out


def _spine(gaps: np.ndarray) -> np.ndarray:
    """Positions of gaps larger than all before or all after them."""
    if not len(gaps):
        return np.zeros(0, dtype=int)
    before = np.concatenate(([LEAF], np.maximum.accumulate(gaps)[:-1]))
    after = np.concatenate((np.maximum.accumulate(gaps[::-1])[::-1][1:], [LEAF]))
    return np.flatnonzero((gaps > before) | (gaps > after))


_OUT = ["start_ts", "end_ts", "n_events", "gap", "parent_gap", "chunk", "open"]


def _chunk(name, times: np.ndarray, is_open: bool, entity: str, cut: int | None) -> pd.DataFrame:
    ones = np.ones(len(times), dtype=np.int64)
    if not is_open:
        rows = [(*r, 0, False) for r in subtrees(times, times, ones, OPEN, OPEN) if cut is None or r[3] <= cut < r[4]]
    else:
        cuts = [-1, *_spine(np.diff(times)).tolist(), len(times) - 1]
        rows, gaps = [], np.diff(times)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            block = times[a + 1 : b + 1]
            inner = 0 < k < len(cuts) - 2
            if inner:
                rows += [(*r, 0, False) for r in subtrees(block, block, ones[: len(block)], int(gaps[a]), int(gaps[b])) if cut is None or r[3] <= cut < r[4]]
            rows.append((int(block[0]), int(block[-1]), len(block), int(inner), 0, k, True))
    out = pd.DataFrame(rows, columns=_OUT)
    out.insert(0, entity, name)
    return out


def gap_tree(events: DataFrame, entity: str, time: str, cut: int | None = None) -> DataFrame:
    """The gap tree of each entity: (entity, start_ts, end_ts, n_events, gap, parent_gap), a row per subtree.

    ``time`` is in whole units (seconds).  Rows without entity or time are left
    out; rows of equal time are events with a gap of 0.  An entity of any size
    is built in chunks; of each chunk only the gaps that rise towards an end
    are open, and a second pass joins those per entity.  With ``cut`` only the
    subtrees that are sessions at this threshold come out.  Other columns of
    ``events`` don't matter.  An empty table gives an empty tree.
    """
    kind = events.schema[entity].dataType.simpleString()
    schema = f"`{entity}` {kind}, start_ts bigint, end_ts bigint, n_events bigint, gap bigint, parent_gap bigint"
    rows = in_order(events.select(F.col(entity), F.col(time).cast("bigint").alias("_time")), entity, "_time").sortWithinPartitions(entity, "_time")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for name, pdf, first, last in by_entity(batches, entity):
            held.append(_chunk(name, pdf["_time"].to_numpy(dtype=np.int64), first or last, entity, cut))
            n += len(held[-1])
            if n > 50_000:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ts", "chunk"], kind="stable")
        start, end, count = (pdf[c].to_numpy(dtype=np.int64) for c in ("start_ts", "end_ts", "n_events"))
        out = pd.DataFrame(subtrees(start, end, count, OPEN, OPEN, pdf["gap"].to_numpy() == 1), columns=_OUT[:5])
        if cut is not None:
            out = out[(out["gap"] <= cut) & (out["parent_gap"] > cut)]
        out.insert(0, entity, pdf[entity].iloc[0])
        return out.assign(chunk=0)

    scanned = rows.mapInPandas(scan, schema + ", chunk bigint, open boolean")
    return stitch(scanned, entity, join, schema + ", chunk bigint").drop("chunk")


def cut_tree(tree: DataFrame, gap: int) -> DataFrame:
    """Sessions at one gap setting: subtrees within it whose parent is beyond it.  A gap equal to the setting is no cut."""
    within = tree.where((F.col("gap") <= gap) & (F.col("parent_gap") > gap))
    return within.select(*[c for c in tree.columns if c not in ("gap", "parent_gap")], (F.col("end_ts") - F.col("start_ts")).alias("duration"))


def sessions(events: DataFrame, entity: str, time: str, gap: int = 1800) -> DataFrame:
    """(entity, start_ts, end_ts, n_events, duration) of each session, also those of one event."""
    return cut_tree(gap_tree(events, entity, time, gap), gap)


def assign_sessions(events: DataFrame, entity: str, time: str, gap: int = 1800, tie: str | None = None, chunk: int = 86_400) -> DataFrame:
    """``events`` with ``session_start``, the time of the first event of each row's session, by built-in expressions only.

    Windows run over an entity's days, so that a hot entity is many small
    groups; what a day takes over from the days before comes from a table of
    one row per entity and day.  Rows without entity or time are left out.
    """
    order = [time, *([tie] if tie else [])]
    day = (F.col(time) / chunk).cast("bigint")
    w = Window.partitionBy(entity, "_day").orderBy(*order)
    rows = events.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).withColumn("_day", day).withColumn("_before", F.lag(time).over(w))
    over_days = Window.partitionBy(entity).orderBy("_day")
    ends = rows.groupBy(entity, "_day").agg(F.max(time).alias("_end")).select(entity, "_day", F.lag("_end").over(over_days).alias("_day_before"))
    before = F.coalesce("_before", "_day_before")
    begun = rows.join(ends, [entity, "_day"]).withColumn("_new", F.when(before.isNull() | (F.col(time) - before > gap), F.col(time)))
    begun = begun.withColumn("_start", F.last("_new", ignorenulls=True).over(Window.partitionBy(entity, "_day").orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    carried = begun.groupBy(entity, "_day").agg(F.max("_new").alias("_s")).select(entity, "_day", F.last("_s", ignorenulls=True).over(over_days.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    joined = begun.join(carried, [entity, "_day"])
    return joined.withColumn("session_start", F.coalesce("_start", "_carried")).drop("_day", "_before", "_day_before", "_new", "_start", "_carried")


def session_stats(events: DataFrame, entity: str, time: str, gap: int = 1800) -> DataFrame:
    """Per entity: sessions, mean and median plays, artists and minutes of a session, sessions of one play, of several artists."""
    each = assign_sessions(events, entity, time, gap).groupBy(entity, "session_start").agg(F.count("*").alias("n"), F.countDistinct("artist").alias("a"), ((F.max(time) - F.min(time)) / 60).alias("m"))
    return each.groupBy(entity).agg(
        F.count("*").alias("sessions"), F.round(F.avg("n"), 4).alias("mean_plays"), F.round(F.median("n"), 4).alias("median_plays"), F.round(F.avg("a"), 4).alias("mean_artists"), F.round(F.median("a"), 4).alias("median_artists"),
        F.round(F.avg("m"), 4).alias("mean_minutes"), F.round(F.median("m"), 4).alias("median_minutes"), F.count_if(F.col("n") == 1).alias("single_play"), F.count_if(F.col("a") > 1).alias("multi_artist"),
    )


def transitions(plays: DataFrame, entity: str, gap: int = 1800, least: int = 2) -> DataFrame:
    """(from_artist, to_artist, n): how often one artist follows another within ``gap`` seconds; repeats of one artist, whatever its case, don't count.

    Neighbours within the gap are of one session, so windows run over sessions, not over all an entity's plays.
    """
    w = Window.partitionBy(entity, "session_start").orderBy("uts", "play_id")
    after = assign_sessions(plays, entity, "uts", gap, "play_id").withColumn("to_artist", F.lead("artist").over(w))
    moved = after.where(F.lower("artist") != F.lower("to_artist"))
    return moved.groupBy(entity, F.col("artist").alias("from_artist"), "to_artist").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def discovery_context(plays: DataFrame, entity: str, gap: int = 1800) -> DataFrame:
    """Per artist: when it was first played, and the other artists of that session in the order of names."""
    named = assign_sessions(plays, entity, "uts", gap, "play_id")
    starts = named.where("artist <> ''").groupBy(entity, "artist").agg(F.min(F.struct("uts", "play_id", "session_start")).alias("f")).select(entity, "artist", F.col("f.uts").alias("first_uts"), F.col("f.session_start").alias("session_start"))
    company = named.where("artist <> ''").groupBy(entity, "session_start").agg(F.collect_set("artist").alias("others"))
    return starts.join(company, [entity, "session_start"]).select(entity, "artist", "first_uts", F.array_join(F.array_sort(F.array_remove("others", F.col("artist"))), "|").alias("others"))

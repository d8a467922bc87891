"""Exact segmentation of a listening history into stretches of alike months or weeks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.plans import with_facts

OTHER = "__OTHER__"


@dataclass(frozen=True)
class Segmentation:
    """How to segment: bins of a month or a week, so many artists by name, and the penalty's factor."""

    bins: str = "month"
    vocabulary: int = 20
    transform: str = "shares"
    least: int = 2
    penalty: float = 1.0

    def __post_init__(self):
        if self.bins not in ("month", "week") or self.transform not in ("shares", "counts") or self.vocabulary < 1 or self.least < 1 or not np.isfinite(self.penalty):
            raise ValueError("bins are month or week, the transform shares or counts, sizes at least 1, the penalty finite")


def bin_start(kind: str) -> Column:
    """The first day of a row's month, or its Monday."""
    return F.to_date(F.date_trunc(kind, "ts"))


def escaped(name: Column) -> Column:
    """Names that could be taken for the bucket of others get a backslash, and so do those that begin with one."""
    return F.when(name.startswith("\\") | (name == OTHER), F.concat(F.lit("\\"), name)).otherwise(name)


def bin_counts(plays: DataFrame, by: list[str], spec: Segmentation) -> DataFrame:
    """(…, bin, artist, n): counts per bin of the first artists, the others as one; zero where a bin has none."""
    rows = plays.select(*by, bin_start(spec.bins).alias("bin"), F.coalesce("artist", F.lit("")).alias("artist"))
    counted = rows.groupBy(*by, "bin", "artist").agg(F.count("*").alias("n"))
    totals = counted.groupBy(*by, "artist").agg(F.sum("n").alias("t"))
    known = totals.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"), "artist"))).where(F.col("k") <= spec.vocabulary)
    named = counted.join(known.select(*by, "artist", "k"), [*by, "artist"], "left").select(*by, "bin", F.when(F.col("k").isNull(), OTHER).otherwise(escaped(F.col("artist"))).alias("artist"), "n")
    step = F.expr("interval 1 month" if spec.bins == "month" else "interval 7 days")
    spine = rows.groupBy(*by).agg(F.min("bin").alias("a"), F.max("bin").alias("z")).select(*by, F.explode(F.sequence("a", "z", step)).alias("bin"))
    words = known.select(*by, escaped(F.col("artist")).alias("artist")).unionByName(known.select(*by).distinct().withColumn("artist", F.lit(OTHER)))
    # an owner's words are no more than the vocabulary and one
    grid = with_facts(spine, words.groupBy(*by).agg(F.collect_list("artist").alias("_words")), by).select(*by, "bin", F.explode("_words").alias("artist"))
    return grid.join(named.groupBy(*by, "bin", "artist").agg(F.sum("n").alias("n")), [*by, "bin", "artist"], "left").select(*by, F.col("bin").cast("string").alias("bin"), "artist", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def share_vectors(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts as square roots of shares; empty bins stay 0."""
    total = F.sum("n").over(Window.partitionBy(*by, "bin"))
    return counts.withColumn("value", F.when(total > 0, F.sqrt(F.col("n") / total)).otherwise(0.0)).select(*by, "bin", "artist", "value")


def transformed(counts: np.ndarray, how: str) -> np.ndarray:
    """Rows of counts as vectors: roots of shares, or standardised logarithms (a constant column is 0)."""
    if how == "shares":
        total = counts.sum(axis=1, keepdims=True)
        return np.sqrt(np.divide(counts, total, out=np.zeros(counts.shape), where=total > 0))
    logs = np.log1p(counts.astype(float))
    spread = logs.std(axis=0)
    return np.divide(logs - logs.mean(axis=0), spread, out=np.zeros(logs.shape), where=spread > 1e-12)


def best_cuts(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Where to cut rows so that squared distances to the segments' means plus a penalty for each cut are smallest.

    Exact: for every row that may begin a segment, from the last backwards,
    every end of it is tried; a row keeps only its cost, its cuts and where
    the next segment begins.  Of equal costs the fewer cuts win, then the
    earlier ones; costs are equal that differ by rounding only, measured on
    the spread of the rows themselves, whatever their scale.
    """
    n = len(x)
    x = x - x.mean(axis=0) if n else x
    sums, squares = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)]), np.concatenate([[0.0], np.cumsum((x * x).sum(axis=1))])
    slack = 1e-12 * (squares[n] + abs(penalty))
    cost, cuts, then = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64), np.full(n + 1, -1)
    cost[n] = 0.0
    for start in range(n - least, -1, -1):
        ends = np.arange(start + least, n + 1)
        part = sums[ends] - sums[start]
        inside = np.maximum(squares[ends] - squares[start] - (part * part).sum(axis=1) / (ends - start), 0.0)
        more = ends < n
        options, counts = inside + cost[ends] + penalty * more, cuts[ends] + more
        low = options.min()
        if not np.isfinite(low):
            continue
        near = np.flatnonzero(options <= low + slack)
        best = near[np.argmin(counts[near])]  # the first of them, so the earliest end
        cost[start], cuts[start], then[start] = options[best], counts[best], ends[best]
    out, at = [], then[0] if n else -1
    while 0 < at < n:
        out.append(int(at))
        at = then[at]
    return out


def noise(x: np.ndarray) -> float:
    """Variance of the noise: half the median squared step between neighbours for each dimension that varies, else the smallest positive one."""
    active = int((x.var(axis=0) > 0).sum()) if len(x) else 0
    steps = (np.diff(x, axis=0) ** 2).sum(axis=1) / (2 * max(1, active))
    mid = float(np.median(steps)) if len(steps) else 0.0
    positive = steps[steps > 0]
    return mid if mid > 0 else float(positive.min()) if len(positive) else 0.0


def change_points(plays: DataFrame, by: list[str], spec: Segmentation = Segmentation()) -> DataFrame:
    """(…, segment, first_bin, last_bin, bins, plays, distance): the segments of each owner's history, and how far each one's centre is from that before.

    Counting is distributed; the exact search runs per owner on a matrix of
    bins by vocabulary, whose size is the calendar's and not the log's.
    """
    counts = bin_counts(plays, by, spec)

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="bin", columns="artist", values="n", aggfunc="sum", fill_value=0).sort_index()
        x = transformed(wide.to_numpy(), spec.transform)
        active = 0 if np.allclose(x, x[0], atol=1e-12, rtol=0) else int((x.var(axis=0) > 0).sum())
        cuts = [] if not active or len(x) < 2 * spec.least else best_cuts(x, spec.penalty * noise(x) * active * np.log(len(x)), spec.least)
        edges = [0, *cuts, len(x)]
        total, bins = wide.sum(axis=1).to_numpy(), list(wide.index)
        parts = list(zip(edges, edges[1:], strict=False))
        centres = [x[a:b].mean(axis=0) for a, b in parts]
        away = [None, *(round(float(np.linalg.norm(q - p)), 10) for p, q in zip(centres, centres[1:], strict=False))]
        rows = [(k, bins[a], bins[b - 1], b - a, int(total[a:b].sum()), away[k]) for k, (a, b) in enumerate(parts)]
        out = pd.DataFrame(rows, columns=["segment", "first_bin", "last_bin", "bins", "plays", "distance"])
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    kinds = "".join(f"`{c}` {counts.schema[c].dataType.simpleString()}, " for c in by)
    return counts.groupBy(*by).applyInPandas(segment, kinds + "segment bigint, first_bin string, last_bin string, bins bigint, plays bigint, distance double")


def segment_artists(plays: DataFrame, by: list[str], spec: Segmentation, segments: DataFrame) -> DataFrame:
    """(…, segment, artist, n, share): plays of each artist of the vocabulary in each segment and their share of it, zeros included."""
    inside = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    counts = bin_counts(plays, by, spec).alias("c")
    met = counts.join(segments.alias("s"), [*inside, F.col("c.bin") >= F.col("s.first_bin"), F.col("c.bin") <= F.col("s.last_bin")])
    each = met.groupBy(*[F.col(f"c.{c}").alias(c) for c in by], "segment", "artist").agg(F.sum("n").alias("n"))
    return each.withColumn("share", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(*by, "segment"))), F.lit(0.0)))


def _names(rows: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(F.sort_array(rows), 1, n), lambda r: F.concat_ws(":", r["artist"], F.round(r["v"], 6).cast("string"))), "|")


def segment_report(plays: DataFrame, by: list[str], spec: Segmentation, segments: DataFrame, most: int = 5) -> DataFrame:
    """Per segment, beside bins and plays: plays per bin, distinct artists (a blank name is one), empty bins, first artists with their shares."""
    bins = plays.select(*by, bin_start(spec.bins).cast("string").alias("bin"), F.coalesce("artist", F.lit("")).alias("artist")).distinct()
    inside = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    met = bins.alias("b").join(segments.alias("s"), [*inside, F.col("b.bin") >= F.col("s.first_bin"), F.col("b.bin") <= F.col("s.last_bin")])
    own = met.groupBy(*[F.col(f"s.{c}").alias(c) for c in by], "segment").agg(F.countDistinct("b.artist").alias("unique_artists"), F.countDistinct("b.bin").alias("full_bins"))
    row = F.when(F.col("share") > 0, F.struct((-F.col("share")).alias("k"), "artist", F.col("share").alias("v")))
    tops = segment_artists(plays, by, spec, segments).groupBy(*by, "segment").agg(_names(F.collect_list(row), most).alias("top_shares"))
    out = segments.join(own, [*by, "segment"], "left").join(tops, [*by, "segment"], "left")
    rate = F.round(F.col("plays") / F.col("bins"), 6).alias("plays_per_bin")
    return out.select(*by, "segment", "first_bin", "last_bin", "bins", "plays", rate, F.coalesce("unique_artists", F.lit(0)).alias("unique_artists"), (F.col("bins") - F.coalesce("full_bins", F.lit(0))).alias("empty_bins"), "top_shares")


def change_report(plays: DataFrame, by: list[str], spec: Segmentation, segments: DataFrame, most: int = 5) -> DataFrame:
    """Per change: the bin where the new segment begins, the distance of the centres, the change of plays per bin, and the artists whose shares change most."""
    w = Window.partitionBy(*by).orderBy("segment")
    rate = F.col("plays") / F.col("bins")
    changes = segments.withColumn("rate_change", F.round(rate - F.lag(rate).over(w), 6)).where("segment > 0")
    each = segment_artists(plays, by, spec, segments)
    moved = each.withColumn("d", F.col("share") - F.lag("share").over(Window.partitionBy(*by, "artist").orderBy("segment"))).where("abs(d) > 1e-15")
    row = F.struct((-F.abs("d")).alias("k"), "artist", F.col("d").alias("v"))
    tops = moved.groupBy(*by, "segment").agg(_names(F.collect_list(row), most).alias("top_changes"))
    out = changes.join(tops, [*by, "segment"], "left")
    return out.select(*by, F.col("segment").alias("change"), F.col("first_bin").alias("bin"), "distance", "rate_change", F.coalesce("top_changes", F.lit("")).alias("top_changes"))

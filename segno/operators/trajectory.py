"""Artists over months and years: timelines, peaks, dormancy, observation and cohort retention.

Periods are whole numbers (year * 12 + month - 1, or the year), so that
distances are differences.  Artists are caseless.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.plans import with_facts

#: How a bound of each grain is written.
BOUNDS = {"month": r"(\d{4})-(0[1-9]|1[0-2])", "year": r"(\d{4})"}


def period_of(grain: str, ts: str = "ts") -> Column:
    if grain not in BOUNDS:
        raise ValueError("a grain is month or year")
    index = F.year(ts) * 12 + F.month(ts) - 1 if grain == "month" else F.year(ts)
    return index.cast("bigint")


def period_name(index: Column, grain: str) -> Column:
    return F.format_string("%04d", index) if grain == "year" else F.format_string("%04d-%02d", (index / 12).cast("int"), (index % 12 + 1).cast("int"))


def bound(text: str, grain: str) -> int:
    """A written month or year as a period; anything else is an error."""
    m = re.fullmatch(BOUNDS[grain], text) if grain in BOUNDS else None
    if m is None:
        raise ValueError(f"{text!r} is no {grain}")
    return int(m[1]) * 12 + int(m[2]) - 1 if grain == "month" else int(m[1])


def window(plays: DataFrame, grain: str, start: str | None = None, end: str | None = None) -> tuple[int, int]:
    """First and last period asked for, by default those of the log; both included."""
    low, high = (None if b is None else bound(b, grain) for b in (start, end))
    if low is None or high is None:
        first, last = plays.agg(F.min(period_of(grain)), F.max(period_of(grain))).first()
        low, high = first if low is None else low, last if high is None else high
    if low is None or high is None or low > high:
        raise ValueError("the window has no period")
    return low, high


def validated_history(plays: DataFrame) -> DataFrame:
    """``plays`` with null artists as ""; without its columns, a row or a time in some row, an error."""
    lacking = {"ts", "artist"} - set(plays.columns)
    if lacking:
        raise ValueError(f"a history needs {sorted(lacking)}")
    rows, timed = plays.agg(F.count(F.lit(1)), F.count("ts")).first()
    if not rows or timed < rows:
        raise ValueError("the history is empty" if not rows else "the history has rows without a time")
    return plays.withColumn("artist", F.coalesce("artist", F.lit("")))


def counts_by_period(plays: DataFrame, by: list[str], grain: str = "month") -> DataFrame:
    """(…, key, period, n, first_uts, last_uts) of artists that aren't blank."""
    rows = plays.where("trim(artist) <> ''").select(*by, F.lower("artist").alias("key"), period_of(grain).alias("period"), "uts")
    return rows.groupBy(*by, "key", "period").agg(F.count("*").alias("n"), F.min("uts").alias("first_uts"), F.max("uts").alias("last_uts"))


def display_names(plays: DataFrame, by: list[str]) -> DataFrame:
    """(…, key, shown): the most frequent spelling of a caseless name, the first in order on ties."""
    each = plays.where("trim(artist) <> ''").groupBy(*by, F.lower("artist").alias("key"), "artist").agg(F.count("*").alias("n"))
    return each.groupBy(*by, "key").agg(F.min(F.struct((-F.col("n")).alias("k"), "artist"))["artist"].alias("shown"))


def timeline(plays: DataFrame, by: list[str], keys: DataFrame, low: int, high: int, active: int = 1, grain: str = "month") -> DataFrame:
    """(…, key, month or year, period, plays, active, first_uts, last_uts): every period of a window for the given artists, zero-filled."""
    spine = keys.select(*by, "key").distinct().withColumn("period", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("period", F.col("period").cast("bigint"))
    counted = counts_by_period(plays, by, grain).where(F.col("period").between(low, high))
    out = spine.join(counted, [*by, "key", "period"], "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return out.select(*by, "key", period_name(F.col("period"), grain).alias(grain), "period", n.alias("plays"), (n >= active).alias("active"), "first_uts", "last_uts")


def trajectories(plays: DataFrame, by: list[str], names: list[str], low: int, high: int, active: int = 1, grain: str = "month") -> DataFrame:
    """For each owner and asked name, in the order asked: status ok or not_found, the name shown, plays and active periods in the window.

    A name is found if the whole log has it, also without plays in the
    window.  Every owner has a row for each name.
    """
    if not names or not all(isinstance(x, str) and x for x in names):
        raise ValueError("names are asked for, none of them empty")
    owners = plays.select(*by).distinct() if by else plays.sparkSession.range(1).select()
    asked = F.array(*[F.struct(F.lit(k).cast("bigint").alias("ordinal"), F.lit(x).alias("asked"), F.lit(x.lower()).alias("key")) for k, x in enumerate(names)])
    wanted = owners.select(*by, F.explode(asked).alias("q")).select(*by, "q.*")
    shown = display_names(plays.where(F.lower("artist").isin([x.lower() for x in names])), by)
    sums = counts_by_period(plays, by, grain).where(F.col("period").between(low, high) & F.col("key").isin([x.lower() for x in names]))
    sums = sums.groupBy(*by, "key").agg(F.sum("n").alias("plays"), F.count_if(F.col("n") >= active).alias("active_periods"))
    out = wanted.join(shown, [*by, "key"], "left").join(sums, [*by, "key"], "left")
    status = F.when(F.col("shown").isNull(), "not_found").otherwise("ok")
    return out.select(*by, "ordinal", "asked", status.alias("status"), "shown", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("active_periods", F.lit(0)).alias("active_periods"))


def summary(line: DataFrame, by: list[str]) -> DataFrame:
    """Per artist of a timeline: plays, active periods and their share, span from first to last active, share of it that is active, times of the first and last play."""
    first, last = F.min(F.when(F.col("active"), F.col("period"))), F.max(F.when(F.col("active"), F.col("period")))
    out = line.groupBy(*by, "key").agg(
        F.sum("plays").alias("plays"), F.count_if("active").alias("active_periods"), F.count("*").alias("periods"), first.alias("f"), last.alias("l"), F.min("first_uts").alias("first_uts"), F.max("last_uts").alias("last_uts")
    )
    span = F.coalesce(F.col("l") - F.col("f") + 1, F.lit(0))
    return out.select(
        *by, "key", "plays", "periods", "active_periods", F.round(F.col("active_periods") / F.col("periods"), 6).alias("active_share"), span.cast("bigint").alias("span"),
        F.round(F.when(span > 0, F.col("active_periods") / span), 6).alias("span_share"), "first_uts", "last_uts",
    )


def observation(line: DataFrame, plays: DataFrame, by: list[str], low: int, high: int, grain: str = "month") -> DataFrame:
    """Per artist of a timeline what the window lets be seen: whether the log goes on before and after it, and inactive periods at its ends."""
    source = plays.groupBy(*by).agg(F.min(period_of(grain)).alias("source_start"), F.max(period_of(grain)).alias("source_end"))
    first, last = F.min(F.when(F.col("active"), F.col("period"))), F.max(F.when(F.col("active"), F.col("period")))
    ends = line.groupBy(*by, "key").agg(first.alias("f"), last.alias("l"))
    out = with_facts(ends, source, by)
    n = high - low + 1
    return out.select(
        *by, "key", "source_start", "source_end", (F.col("source_start") < low).alias("left_truncated"), (F.col("source_end") > high).alias("right_truncated"), (F.col("source_end") <= high).alias("right_censored"),
        F.coalesce(F.col("f") - low, F.lit(n)).cast("bigint").alias("leading_inactive"), F.coalesce(high - F.col("l"), F.lit(n)).cast("bigint").alias("trailing_inactive"),
    )


def peak_and_ramp(line: DataFrame, by: list[str], grain: str = "month") -> DataFrame:
    """All periods of the most plays, the earliest as peak, and the way there from the first active one: distance, change, mean change a period, slope (null for one period)."""
    w = Window.partitionBy(*by, "key")
    marked = line.withColumns({"top": F.max("plays").over(w), "first": F.min(F.when(F.col("active"), F.col("period"))).over(w)}).where("top > 0")
    marked = marked.withColumn("peak", F.min(F.when(F.col("plays") == F.col("top"), F.col("period"))).over(w))
    way = lambda c: F.when(F.col("period").between(F.col("first"), F.col("peak")), c)
    tied = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("plays") == F.col("top"), F.col("period")))), lambda p: period_name(p, grain)), ",")
    out = marked.groupBy(*by, "key").agg(
        F.max("top").alias("peak_plays"), F.max("peak").alias("peak_period"), tied.alias("peak_periods"), F.max("first").alias("first_period"), F.max(F.col("peak") - F.col("first")).alias("distance"),
        F.max(F.when(F.col("period") == F.col("first"), F.col("plays"))).alias("first_plays"), F.regr_slope(way(F.col("plays").cast("double")), way(F.col("period").cast("double"))).alias("s"),
    )
    change = F.col("peak_plays") - F.col("first_plays")
    on_way = lambda c: F.round(F.when(F.col("distance") > 0, c), 6)
    return out.select(*by, "key", "peak_plays", "peak_period", "peak_periods", "first_period", "first_plays", "distance", change.alias("change"), on_way(change / F.col("distance")).alias("mean_change"), on_way(F.col("s")).alias("slope"))


def dormancy(line: DataFrame, by: list[str], least: int) -> DataFrame:
    """Gaps of at least ``least`` inactive periods between active ones: their ends, where the return is, its plays, and plays of 3 and 6 periods from it (and whether those are all in the window)."""
    w = Window.partitionBy(*by, "key").orderBy("period")
    ahead = line.withColumns({"next3": F.sum("plays").over(w.rowsBetween(0, 2)), "next6": F.sum("plays").over(w.rowsBetween(0, 5)), "end": F.max("period").over(Window.partitionBy(*by, "key"))})
    back = ahead.where("active").withColumn("before", F.lag("period").over(w)).withColumn("gap", F.col("period") - F.col("before") - 1).where(F.col("gap") >= least)
    return back.select(
        *by, "key", "gap", (F.col("before") + 1).alias("start_period"), (F.col("period") - 1).alias("end_period"), F.col("period").alias("return_period"), F.col("plays").alias("return_plays"),
        "next3", (F.col("period") + 2 <= F.col("end")).alias("complete3"), "next6", (F.col("period") + 5 <= F.col("end")).alias("complete6"),
    )


def active_segments(line: DataFrame, by: list[str], least: int) -> DataFrame:
    """(…, key, segment, start_period, end_period, active_periods, plays): stretches of activity between the gaps of ``dormancy``, from 1."""
    w = Window.partitionBy(*by, "key").orderBy("period")
    begins = F.coalesce((F.col("period") - F.lag("period").over(w) - 1 >= least).cast("int"), F.lit(1))
    rows = line.where("active").withColumn("begins", begins).withColumn("segment", F.sum("begins").over(w).cast("bigint"))
    return rows.groupBy(*by, "key", "segment").agg(F.min("period").alias("start_period"), F.max("period").alias("end_period"), F.count("*").alias("active_periods"), F.sum("plays").alias("plays"))


def _members(plays: DataFrame, by: list[str], grain: str, activity: str, start: str | None, end: str | None, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bounds of each owner: low, high, fin; members: key, cohort, d, first_n; counts by activity period)."""
    n = counts_by_period(plays, by, activity)
    bounds = plays.groupBy(*by).agg(F.min(period_of(grain)).alias("_a"), F.max(period_of(grain)).alias("_z"), F.max(F.when(F.trim("artist") != "", period_of(activity))).alias("_fin"))
    low = F.col("_a") if start is None else F.lit(bound(start, grain))
    high = F.col("_z") if end is None else F.lit(bound(end, grain))
    asked_end = high if grain == activity else high * 12 + 11 if grain == "year" else F.floor(high / 12)
    bounds = bounds.select(*by, low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), F.least(asked_end, F.col("_fin")).cast("bigint").alias("fin"))
    first = n.groupBy(*by, "key").agg(F.min(F.struct("period", "n")).alias("f"), F.min("first_uts").alias("uts")).withColumn("ts", F.timestamp_seconds("uts"))
    members = first.select(*by, "key", period_of(grain).alias("cohort"), F.col("f.period").alias("d"), F.col("f.n").alias("first_n")).where(F.col("first_n") >= least)
    return bounds, members, n


def cohort_retention(
    plays: DataFrame, by: list[str], offsets: list[int], least: int = 1, active: int = 1, grain: str = "month", activity: str = "month", start: str | None = None, end: str | None = None
) -> DataFrame:
    """(…, cohort, offset, eligible, retained, rate): of artists discovered in a period, how many are played ``offset`` activity periods later.

    Artists are discovered at their first play of the whole log; members had
    ``least`` plays in that activity period; they are eligible where the later
    one isn't after the end of the window or of the log, and retained with
    ``active`` plays then.  Every cohort of the window has a row for every
    offset; the rate is null where none is eligible.
    """
    if not offsets or min(offsets) < 0 or least < 1 or active < 1:
        raise ValueError("offsets are asked for, none negative; plays are positive")
    bounds, members, n = _members(plays, by, grain, activity, start, end, least)
    each = F.explode(F.array(*[F.lit(k).cast("bigint") for k in sorted(set(offsets))])).alias("offset")
    spine = bounds.select(*by, F.explode(F.sequence("low", "high")).alias("cohort")).select("*", each)
    asked = with_facts(members.select("*", each), bounds, by).withColumn("period", F.col("d") + F.col("offset")).where("period <= fin")
    met = asked.join(n.select(*by, "key", "period", "n"), [*by, "key", "period"], "left")
    cells = met.groupBy(*by, "cohort", "offset").agg(F.count("*").alias("eligible"), F.count_if(F.coalesce("n", F.lit(0)) >= active).alias("retained"))
    out = spine.join(cells, [*by, "cohort", "offset"], "left").fillna(0, ["eligible", "retained"])
    return out.select(*by, period_name(F.col("cohort"), grain).alias("cohort"), "offset", "eligible", "retained", F.round(F.try_divide(F.col("retained").cast("double"), F.col("eligible")), 6).alias("rate"))


def cohort_summary(plays: DataFrame, by: list[str], least: int = 1, active: int = 1, grain: str = "month", activity: str = "month", start: str | None = None, end: str | None = None) -> DataFrame:
    """(…, cohort, size, mean_first, median_first, later, later_rate): members of each cohort, their plays in the first activity period, and how many were active in any later one."""
    bounds, members, n = _members(plays, by, grain, activity, start, end, least)
    spine = bounds.select(*by, F.explode(F.sequence("low", "high")).alias("cohort"))
    last = n.where(F.col("n") >= active).select(*by, "key", "period")
    within = with_facts(members, bounds, by).join(last, [*by, "key"], "left")
    came_back = within.groupBy(*by, "key", "cohort", "first_n").agg(F.coalesce(F.max((F.col("period") > F.col("d")) & (F.col("period") <= F.col("fin"))), F.lit(False)).alias("later"))
    sums = came_back.groupBy(*by, "cohort").agg(F.count("*").alias("size"), F.round(F.avg("first_n"), 6).alias("mean_first"), F.round(F.median("first_n"), 6).alias("median_first"), F.count_if("later").alias("later"))
    out = spine.join(sums, [*by, "cohort"], "left").fillna(0, ["size", "later"])
    return out.select(*by, period_name(F.col("cohort"), grain).alias("cohort"), "size", "mean_first", "median_first", "later", F.round(F.try_divide(F.col("later").cast("double"), F.col("size")), 6).alias("later_rate"))

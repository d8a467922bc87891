"""Before, during and after an event, on a local calendar."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.functions.text import filled, joined_first

#: What is compared: an artist, or an album or track of one.
ENTITIES = ("artist", "album", "track")
#: Periods that are compared with one another.
COMPARED = ("baseline", "pre", "event", "post")


@dataclass(frozen=True)
class EventWindow:
    """An event's first day, and the days of each part around it; all on the calendar of ``zone``."""

    day: date
    days: int = 1
    before: int = 30
    after: int = 30
    baseline: int = 90
    zone: str = "UTC"
    top_n: int = 10

    def __post_init__(self):
        if min(self.days, self.before, self.after, self.baseline, self.top_n) < 1:
            raise ValueError("every part needs a day at least, and a top of at least one")
        ZoneInfo(self.zone)


def _utc(day: date, zone: ZoneInfo) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=zone).astimezone(timezone.utc).timestamp())


def intervals(spec: EventWindow, low: int | None = None, high: int | None = None) -> list[tuple[str, int, int, int, int]]:
    """(period, start, end, days there are, days covered) of the adjacent half-open intervals, in epoch seconds.

    Days that the zone's calendar skips don't exist.  With the first and last
    time of a log, intervals are clipped to its days; a part without a covered
    day has start = end.  A part without a day, or an event not covered, is an
    error.
    """
    zone, at, out = ZoneInfo(spec.zone), spec.day - timedelta(spec.before + spec.baseline), []
    parts = [("baseline_before", spec.baseline), ("pre", spec.before), ("event", spec.days), ("post", spec.after), ("baseline_after", spec.baseline)]
    first = datetime.fromtimestamp(low, zone).date() if low is not None else date.min
    last = datetime.fromtimestamp(high, zone).date() if high is not None else date.max
    for name, n in parts:
        days = [at + timedelta(k) for k in range(n)]
        real = [x for x in days if _utc(x + timedelta(1), zone) > _utc(x, zone)]
        held = [x for x in real if first <= x <= last]
        if not real or (name == "event" and not held):
            raise ValueError(f"{name} has no day" if not real else "the log doesn't cover the event")
        start, end = (_utc(held[0], zone), _utc(held[-1] + timedelta(1), zone)) if held else (0, 0)
        out.append((name, start, end, len(real), len(held)))
        at += timedelta(n)
    return out


def covered_intervals(plays: DataFrame, spec: EventWindow) -> list[tuple[str, int, int, int, int]]:
    """``intervals`` clipped to the days of a log; one aggregate of it."""
    low, high = plays.agg(F.min("uts"), F.max("uts")).first()
    if low is None:
        raise ValueError("the log is empty")
    return intervals(spec, low, high)


def periods(plays: DataFrame, parts: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """Plays with the ``period`` they lie in; both baselines are also "baseline".  Range predicates reach the scan."""
    held = [(n, s, e) for n, s, e, *_ in parts if e > s]
    inside = plays.where((F.col("uts") >= min(s for _, s, _ in held)) & (F.col("uts") < max(e for *_, e in held)))
    names = F.lit(None).cast("array<string>")
    for name, start, end in held:
        also = [name, "baseline"] if name.startswith("baseline") else [name]
        names = F.when((F.col("uts") >= start) & (F.col("uts") < end), F.array(*map(F.lit, also))).otherwise(names)
    return inside.withColumn("period", F.explode(names))


def _days(parts: list[tuple[str, int, int, int, int]], k: int) -> dict[str, int]:
    """Days of each period, there are (3) or covered (4)."""
    days = {p[0]: p[k] for p in parts}
    return {**days, "baseline": days["baseline_before"] + days["baseline_after"]}


def entity_key(entity: str) -> list[Column]:
    """The columns that make an artist, or an album or track of one; blank names make none."""
    if entity not in ENTITIES:
        raise ValueError("an entity is an artist, an album or a track")
    return [filled("artist").alias("artist"), *([] if entity == "artist" else [filled(entity).alias(entity)])]


def _keyed(plays: DataFrame, by: list[str], entity: str, *also: str) -> DataFrame:
    names = ["artist", *([] if entity == "artist" else [entity])]
    return plays.select(*by, *entity_key(entity), *also).dropna(subset=names)


def period_stats(plays: DataFrame, by: list[str], parts: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """Per owner and period with plays: plays, artists, albums, tracks, days covered, plays per covered day."""
    per = F.create_map(*[F.lit(x) for pair in _days(parts, 4).items() for x in pair])[F.col("period")]
    named = periods(plays, parts).select(*by, "period", filled("artist").alias("a"), filled("album").alias("b"), filled("track").alias("t"))
    pair = lambda c: F.when(F.col("a").isNotNull() & F.col(c).isNotNull(), F.struct("a", c))
    out = named.groupBy(*by, "period").agg(F.count("*").alias("plays"), F.countDistinct("a").alias("artists"), F.countDistinct(pair("b")).alias("albums"), F.countDistinct(pair("t")).alias("tracks"))
    return out.withColumns({"days": per.cast("bigint"), "per_day": F.round(F.try_divide(F.col("plays").cast("double"), per.cast("double")), 6)})


def _counted(plays: DataFrame, by: list[str], parts: list[tuple[str, int, int, int, int]], entity: str) -> DataFrame:
    """(…, period, key columns, n, share of all the period's plays, k its place)."""
    rows = periods(plays, parts)
    names = ["artist", *([] if entity == "artist" else [entity])]
    all_plays = rows.groupBy(*by, "period").agg(F.count("*").alias("of"))
    each = _keyed(rows, by, entity, "period").groupBy(*by, "period", *names).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by, "period").orderBy(F.desc("n"), *names))
    return each.join(all_plays, [*by, "period"]).select(*by, "period", *names, "n", F.round(F.col("n") / F.col("of"), 10).alias("share"), place.alias("k"))


def period_tops(plays: DataFrame, by: list[str], parts: list[tuple[str, int, int, int, int]], top_n: int, entity: str = "artist") -> DataFrame:
    """Per owner and period: how many entities there are, and the first ``top_n`` of them with their counts, joined by bars."""
    names = ["artist", *([] if entity == "artist" else [entity])]
    text = F.concat_ws(":", F.concat_ws(" - ", *names), F.col("n").cast("string"))
    return _counted(plays, by, parts, entity).groupBy(*by, "period").agg(F.count("*").alias("entities"), F.least(F.count("*"), F.lit(top_n)).alias("returned"), joined_first(top_n, "k", text).alias("tops"))


def compare(plays: DataFrame, by: list[str], parts: list[tuple[str, int, int, int, int]], top_n: int, entity: str = "artist") -> DataFrame:
    """Entities among the first ``top_n`` of baseline, pre, event or post: counts, shares, what the baseline lets expect, residuals, change, and whether the event has their first play ever.

    Shares are of all plays of the period, also those without a name.  The
    expectation of a period is the baseline's plays per day times its days;
    the residual (observed - expected) / sqrt(expected) is null where nothing
    is expected, both are where the baseline has no day.  ``place`` orders by
    the change of share from pre to post, then plays in post, then names.
    """
    days = _days(parts, 4)
    names = ["artist", *([] if entity == "artist" else [entity])]
    counted = _counted(plays, by, parts, entity).where(F.col("period").isin(*COMPARED))
    of = lambda p, c: F.coalesce(F.max(F.when(F.col("period") == p, F.col(c))), F.lit(0))
    wide = counted.groupBy(*by, *names).agg(F.min("k").alias("best"), *[of(p, "n").cast("bigint").alias(f"{p}_plays") for p in COMPARED], *[of(p, "share").alias(f"{p}_share") for p in COMPARED])
    event = next((s, e) for n, s, e, *_ in parts if n == "event")
    first = _keyed(plays.where(F.col("uts").isNotNull()), by, entity, "uts").groupBy(*by, *names).agg(F.min("uts").alias("_first"))
    wide = wide.where(F.col("best") <= top_n).join(first, [*by, *names])
    known = bool(days["baseline"])
    expected = {p: F.col("baseline_plays") * (days[p] / days["baseline"]) if known else F.lit(None).cast("double") for p in COMPARED[1:]}
    residual = {p: F.when(e > 0, (F.col(f"{p}_plays") - e) / F.sqrt(e)) for p, e in expected.items()}
    moved = F.round(F.col("post_share") - F.col("pre_share"), 10)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(moved).desc(), F.desc("post_plays"), *names))
    return wide.select(
        *by, *names, place.cast("bigint").alias("place"), *[f"{p}_plays" for p in COMPARED], *[F.round(f"{p}_share", 6).alias(f"{p}_share") for p in COMPARED],
        *[F.round(e, 6).alias(f"{p}_expected") for p, e in expected.items()], *[F.round(r, 6).alias(f"{p}_residual") for p, r in residual.items()],
        (F.col("post_plays") - F.col("pre_plays")).alias("change"), F.round(moved, 6).alias("share_change"),
        *[(F.col(f"{p}_plays") > 0).alias(f"in_{p}") for p in COMPARED], ((F.col("_first") >= event[0]) & (F.col("_first") < event[1])).alias("first_in_event"),
    )

"""Sessions over an unbounded stream of plays, in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_sessions(plays: DataFrame, entity: str, ts: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(entity, start_ts, end_ts, n_events) of sessions parted by more than ``gap``; a session is given out once nothing up to ``late`` behind can still join it.

    The state is one open session for each entity.  ``session_window`` ends a
    session ``gap`` after its last event and lets an event at that very moment
    join, as the batch operator does; the last event's time is kept beside it.
    """
    return (
        plays.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), entity)
        .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_events"))
        .select(entity, "start_ts", "end_ts", "n_events")
    )

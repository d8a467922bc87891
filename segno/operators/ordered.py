"""Scans over rows in the order of time, per entity, without a task per entity.

``in_order`` range-partitions rows by (entity, time): a hot entity is spread
over as many partitions as its share of the rows needs, and rows of one entity
and time stay together.  A scan then runs once per partition over sorted rows.
Only the first and the last entity of a partition may go on in a neighbour, so
what a scan can't finish is at most a few rows per partition; ``stitch`` brings
those together per entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.plans import durable


def in_order(df: DataFrame, entity: str, time: str, *, partitions: int | None = None) -> DataFrame:
    """Rows with an entity and a time, range-partitioned by both.  Rows without either have no place in an order and are left out."""
    known = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    keys = [F.col(entity), F.col(time)]
    return known.repartitionByRange(partitions, *keys) if partitions else known.repartitionByRange(*keys)


def by_entity(batches: Iterator[pd.DataFrame], entity: str) -> Iterator[tuple[str, pd.DataFrame, bool, bool]]:
    """(entity, its rows in this partition, first in the partition, last in the partition) for sorted batches."""
    held: list[pd.DataFrame] = []
    name, first = None, True

    def joined() -> pd.DataFrame:
        return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)

    for pdf in batches:
        if pdf.empty:
            continue
        names = pdf[entity].to_numpy()
        starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names[0] != names[-1] else [0, len(names)]
        for a, b in zip(starts, starts[1:], strict=False):
            if held and names[a] != name:
                yield name, joined(), first, False
                held, first = [], False
            name = names[a]
            held.append(pdf.iloc[a:b])
    if held:
        yield name, joined(), first, True


class Rows:
    """Collects tuples and hands them out as frames of a bounded size."""

    def __init__(self, columns: list[str], most: int = 50_000):
        self.columns, self.most, self.rows = columns, most, []

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=self.columns, dtype=object)
        self.rows = []
        return out


def stitch(scanned: DataFrame, entity: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What a scan finished, and what ``fn`` makes, per entity, of the rows that it left ``open``: a few for each partition, whatever the entity's size.

    The scan runs once: its rows, one for each finished part and not for each
    event, are written before the two kinds go different ways.
    """
    scanned = durable(scanned)
    finished, left = scanned.where("NOT open").drop("open"), scanned.where("open")
    return finished.unionByName(left.groupBy(entity).applyInPandas(fn, schema))

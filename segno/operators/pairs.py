"""Pairs of items in the same list, added up in the task before the shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs a task counts before it gives them out.
HELD_PAIRS = 500_000


def counted_pairs(lists: DataFrame, items: str) -> DataFrame:
    """(a, b, n), a < b: in how many of the lists both names are.  A list's repeated, null and only items make no pair."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[tuple[str, str]] = Counter()

        def given() -> pd.DataFrame:
            out = pd.DataFrame([(a, b, n) for (a, b), n in held.items()], columns=["a", "b", "n"])
            held.clear()
            return out

        for pdf in batches:
            for row in pdf["items"]:
                names = sorted({x for x in row if x is not None}) if row is not None else []
                for k, a in enumerate(names):
                    held.update((a, b) for b in names[k + 1 :])
                    if len(held) > HELD_PAIRS:
                        yield given()
        if held:
            yield given()

    counted = lists.select(F.col(items).alias("items")).mapInPandas(count, "a string, b string, n bigint")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))

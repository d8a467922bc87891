"""Similarity of strings by their longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per letter of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        met = row & places.get(ch, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for equal strings, down to 0: twice the common letters over all letters."""
    total = len(a) + len(b)
    return 100.0 * 2 * common_letters(a, b) / total if total else 100.0


def ratio_col(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return scored(a, b)

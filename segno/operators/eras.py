"""Eras of a listening history, and trends over its years; small series of one row per year."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.operators.counts import ranked, yearly
from segno.operators.evaluate import kendall


def ward(x: np.ndarray) -> list[list[list[int]]]:
    """Clusterings of rows from one cluster per row down to one: at each step the two whose joining adds least to the squared distances are joined."""
    groups = [[i] for i in range(len(x))]
    out = [[list(g) for g in groups]]
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(axis=0) - b.mean(axis=0)) ** 2).sum()
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, i, j)
        _, i, j = best
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        groups.sort(key=min)
        out.append([list(g) for g in groups])
    return out


def silhouette(x: np.ndarray, groups: list[list[int]]) -> float:
    """Mean over rows of (distance to the next cluster - distance within) / the larger; 0 for rows alone."""
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for g in groups:
        for i in g:
            if len(g) == 1:
                scores.append(0.0)
                continue
            inside = far[i, [j for j in g if j != i]].mean()
            outside = min(far[i, h].mean() for h in groups if h is not g)
            scores.append((outside - inside) / max(inside, outside) if max(inside, outside) else 0.0)
    return float(np.mean(scores))


def eras_of(counts: pd.DataFrame, most: int = 20) -> list[tuple[int, int]]:
    """(year, era): years grouped by what was played, over the first ``most`` artists of each year; eras count from 0 by their first year."""
    wide = counts.pivot_table(index="year", columns="artist", values="n", aggfunc="sum", fill_value=0).sort_index()
    first = set()
    for _, row in wide.iterrows():
        first |= {a for _, a in sorted((-n, a) for a, n in row.items() if n)[:most]}
    x = wide[sorted(first)].to_numpy(dtype=float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    years = list(wide.index)
    if len(years) < 3:
        return [(int(y), 0) for y in years]
    options = [g for g in ward(x) if 2 <= len(g) <= min(10, len(years) - 1)]
    best = max(options, key=lambda g: (round(silhouette(x, g), 12), -len(g)))
    return sorted((int(years[i]), k) for k, g in enumerate(sorted(best, key=min)) for i in g)


def eras(plays: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """(…, year, era) for each owner; counting is distributed, clustering runs on a row per year and its first artists."""
    counted = plays.where("artist <> ''").groupBy(*by, "year", "artist").agg(F.count("*").alias("n"))
    top = ranked(counted, [*by, "year"], [F.desc("n"), F.asc("artist")], most).select(*by, "artist").distinct()
    kept = counted.join(top, [*by, "artist"], "left_semi")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(eras_of(pdf, most), columns=["year", "era"])
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    kinds = "".join(f"`{c}` {plays.schema[c].dataType.simpleString()}, " for c in by)
    return kept.groupBy(*by).applyInPandas(group, kinds + "year bigint, era bigint")


def trends(plays: DataFrame, by: list[str]) -> DataFrame:
    """(…, measure, tau, p_value): Kendall's tau of plays, artists and concentration over the years."""
    table = yearly(plays, by).select(*by, "year", "plays", "artists", "top10_pct")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for measure in ("plays", "artists", "top10_pct"):
            tau, p = kendall(list(zip(pdf["year"].tolist(), pdf[measure].astype(float).tolist(), strict=True)))
            rows.append((measure, round(tau, 6), round(p, 6)))
        out = pd.DataFrame(rows, columns=["measure", "tau", "p_value"])
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    kinds = "".join(f"`{c}` {plays.schema[c].dataType.simpleString()}, " for c in by)
    return table.groupBy(*by).applyInPandas(test, kinds + "measure string, tau double, p_value double")

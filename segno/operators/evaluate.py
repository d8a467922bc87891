"""How good a ranking is: gain, hits, coverage, novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segno.operators.pairs import counted_pairs
from segno.plans import durable, small_or_shuffled, with_facts


def ndcg(ranked: DataFrame, by: list[str], k: int) -> DataFrame:
    """(…, ndcg): gain of the first ``k`` by ``place``, against the best order of those same ``k``; 0 where nothing is relevant."""
    first = ranked.where(F.col("place") <= k)
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance"), "place"))
    out = first.withColumn("_b", best).groupBy(*by).agg(F.sum(F.col("relevance") / F.log2(F.col("place") + 1)).alias("_gain"), F.sum(F.col("relevance") / F.log2(F.col("_b") + 1)).alias("_ideal"))
    return out.select(*by, F.round(F.coalesce(F.try_divide("_gain", "_ideal"), F.lit(0.0)), 6).alias("ndcg"))


def hits(ranked: DataFrame, by: list[str], k: int, thresholds: list[int]) -> DataFrame:
    """Items of the first ``k`` with at least each threshold of relevance."""
    return ranked.where(F.col("place") <= k).groupBy(*by).agg(*[F.count_if(F.col("relevance") >= t).alias(f"hits_{t}") for t in thresholds])


def coverage(ranked: DataFrame, by: list[str], item: str) -> DataFrame:
    """Distinct items, the share of the ten most frequent, and the Gini coefficient of their counts."""
    n = ranked.groupBy(*by, item).agg(F.count("*").alias("n"))
    up, down = Window.partitionBy(*by).orderBy("n", item), Window.partitionBy(*by).orderBy(F.desc("n"), item)
    rows = n.withColumns({"i": F.row_number().over(up), "k": F.row_number().over(down), "m": F.count("*").over(Window.partitionBy(*by))})
    total = F.sum("n")
    gini = (F.max("m") + 1 - 2 * F.sum((F.col("m") + 1 - F.col("i")) * F.col("n")) / total) / F.max("m")
    return rows.groupBy(*by).agg(F.count("*").alias("items"), F.round(F.sum(F.when(F.col("k") <= 10, F.col("n")).otherwise(0)) / total, 6).alias("top10_share"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini)), 6).alias("gini"))


def novelty(ranked: DataFrame, by: list[str], k: int) -> DataFrame:
    """Mean popularity of the first ``k`` against that of all."""
    out = ranked.groupBy(*by).agg(F.avg(F.when(F.col("place") <= k, F.col("popularity"))).alias("_a"), F.avg("popularity").alias("_b"))
    return out.select(*by, F.round("_a", 6).alias("top_popularity"), F.round("_b", 6).alias("popularity"), F.round(F.try_divide("_a", "_b"), 6).alias("ratio"))


def follow_through(ranked: DataFrame, by: list[str], thresholds: list[int]) -> DataFrame:
    """Recommended items and the shares that reach each threshold of later plays."""
    return ranked.groupBy(*by).agg(F.count("*").alias("items"), *[F.round(F.count_if(F.col("relevance") >= t) / F.count("*"), 6).alias(f"rate_{t}") for t in thresholds])


def continuation(baskets: DataFrame, session: list[str], item: str, near: DataFrame, ks: tuple[int, ...] = (10, 20, 50), least: int = 3) -> DataFrame:
    """In one row: sessions of ``least`` items, predictions, hits and hit rates among the first k neighbours, mean reciprocal rank.

    Every ordered pair of items of a session that have a neighbourhood in
    ``near`` (a, b, place) is a prediction of the one from the other; a target
    that isn't a neighbour has a reciprocal rank of 0.  Predictions are counted
    from the sizes of sessions, and hits from the number of sessions that two
    neighbours share.
    """
    return continuations(baskets, session, item, {"": near}, ks, least).drop("space")


def continuations(baskets: DataFrame, session: list[str], item: str, spaces: dict[str, DataFrame], ks: tuple[int, ...] = (10, 20, 50), least: int = 3) -> DataFrame:
    """``continuation`` in each of up to 31 spaces of neighbours, a row for each by its name, ``space``; sessions and their pairs are gone through once for all."""
    near = None
    for s, part in enumerate(spaces.values()):
        part = part.select(F.lit(s).alias("s"), "a", "b", "place")
        near = part if near is None else near.unionByName(part)
    near = durable(near)
    # a bit for each space that knows the item
    known = durable(near.groupBy(F.col("a").alias("i")).agg(F.bit_or(F.expr("shiftleft(1, s)")).alias("in")))
    knows = lambda bits, s: F.getbit(bits, s) == 1
    of_space = lambda s: F.size(F.filter("l", lambda x: knows(x["in"], F.lit(s)))).cast("bigint")
    held = baskets.dropna(subset=session).select(*session, F.col(item).alias("i")).join(small_or_shuffled(known), "i", "left")
    lists = held.groupBy(*session).agg(F.collect_set(F.struct("i", F.coalesce("in", F.lit(0)).alias("in"))).alias("l")).where(F.size("l") >= least)
    lists = durable(lists.select(F.filter("l", lambda x: x["in"] != 0).alias("l")).where("size(l) >= 2"))
    sizes = lists.select(*[of_space(s).alias(f"n{s}") for s in range(len(spaces))])
    base = sizes.agg(*[x for s in range(len(spaces)) for x in (F.count_if(F.col(f"n{s}") >= 2).alias(f"sessions{s}"), F.coalesce(F.sum(F.col(f"n{s}") * (F.col(f"n{s}") - 1)), F.lit(0)).alias(f"predictions{s}"))])
    together = counted_pairs(lists.select(F.col("l.i").alias("l")), "l").withColumnsRenamed({"a": "x", "b": "y"})
    told = near.join(small_or_shuffled(known.withColumnRenamed("i", "b")), "b").where(knows(F.col("in"), F.col("s")) & (F.col("a") != F.col("b")))
    told = told.select("s", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "place").join(together, ["x", "y"])
    of = lambda s, c: F.sum(F.when(F.col("s") == s, c))
    hit = told.agg(*[F.coalesce(of(s, F.when(F.col("place") <= k, F.col("n"))), F.lit(0)).alias(f"hits_{k}_{s}") for s in range(len(spaces)) for k in ks], *[F.coalesce(of(s, F.col("n") / F.col("place")), F.lit(0.0)).alias(f"r{s}") for s in range(len(spaces))])
    each = [F.struct(F.lit(name).alias("space"), F.col(f"sessions{s}").alias("sessions"), F.col(f"predictions{s}").alias("predictions"), *[F.col(f"hits_{k}_{s}").alias(f"hits_{k}") for k in ks], F.col(f"r{s}").alias("_r")) for s, name in enumerate(spaces)]
    out = with_facts(base, hit).select(F.inline(F.array(*each)))
    rate = lambda c: F.round(F.coalesce(F.try_divide(c.cast("double"), F.col("predictions")), F.lit(0.0)), 6)
    return out.select("space", "sessions", "predictions", *[f"hits_{k}" for k in ks], *[rate(F.col(f"hits_{k}")).alias(f"rate_{k}") for k in ks], rate(F.col("_r")).alias("mrr"))


def holdout(before: DataFrame, after: DataFrame, near: DataFrame, seed_plays: int = 10, k: int = 20) -> DataFrame:
    """In one row, whether neighbours foretell discoveries: discoveries, seeds, pool, predicted, baseline, rate, lift.

    ``before`` and ``after`` are the plays of two spans (an ``item`` each row);
    discoveries are items of the later one alone.  The pool is all items among
    the first ``k`` neighbours of an item of ``seed_plays`` plays before; the
    baseline is what a pool of this size would hit among all items of ``near``.
    """
    old = before.groupBy("item").agg(F.count("*").alias("n"))
    new = after.select("item").distinct().join(old.select("item"), "item", "left_anti")
    universe = near.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    seeds = old.where(F.col("n") >= seed_plays).select(F.col("item").alias("a"))
    pool = near.where(F.col("place") <= k).join(seeds, "a", "left_semi").select(F.col("b").alias("item")).distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(new, "discoveries")
    for df, name in ((seeds, "seeds"), (pool, "pool"), (universe, "universe"), (new.join(universe, "item", "left_semi"), "possible"), (new.join(pool, "item", "left_semi"), "predicted")):
        out = with_facts(out, one(df, name))
    expected = F.col("pool") * F.col("possible") / F.greatest("universe", F.lit(1))
    rate = F.round(F.coalesce(F.try_divide(F.col("predicted").cast("double"), F.col("discoveries")), F.lit(0.0)), 6)
    return out.select("discoveries", "seeds", "pool", "predicted", F.floor(expected).cast("bigint").alias("baseline"), rate.alias("rate"), F.round(F.try_divide(F.col("predicted").cast("double"), F.floor(expected)), 6).alias("lift"))


def compare_runs(runs: DataFrame, names: list[str]) -> DataFrame:
    """Saved runs (run, metric, value) side by side: a row for each metric, a column for each run asked for, null where a run has none; of repeated values the greatest."""
    return runs.groupBy("metric").pivot("run", names).agg(F.max("value"))


def exact_kendall_p(n: int, s: int) -> float:
    """The two-sided p-value of Kendall's S for ``n`` points without ties, from the numbers of orders with so many inversions."""
    ways = [1]
    for k in range(2, n + 1):
        ways = [sum(ways[max(0, i - k + 1) : i + 1]) for i in range(len(ways) + k - 1)]
    most = n * (n - 1) // 2
    fewer = (most - abs(s)) // 2  # inversions of the rarer side
    return min(1.0, 2 * sum(ways[: fewer + 1]) / sum(ways))


def kendall(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Kendall's tau-b and its two-sided p-value of a short series, such as a value per year: exact without ties up to 33 points, else normal."""
    import math
    from collections import Counter

    n = len(points)
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(points[j][0] - points[i][0]) * sign(points[j][1] - points[i][1]) for i in range(n) for j in range(i + 1, n))
    tx, ty = (Counter(p[k] for p in points).values() for k in (0, 1))
    pairs = n * (n - 1) / 2
    free = lambda t: pairs - sum(c * (c - 1) / 2 for c in t)
    base = math.sqrt(free(tx) * free(ty))
    if not base:
        return 0.0, 1.0
    if n <= 33 and max(tx) == max(ty) == 1:
        return s / base, exact_kendall_p(n, s)
    spread = n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for t in (tx, ty) for c in t)
    z = s / math.sqrt(spread / 18) if spread > 0 else 0.0
    return s / base, math.erfc(abs(z) / math.sqrt(2))

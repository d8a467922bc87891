"""Vectors of items: co-occurrence, spectral embedding, neighbours, diversity."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.operators.pairs import counted_pairs
from segno.plans import durable, small_or_shuffled

#: Cells of counts that a task of ``window_neighbours`` holds.
HELD_CELLS = 16_000_000
#: Items up to which a spectral embedding takes all eigenvectors of a dense matrix; beyond, only the leading ones of a sparse one.
MOST_ITEMS = 3000


def unit(vec: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(vec, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, similarity, place): the ``k`` most similar vectors to each query, by cosine; the query itself isn't.

    Queries are numbered into blocks of bounded size; every block meets every
    part of the vectors in one shuffle of either, so neither side is held
    whole by any task or the driver: a task has one block of queries and reads
    its part of the vectors batch by batch.  It keeps its own ``k`` best per
    query, so no pair below those is ever sent.  Null vectors are in no answer.
    """
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    asked = durable(queries.where("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding")))
    blocks = max(1, -(-asked.count() // block))
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism // blocks)
    numbers = lambda n: F.array(*map(F.lit, range(n))) if n <= 64 else F.sequence(F.lit(0), F.lit(n - 1))
    hashed = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    left = asked.select(hashed(blocks, 1).alias("_b"), F.explode(numbers(parts)).alias("_p"), F.lit(0).alias("_side"), "vec_id", "embedding")
    right = rows.select(F.explode(numbers(blocks)).alias("_b"), hashed(parts, 2).alias("_p"), F.lit(1).alias("_side"), "vec_id", "embedding")
    cell = F.col("_b") * parts + F.col("_p")
    met = left.unionByName(right).repartition(blocks * parts, cell).sortWithinPartitions("_b", "_p", "_side")

    def search(batches):
        now, ids, held, q = None, [], [], None
        for pdf in batches:
            for (b, p, side), part in pdf.groupby(["_b", "_p", "_side"], sort=True):
                if (b, p) != now:
                    now, ids, held, q = (b, p), [], [], None
                if side == 0:
                    ids += part["vec_id"].tolist()
                    held += part["embedding"].tolist()
                    continue
                if q is None:
                    q, names = _rows(held), np.array(ids, dtype=np.int64)
                if not ids:
                    continue
                own = part["vec_id"].to_numpy()
                for at in range(0, len(own), 8192):
                    mine = own[at : at + 8192]
                    found = q @ _rows(part["embedding"].tolist()[at : at + 8192]).T
                    found[names[:, None] == mine[None, :]] = -np.inf
                    n = min(k, found.shape[1])
                    # the id settles equal similarities
                    order = np.lexsort((np.broadcast_to(mine, found.shape), -np.round(found, 9)), axis=1)[:, :n]
                    sims = np.take_along_axis(found, order, axis=1)
                    out = pd.DataFrame({"query_id": np.repeat(names, n), "vec_id": mine[order].ravel(), "similarity": sims.ravel()})
                    yield out[out["similarity"] >= least]

    out = met.mapInPandas(search, "query_id bigint, vec_id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return out.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)


def _rows(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors]) if vectors else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def poles(vectors: DataFrame, n: int) -> DataFrame:
    """(dim, pole, place, vec_id, value): items at either end of each dimension."""
    long = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "value"))
    rank = lambda *o: F.row_number().over(Window.partitionBy("dim").orderBy(*o))
    high = long.withColumn("place", rank(F.desc("value"), "vec_id")).where(F.col("place") <= n).withColumn("pole", F.lit("high"))
    low = long.withColumn("place", rank(F.asc("value"), "vec_id")).where(F.col("place") <= n).withColumn("pole", F.lit("low"))
    return high.unionByName(low).select(F.col("dim").cast("bigint").alias("dim"), "pole", F.col("place").cast("bigint").alias("place"), "vec_id", F.round(F.col("value").cast("double"), 6).alias("value"))


def weekly_pairs(plays: DataFrame, by: list[str], least: int, window: Column | None = None) -> DataFrame:
    """(a, b, weeks, cosine), a < b: artists of ``least`` plays heard in the same weeks (or other windows) by one owner, as a share of the weeks of both (Ochiai)."""
    rows = plays.where("artist <> ''").select(*by, "artist", (F.date_trunc("week", "ts") if window is None else window).alias("week"))
    often = rows.groupBy("artist").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("artist")
    weeks = rows.join(often, "artist", "left_semi").distinct()
    alone = weeks.groupBy("artist").agg(F.count("*").alias("c"))
    lists = weeks.groupBy(*by, "week").agg(F.collect_set("artist").alias("l")).where("size(l) > 1")
    pairs = counted_pairs(lists, "l").withColumnRenamed("n", "weeks")
    out = pairs.join(alone.select(F.col("artist").alias("a"), F.col("c").alias("ca")), "a").join(alone.select(F.col("artist").alias("b"), F.col("c").alias("cb")), "b")
    return out.select("a", "b", "weeks", F.round(F.col("weeks") / F.sqrt(F.col("ca") * F.col("cb")), 6).alias("cosine"))


def listed_together(picks: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, weight), a < b: artists on the same lists, each weighted by rank and the list's length; a pair weighs the root of both."""
    size = F.count("*").over(Window.partitionBy("list_id"))
    rows = picks.where("artist <> ''").withColumn("size", size).select("list_id", F.lower("artist").alias("artist"), (1 / F.log2(F.coalesce("rank", F.lit(50)) + 1) / F.log2(F.col("size") + 1)).alias("w"))
    often = rows.groupBy("artist").agg(F.countDistinct("list_id").alias("n")).where(F.col("n") >= least).select("artist")
    # a list has a bounded number of entries, whatever the number of lists
    best = rows.join(often, "artist", "left_semi").groupBy("list_id", "artist").agg(F.max("w").alias("w"))
    lists = best.groupBy("list_id").agg(F.sort_array(F.collect_list(F.struct("artist", "w"))).alias("l")).select(F.posexplode("l").alias("k", "x"), "l")
    pairs = lists.select("x", F.explode(F.expr("slice(l, k + 2, size(l))")).alias("y"))
    return pairs.groupBy(F.col("x.artist").alias("a"), F.col("y.artist").alias("b")).agg(F.round(F.sum(F.sqrt(F.col("x.w") * F.col("y.w"))), 6).alias("weight"))


def leading(source: np.ndarray, target: np.ndarray, weight: np.ndarray, n: int, k: int, steps: int = 8, near: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` eigenvalues of largest size, and their vectors, of the symmetric matrix with ones on the diagonal and the given entries off it.

    Block Krylov spaces with restarts from the best vectors so far, until no
    residual exceeds ``near`` of the largest value, or a thousand times that
    where rounding lets it shrink no further.
    """
    def times(q: np.ndarray) -> np.ndarray:
        out = q.copy()
        for j in range(q.shape[1]):
            out[:, j] += np.bincount(source, weight * q[target, j], n) + np.bincount(target, weight * q[source, j], n)
        return out

    block = np.linalg.qr(np.random.default_rng(7).normal(size=(n, min(n, k + 8))))[0]
    last = np.inf
    for _ in range(1000):
        basis, images = block, times(block)
        new = images
        for _ in range(steps - 1):
            if basis.shape[1] + block.shape[1] > n:
                break
            for _ in range(2):  # once more against rounding
                new = new - basis @ (basis.T @ new)
            new = np.linalg.qr(new)[0]
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
            basis, new = np.hstack([basis, new]), times(new)
            images = np.hstack([images, new])
        values, turns = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[: block.shape[1]]
        values, block = values[order], basis @ turns[:, order]
        off = np.linalg.norm(images @ turns[:, order[:k]] - block[:, :k] * values[:k], axis=0).max() / np.abs(values[0])
        if off <= near or off <= 1000 * near and off > last / 2:
            return values[:k], block[:, :k]
        last, block = off, np.linalg.qr(block)[0]
    raise ValueError("the leading eigenvectors don't settle")


def embed(pairs: DataFrame, weight: str, dims: int) -> DataFrame:
    """(item, embedding): items as unit rows of the leading eigenvectors of their symmetric weights, times the roots of the values."""
    pairs = durable(pairs.select("a", "b", F.col(weight).cast("double").alias("w")))
    items = sorted(r["i"] for r in pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct().toLocalIterator())
    at = {v: k for k, v in enumerate(items)}
    source, target, weights = array("q"), array("q"), array("d")
    for r in pairs.toLocalIterator():
        source.append(at[r["a"]]), target.append(at[r["b"]]), weights.append(r["w"])
    i, j, w = np.array(source, dtype=np.int64), np.array(target, dtype=np.int64), np.array(weights)
    if len(items) > MOST_ITEMS:
        values, vectors = leading(i, j, w, len(items), dims)
    else:
        m = np.eye(len(items))
        m[i, j] = m[j, i] = w
        values, vectors = np.linalg.eigh(m) if items else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-np.abs(values), kind="stable")[:dims]
    rows = _rows(list(vectors[:, order] * np.abs(values[order]))) if items else []
    return pairs.sparkSession.createDataFrame([(v, [float(x) for x in rows[k]]) for k, v in enumerate(items)], "item string, embedding array<double>")


def diversified(scored: DataFrame, by: list[str], item: str, group: str, score: str, n: int, balance: float = 0.7) -> DataFrame:
    """(…, item, place): ``n`` items of each owner that trade relevance (0 to 1 over all of the owner's items) for a group not yet chosen.

    The greedy choice runs on an owner's ``n`` best items and the best item of
    each of the ``n`` best groups: each step takes the best item left or the
    best one of a group not yet chosen, and at most n - 1 of either are gone.
    """
    owner = Window.partitionBy(*by)
    order = owner.orderBy(F.desc(score), item)
    ranked = scored.select(*by, item, group, score).withColumn("_g", F.row_number().over(Window.partitionBy(*by, group).orderBy(F.desc(score), item)) == 1)
    ranked = ranked.withColumn("_k", F.row_number().over(order)).withColumn("_r", F.sum(F.col("_g").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bounded = ranked.withColumn("_low", F.min(score).over(owner).cast("double")).withColumn("_high", F.max(score).over(owner).cast("double"))
    top = bounded.where((F.col("_k") <= n) | F.col("_g") & (F.col("_r") <= n)).select(*by, item, group, score, "_low", "_high")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values([score, item], ascending=[False, True], kind="stable").reset_index(drop=True)
        low, high = float(left["_low"].iloc[0]), float(left["_high"].iloc[0])
        relevance = ((left[score].astype(float) - low) / (high - low) if high > low else left[score] * 0.0 + 1.0).tolist()
        groups, chosen, used = left[group].tolist(), [], set()
        rest = list(range(len(left)))
        while rest and len(chosen) < n:
            at = max(rest, key=lambda i: (balance * relevance[i] + (1 - balance) * (groups[i] not in used), -i))
            chosen.append(at)
            used.add(groups[at])
            rest.remove(at)
        out = left.loc[chosen, [*by, item]]
        return out.assign(place=range(1, len(chosen) + 1))

    kinds = "".join(f"`{c}` {scored.schema[c].dataType.simpleString()}, " for c in [*by, item])
    return top.groupBy(*by).applyInPandas(choose, kinds + "place bigint")


def weighted_sample(df: DataFrame, item: str, weight: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` items drawn with probability by weight: the smallest of exponential waiting times, from a hash of item and seed."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item))), 1, 13), 16, 10).cast("double") + 0.5) / 2**52
    return df.where(F.col(weight) > 0).withColumn("_wait", -F.log(u) / F.col(weight)).orderBy("_wait", item).limit(n).drop("_wait")


def neighbours(pairs: DataFrame, weight: str, k: int) -> DataFrame:
    """(a, b, place): the ``k`` strongest partners of each item of symmetric pairs, lower-case names, ties by name."""
    both = pairs.select(F.lower("a").alias("a"), F.lower("b").alias("b"), F.col(weight).alias("w")).unionByName(pairs.select(F.lower("b").alias("a"), F.lower("a").alias("b"), F.col(weight).alias("w")))
    best = both.where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b")).cast("bigint")).where(F.col("place") <= k).select("a", "b", "place")


def window_neighbours(plays: DataFrame, by: list[str], least: int, k: int, window: Column | None = None) -> DataFrame:
    """(a, b, place): ``neighbours`` of ``weekly_pairs`` by cosine, without a row for any pair.

    Artists are numbered in the order of their names, and a window is a list of
    numbers.  A task counts the pairs of one block of artists: it gets the
    lists that hold some of them, has all their partners, and gives out the
    ``k`` best.  So shuffled are numbers of lists, never pairs; the driver holds
    two numbers an artist of ``least`` plays.
    """
    spark = plays.sparkSession
    rows = plays.where("artist <> ''").select(*by, "artist", (F.date_trunc("week", "ts") if window is None else window).alias("week"))
    often = rows.groupBy("artist").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("artist", F.lower("artist").alias("name"))
    number = lambda f, *o: (f.over(Window.orderBy(*o)) - 1).cast("int")
    codes = durable(often.select("artist", "name", number(F.row_number(), "name", "artist").alias("code"), number(F.dense_rank(), "name").alias("low")))
    low = codes.select("code", "low").toPandas().sort_values("code")["low"].to_numpy(dtype=np.int64)
    n = len(low)
    size = max(1, min(-(-n // (2 * spark.sparkContext.defaultParallelism)), HELD_CELLS // max(1, n)))
    blocks = int(low[-1]) // size + 1 if n else 1

    coded = rows.join(small_or_shuffled(codes.select("artist", F.struct("code", F.floor(F.col("low") / size).cast("int").alias("block")).alias("x"))), "artist")
    lists = coded.groupBy(*by, "week").agg(F.collect_set("x").alias("x"))
    lists = durable(lists.select(F.sort_array("x.code").alias("l"), F.array_distinct("x.block").alias("blocks")))
    alone = np.zeros(n, dtype=np.int64)
    counted = lists.select(F.explode("l").alias("code")).groupBy("code").agg(F.count("*").alias("c")).toPandas()
    alone[counted["code"].to_numpy(dtype=np.int64)] = counted["c"].to_numpy(dtype=np.int64)
    facts = spark.sparkContext.broadcast((low, alone))
    met = lists.where("size(l) > 1").select(F.explode("blocks").alias("block"), "l").repartition(blocks, "block").sortWithinPartitions("block")

    def search(batches):
        low, alone = facts.value
        firsts = np.flatnonzero(np.diff(low, prepend=-1))
        now, lo, hi, counts = None, 0, 0, None

        def best() -> pd.DataFrame:
            found = []
            for own in np.unique(low[lo:hi]):
                at = np.arange(*np.searchsorted(low, [own, own + 1]))
                n_ab = counts[at - lo]
                # halves are rounded up, also those that binary fractions miss
                w = np.floor(n_ab / np.sqrt((alone[at][:, None] * alone[None, :]).astype(np.float64)) * 1e6 + 0.5 + 1e-9)
                w[n_ab == 0] = -1
                w = np.maximum.reduceat(w.max(axis=0), firsts)
                w[own] = -1
                there = np.flatnonzero(w >= 0)
                there = there[np.argsort(-w[there], kind="stable")][:k]
                found.append(pd.DataFrame({"a": own, "b": there, "place": np.arange(1, len(there) + 1)}))
            return pd.concat(found, ignore_index=True)

        for pdf in batches:
            for block, part in pdf.groupby("block", sort=True):
                if block != now:
                    if now is not None:
                        yield best()
                    now, (lo, hi) = block, np.searchsorted(low, [block * size, (block + 1) * size])
                    counts = np.zeros((hi - lo, len(low)), dtype=np.int32)
                for x in part["l"]:
                    i, j = np.searchsorted(x, [lo, hi])
                    counts[np.ix_(x[i:j] - lo, x)] += 1
        if now is not None:
            yield best()

    found = met.mapInPandas(search, "a int, b int, place bigint")
    names = small_or_shuffled(codes.select("low", "name").distinct())
    for side in "ab":
        found = found.join(names.select(F.col("low").alias(side), F.col("name").alias(f"{side}_name")), side)
    return found.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), "place")


def bridges(one: DataFrame, other: DataFrame) -> DataFrame:
    """(a, shared, only_one, only_other, jaccard): an item's neighbours in two spaces, of items that have some in both."""
    sets = one.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("x")).join(other.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("y")), "a")
    text = lambda c: F.array_join(F.array_sort(c), "|")
    shared = F.array_intersect("x", "y")
    return sets.select("a", text(shared).alias("shared"), text(F.array_except("x", "y")).alias("only_one"), text(F.array_except("y", "x")).alias("only_other"), F.round(F.size(shared) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


def mean_vectors(rows: DataFrame, by: list[str], item: str, weight: str, space: DataFrame) -> DataFrame:
    """(…, embedding): the weighted mean of items' vectors (item, embedding) for each owner, of length 1."""
    long = rows.select(*by, F.col(item).alias("item"), F.col(weight).alias("_w")).join(space, "item").select(*by, "_w", F.posexplode("embedding").alias("_k", "_v"))
    sums = long.groupBy(*by, "_k").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_m"))
    lists = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_k", "_m"))).alias("_l"))
    return lists.select(*by, unit(F.col("_l._m")).alias("embedding"))


def similar_owners(vectors: DataFrame, key: str, taste: list[float]) -> DataFrame:
    """(key, similarity) of owners' unit vectors to one taste vector."""
    asked = F.array(*[F.lit(float(v)) for v in taste])
    return vectors.select(key, F.round(dot(F.col("embedding"), asked), 6).alias("similarity"))

"""Nearest neighbours and what is measured by them. Distances are exact; equal ones go by the neighbour's key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries that one pass over the rows answers, and rows that a task compares with them at once: 64 MB of distances.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048
#: Rows and entities of a task that counts the rows nearer than an entity's next season.
POINTS, PLACES = 1 << 18, 1 << 15


def blocks_of(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of at most size, fetched one after another: the driver never holds more than that and a partition."""
    part: list = []
    for row in rows.toLocalIterator(prefetchPartitions=False):
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def best_of(q: np.ndarray, ids: list, x: np.ndarray, own: np.ndarray, k: int) -> pd.DataFrame:
    """(q, n, d): for each query its k nearest of the rows x with keys own (ascending), itself excluded.

    Squared distances come from one matrix product, which loses the last digits; all rows that its error can't rule out are
    measured again exactly, so the result is that of the plain formula, ties included.
    """
    square = lambda v: (v * v).sum(axis=1)
    rough = square(q)[:, None] + square(x)[None, :] - 2.0 * (q @ x.T)
    rough[np.equal.outer(np.array(ids), own)] = np.inf
    error = 1e-12 * (square(q).max(initial=0) + square(x).max(initial=0)) * max(q.shape[1], 1)
    last = np.partition(rough, k - 1, axis=1)[:, k - 1] if k <= len(x) else np.full(len(q), np.inf)
    i, j = np.nonzero((rough <= last[:, None] + 2 * error) & np.isfinite(rough))
    d = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pd.DataFrame({"q": np.array(ids, dtype=own.dtype)[i[keep]], "n": own[j[keep]], "d": d[keep]})


def nearest(spark: SparkSession, df: DataFrame, key: str, vector: str, k: int, queries: DataFrame | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(key, rank, neighbor, distance): exact nearest neighbours of a stated query set against all rows, self excluded.

    A block of queries (bounded, sent to the tasks) meets the rows of each partition in blocks; a partition keeps its k best a
    query, and only those are shuffled. queries: None takes all rows as queries, for marts of thousands of rows.
    """
    kind = dict(df.dtypes)[key]
    wanted = (queries if queries is not None else df).select(key, vector)
    out = None
    for part in blocks_of(wanted, block):
        part = sorted(part, key=lambda r: r[0])
        ids, q = [r[0] for r in part], np.array([r[1] for r in part], dtype=np.float64)

        def search(frames, ids=ids, q=q):
            best = None
            for f in frames:
                f = f.sort_values(key, kind="stable")
                x, own = np.array(f[vector].tolist(), dtype=np.float64), f[key].to_numpy()
                for at in range(0, len(x), ROW_BLOCK):
                    more = best_of(q, ids, x[at : at + ROW_BLOCK], own[at : at + ROW_BLOCK], k)
                    best = more if best is None else pd.concat([best, more]).sort_values(["q", "d", "n"]).groupby("q", sort=False).head(k)
            if best is not None:
                yield best

        found = df.select(key, vector).mapInPandas(search, f"q {kind}, n {kind}, d double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"`{key}` {kind}, rank int, neighbor {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "n"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(key), "rank", F.col("n").alias("neighbor"), F.col("d").alias("distance"))


def pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All pairs of two rows with key a < key b, for tables of labels: a plain theta join."""
    side = lambda s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in [key, *columns]])
    return side("a").join(side("b"), F.col(f"{key}_a") < F.col(f"{key}_b"))


def distances(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def trustworthiness(x: np.ndarray, low: np.ndarray, k: int = 15) -> float:
    """1 where the k nearest in the low dimensions are near in the high ones too; for marts of thousands of rows."""
    n = len(x)
    k = min(k, n - 1)
    far = distances(x)
    np.fill_diagonal(far, np.inf)
    rank = np.empty((n, n), dtype=np.int64)
    rank[np.arange(n)[:, None], far.argsort(axis=1, kind="stable")] = np.arange(1, n + 1)
    near = distances(low)
    np.fill_diagonal(near, np.inf)
    top = near.argsort(axis=1, kind="stable")[:, :k]
    lost = np.maximum(np.take_along_axis(rank, top, 1) - k, 0).sum()
    worst = n * k * (2 * n - 3 * k - 1)
    return float(1 - 2 * lost / worst) if worst > 0 else 1.0


def _distance(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return np.sqrt(dx * dx + dy * dy)


def nearer_than(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the points (x, y) are less than d from each place (px, py), by the plain formula to the last bit.

    Points are cut into strips by y and sorted by x within. Of a strip, those sure to be inside are counted by binary search;
    those near the circle's edge are measured. About the root of the number of points is looked at for a place.
    """
    out = np.zeros(len(px), dtype=np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        odd = np.flatnonzero(~(np.isfinite(px) & np.isfinite(py) & np.isfinite(d * d)))
        for i in odd[~np.isnan(px[odd]) & ~np.isnan(py[odd])].tolist():
            own = _distance(px[i] - x, py[i] - y)
            out[i] = np.count_nonzero((own < d[i]) | (np.isnan(d[i]) & ~np.isnan(own)))
    fine = np.isfinite(x) & np.isfinite(y)
    x, y = x[fine], y[fine]
    if not len(x):
        return out
    by_y = np.argsort(y, kind="stable")
    x, y = x[by_y], y[by_y]
    rows = np.setdiff1d(np.arange(len(px)), odd)
    rows = rows[np.argsort(px[rows], kind="stable")]
    strips = np.array_split(np.arange(len(x)), max(1, round(len(x) ** 0.5)))
    strips = [(s[np.argsort(x[s], kind="stable")], y[s[0]], y[s[-1]]) for s in strips]
    for start in range(0, len(rows), PLACES):
        i = rows[start : start + PLACES]
        qx, qy, r = px[i], py[i], d[i]
        count = np.zeros(len(i), dtype=np.int64)
        slack = 1e-13 * r * r
        for own, y0, y1 in strips:
            sx, sy = x[own], y[own]
            least = np.maximum(np.maximum(y0 - qy, qy - y1), 0.0)
            most = np.maximum(np.abs(y0 - qy), np.abs(y1 - qy))
            near = np.flatnonzero(least <= r * (1 + 1e-13))
            cx, reach, sure = qx[near], np.sqrt(np.maximum(r * r - least * least, 0) + slack)[near], (r * r - most * most - slack)[near]
            half = np.sqrt(np.maximum(sure, 0))
            edge = 2e-15 * (np.abs(cx) + reach)
            a, b = np.searchsorted(sx, cx - reach - edge, "left"), np.searchsorted(sx, cx + reach + edge, "right")
            lo, hi = np.searchsorted(sx, cx - half + edge, "left"), np.searchsorted(sx, cx + half - edge, "right")
            inner = (sure > 0) & (lo < hi)
            lo, hi = np.where(inner, lo, b), np.where(inner, hi, b)
            count[near] += hi - lo
            for first, n in ((a, lo - a), (hi, b - hi)):
                some = np.flatnonzero(n > 0)
                first, n = first[some], n[some]
                who = np.repeat(near[some], n)
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                count += np.bincount(who[_distance(qx[who] - sx[at], qy[who] - sy[at]) < r[who]], minlength=len(i))
        out[i] = count
    return out


def _nearer(points: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
    """(who, nearer): for each place how many of the points are nearer to it than its goal, rows of its own aside."""
    x, y, code = (points[c].to_numpy() for c in ("x", "y", "code"))
    px, py = places.px.to_numpy(), places.py.to_numpy()
    with np.errstate(invalid="ignore", over="ignore"):
        d = _distance(px - places.gx.to_numpy(), py - places.gy.to_numpy())
        count = nearer_than(x, y, px, py, d)
        order = np.argsort(code, kind="stable")
        code = code[order]
        for own in ("who", "no_key", "no_season", "neither"):
            first = np.searchsorted(code, places[own].to_numpy(), "left")
            n = np.searchsorted(code, places[own].to_numpy(), "right") - first
            who = np.repeat(np.arange(len(n)), n)
            at = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            apart = _distance(px[who] - x[at], py[who] - y[at])
            inside = (apart < d[who]) | (np.isnan(d[who]) & ~np.isnan(apart))
            count -= np.bincount(who[inside], minlength=len(n))
    return pd.DataFrame({"who": places.who, "nearer": count})


def next_season_rank(df: DataFrame, key: str, season: str, x: str, y: str) -> DataFrame:
    """One row: the median, over entities with a next season, of that season's place among all rows by distance on the map
    (0 nearest, 1 farthest). Blocks of rows meet blocks of entities; a task counts by strips of the map, so no pair becomes a row
    and few are measured. Rows without key or season that can't be told from the entity's own aren't counted."""
    code = lambda k, s: F.xxhash64(k, k.isNull(), s, s.isNull())
    kind = dict(df.dtypes)
    none = {c: F.lit(None).cast(kind[c]) for c in (key, season)}
    at = [F.col(c).cast("double") for c in (x, y)]
    rows = df.select(F.col(key).alias("_k"), F.col(season).alias("_s"), *(c.alias(a) for c, a in zip(at, ("x", "y"), strict=True)))
    k, s = F.col("_k"), F.col("_s")
    n = df.count()
    blocks, parts = max(1, -(-n // POINTS)), max(1, -(-n // PLACES))
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda df: df.repartition(min(4 * blocks * parts, 2000), "block", "part").groupBy("block", "part")

    points = rows.dropna(subset=["x", "y"]).withColumn("code", code(k, s))
    points = points.select("x", "y", "code", F.pmod(F.xxhash64("code", "x", "y"), F.lit(blocks)).cast("int").alias("block")).withColumn("part", upto(parts))
    after = rows.select(k.alias("_a"), (s - 1).alias("_b"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    pairs = rows.join(after, (k == F.col("_a")) & (s == F.col("_b")))
    places = pairs.select(
        F.col("x").alias("px"), F.col("y").alias("py"), "gx", "gy", code(k, s).alias("who"),
        code(none[key], s).alias("no_key"), code(k, none[season]).alias("no_season"), code(none[key], none[season]).alias("neither"),
    )
    places = places.withColumn("part", F.pmod(F.xxhash64("who", "px", "py"), F.lit(parts)).cast("int")).withColumn("block", upto(blocks))
    found = dealt(points).cogroup(dealt(places)).applyInPandas(_nearer, "who long, nearer long")
    ranked = found.groupBy("who").agg(F.sum("nearer").alias("nearer"))
    return ranked.agg(F.median(F.try_divide(F.col("nearer").cast("double"), F.lit(float(n - 2)))).alias("rank"), F.count("*").alias("pairs"))

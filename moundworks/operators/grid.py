"""Kernel-smoothed grids and contours. Cells are summed by one aggregate with map-side combine; a group then has at most as
many rows as the grid has cells, whatever the data, and is smoothed by two matrix products in one grouped Arrow call."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZONE = {"x": (-2.0, 2.0, 50), "y": (-0.5, 1.5, 50), "sigma": (2.75, 4.0), "enough": 25.0, "min_rows": 250}
#: The y bandwidth equals the x one in cells, as the spray surfaces have always had it.
SPRAY = {"x": (-350.0, 350.0, 60), "y": (0.0, 450.0, 60), "sigma": (18 / (700 / 60), 18 / (700 / 60)), "enough": 12.0, "min_rows": 100}


def folded_kernel(n: int, sigma: float, truncate: float = 4.0) -> list[tuple[int, int, float]]:
    """(to, from, weight): a normalised Gaussian whose tails beyond the edge fold onto the edge cell."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    total, out = sum(raw), {}
    for i in range(n):
        for d, w in zip(range(-radius, radius + 1), raw, strict=True):
            j = min(max(i + d, 0), n - 1)
            out[i, j] = out.get((i, j), 0.0) + w / total
    return [(i, j, w) for (i, j), w in sorted(out.items())]


def cell(column: str, low: float, high: float, n: int):
    """Half-open bins, the last closed; values beyond are clipped, not dropped."""
    place = F.floor((F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high)) - low) / ((high - low) / n))
    return F.least(place, F.lit(n - 1)).cast("int")


def kernel_matrix(n: int, sigma: float) -> np.ndarray:
    k = np.zeros((n, n))
    for i, j, w in folded_kernel(n, sigma):
        k[i, j] = w
    return k


def smooth_arrays(df: DataFrame, keys: list[str], x: str, y: str, value: str, spec: dict) -> DataFrame:
    """(keys, n, grid_n, grid_m, surface, reliability): a row a group, the cells as flat arrays, x-major.

    A surface cell is null where its smoothed count is below 1e-9. Rows that lack x, y or value don't count.
    """
    (x0, x1, nx), (y0, y1, ny), (sx, sy) = spec["x"], spec["y"], spec["sigma"]
    kx, ky = kernel_matrix(nx, sx), kernel_matrix(ny, sy)
    types = dict(df.dtypes)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull())
    cells = rows.groupBy(*keys, cell(x, x0, x1, nx).alias("_i"), cell(y, y0, y1, ny).alias("_j")).agg(F.sum(F.col(value).cast("double")).alias("_v"), F.count("*").alias("_c"))

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        sums, counts = np.zeros((nx, ny)), np.zeros((nx, ny))
        sums[frame["_i"], frame["_j"]], counts[frame["_i"], frame["_j"]] = frame["_v"], frame["_c"]
        over, under = kx @ sums @ ky.T, kx @ counts @ ky.T
        surface = [float(a / b) if b > 1e-9 else None for a, b in zip(over.ravel(), under.ravel(), strict=True)]
        first = frame.iloc[0]
        return pd.DataFrame([[*(first[k] for k in keys), int(counts.sum()), nx, ny, surface, (under * (2 * math.pi * sx * sy)).ravel().tolist()]], columns=[*keys, "n", "grid_n", "grid_m", "surface", "reliability"])

    return cells.groupBy(*keys).applyInPandas(smooth, f"{', '.join(f'`{k}` {types[k]}' for k in keys)}, n long, grid_n int, grid_m int, surface array<double>, reliability array<double>")


def grid_cells(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, surface, reliability): a row a cell."""
    cells = arrays.select(*keys, "grid_m", F.posexplode(F.arrays_zip("surface", "reliability")).alias("k", "c"))
    return cells.select(*keys, F.floor(F.col("k") / F.col("grid_m")).cast("int").alias("i"), (F.col("k") % F.col("grid_m")).alias("j"), "c.surface", "c.reliability")


#: Of the 16 corner cases of a square, the pairs of edges crossed; edge 0 bottom, 1 right, 2 top, 3 left. Either
#: saddle (5, 10) draws the same two segments.
CROSSED = {
    1: [(3, 0)], 2: [(0, 1)], 3: [(3, 1)], 4: [(1, 2)], 5: [(3, 0), (1, 2)], 6: [(0, 2)], 7: [(2, 3)], 8: [(2, 3)],
    9: [(0, 2)], 10: [(3, 0), (1, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)],
}


def contours(arrays: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Segments (i, j, x1, y1, x2, y2), in cell units, where a surface crosses level. Squares with a corner that is null or no
    finite number are skipped. Corners are looked up in the group's array: no join."""
    at = lambda di, dj: F.get("surface", (F.col("i") + di) * F.col("grid_m") + F.col("j") + dj)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 2))
    squares = arrays.filter("grid_n > 1 and grid_m > 1").withColumn("i", upto("grid_n")).withColumn("j", upto("grid_m"))
    squares = squares.select(*keys, "i", "j", at(0, 0).alias("s0"), at(1, 0).alias("s1"), at(1, 1).alias("s2"), at(0, 1).alias("s3"))
    for k in range(4):
        squares = squares.filter(F.abs(f"s{k}") < math.inf)  # neither null, nor infinite, nor NaN (which Spark puts above)
    case = sum(((F.col(f"s{k}") >= level).cast("int") * (1 << k) for k in range(4)), F.lit(0))
    cross = lambda p, q: F.try_divide(F.lit(level) - F.col(p), F.col(q) - F.col(p))
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    edge = [(i + cross("s0", "s1"), j), (i + 1, j + cross("s1", "s2")), (i + cross("s3", "s2"), j + 1), (i, j + cross("s0", "s3"))]
    segments = F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    for k, pairs in CROSSED.items():
        made = F.array(*[F.struct(edge[p][0].alias("x1"), edge[p][1].alias("y1"), edge[q][0].alias("x2"), edge[q][1].alias("y2")) for p, q in pairs])
        segments = F.when(F.col("case") == k, made).otherwise(segments)
    return squares.withColumn("case", case).select(*keys, "i", "j", F.explode(segments).alias("s")).select(*keys, "i", "j", "s.*")

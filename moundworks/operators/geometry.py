"""Hulls, flight paths and park walls."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def turns_left(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> bool:
    """Whether c lies to the left of the line from a through b; exact, so that the order in which points go doesn't matter."""
    dx, dy, ex, ey = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    left, right = dx * ey, dy * ex
    if not (dx and ey or dy and ex):
        return False
    if abs(left - right) > 1e-15 * (abs(left) + abs(right)) or not all(map(math.isfinite, (*a, *b, *c))):
        return not left <= right
    (ax, ay), (bx, by), (cx, cy) = (map(Fraction, p) for p in (a, b, c))
    return (bx - ax) * (cy - ay) > (by - ay) * (cx - ax)


def hull_points(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners counter-clockwise from the leftmost; fewer than three different points are their own hull."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def side(path: list) -> list:
        kept: list = []
        for p in path:
            while len(kept) > 1 and not turns_left(kept[-2], kept[-1], p):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return side(points) + side(points[::-1])


#: Rows that are cut down to hulls at once, and points from which a group is worth a pass in plain Python before the shuffle.
HULL_ROWS, HULL_POINTS = 400_000, 64


def chain(group: np.ndarray, x: np.ndarray, y: np.ndarray, side: float) -> np.ndarray:
    """Places that may be corners of the lower (side 1) or upper (-1) hull of their group. Rows come sorted by (group, x, y),
    one for each x.

    A row above the chord of its two neighbours is no corner, whatever else goes, so all such rows go at once, again and again.
    Rows that rounding could put on either side stay.
    """
    at = np.arange(len(x))
    while len(at) > 2:
        a, b, c = at[:-2], at[1:-1], at[2:]
        left, right = (x[b] - x[a]) * (y[c] - y[a]), (y[b] - y[a]) * (x[c] - x[a])
        gone = (group[a] == group[c]) & (side * (left - right) < -1e-15 * (np.abs(left) + np.abs(right)))
        at = at[np.r_[True, ~gone, True]]
        if 50 * gone.sum() < len(at):  # what few are left over fall in the plain pass
            break
    return at


def hull_rows(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row numbers, by (group, x, y), of a superset of the corners of each group's hull."""
    order = np.lexsort((y, x, group))
    group, x, y = group[order], x[order], y[order]
    new = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
    low, high = np.flatnonzero(np.r_[True, new]), np.flatnonzero(np.r_[new, True])
    with np.errstate(invalid="ignore", over="ignore"):
        low, high = (at[chain(group[at], x[at], y[at], side)] for at, side in ((low, 1.0), (high, -1.0)))
    return order[np.union1d(low, high)]


def _groups(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal numbers."""
    edges = np.flatnonzero(group[1:] != group[:-1]) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(group)], strict=True)


def _cut_down(rows: pa.Table, key: str) -> pa.Table:
    """Fewer rows with the same hulls; groups that are large even so are cut down to their corners."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return rows
    group = rows.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
    x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
    at = hull_rows(group, x, y)
    drop = []
    for start, end in _groups(group[at]):
        if end - start > HULL_POINTS:
            own = at[start:end]
            corners = set(hull_points(list(zip(x[own].tolist(), y[own].tolist(), strict=True))))
            drop += [i for i in own.tolist() if (x[i], y[i]) not in corners]
    return rows.take(pa.array(np.setdiff1d(at, drop) if drop else np.sort(at)))


def _local_hulls(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HULL_ROWS:
                yield from _cut_down(pa.Table.from_batches(held), key).to_batches()
                held, n = [], 0
        if held:
            yield from _cut_down(pa.Table.from_batches(held), key).to_batches()

    return run


def _final_hulls(key: str):
    """Rows come sorted by key; a group's rows may fill many batches."""

    def corners(rows: pa.Table) -> pa.RecordBatch:
        group = rows.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
        x, y = rows.column("x").to_numpy().tolist(), rows.column("y").to_numpy().tolist()
        first, ks, out = [], [], []
        for start, end in _groups(group):
            hull = hull_points(list(zip(x[start:end], y[start:end], strict=True)))
            first += [start] * len(hull)
            ks += range(len(hull))
            out += hull
        columns = [rows.column(key).take(pa.array(first)).combine_chunks(), pa.array(ks, pa.int32()), pa.array([p[0] for p in out], pa.float64()), pa.array([p[1] for p in out], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "k", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, HULL_ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                rows = _cut_down(pa.Table.from_batches(held), key)
                keys = rows.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
                open_ = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if open_:
                    yield corners(rows.slice(0, open_))
                held = rows.slice(open_).to_batches()
                n = rows.num_rows - open_
                most = HULL_ROWS + 2 * n
        if n:
            yield corners(_cut_down(pa.Table.from_batches(held), key))

    return run


def convex_hull(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, k, x, y). Rows are cut down by partition before the shuffle, then groups by groups, HULL_ROWS at a time: numpy
    drops what can't be a corner of all groups at once, and plain Python orders the few points left."""
    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    local = rows.mapInArrow(_local_hulls(key), f"`{key}` {kind}, x double, y double")
    return local.repartition(key).sortWithinPartitions(key).mapInArrow(_final_hulls(key), f"`{key}` {kind}, k int, x double, y double")


def flight(df: DataFrame, samples: int = 20, yf: float = 17 / 12) -> DataFrame:
    """Positions and speed from release to the plate at samples + 1 equal times; null paths give no rows.

    df: x0, z0 (at y = 50), release_y, vx0..az.
    """

    def when_at(y: Column) -> Column:
        disc = F.col("vy0") * F.col("vy0") - F.col("ay") * 2.0 * (F.lit(50.0) - y)
        return F.when((F.col("ay") != 0) & (disc >= 0), F.try_divide(-F.col("vy0") - F.sqrt(disc), F.col("ay")))

    timed = df.withColumn("t0", when_at(F.col("release_y"))).withColumn("t1", when_at(F.lit(yf))).filter("t0 is not null and t1 is not null")
    rows = timed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples)))).withColumn("t", F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("k") / float(samples))
    at = lambda p, v, a: p + F.col(v) * F.col("t") + F.col(a) * F.col("t") * F.col("t") * 0.5
    v = [F.col(f"v{c}0") + F.col(f"a{c}") * F.col("t") for c in "xyz"]
    mph = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) * (3600.0 / 5280.0)
    return rows.withColumns({"x": at(F.col("x0"), "vx0", "ax"), "y": at(F.lit(50.0), "vy0", "ay"), "z": at(F.col("z0"), "vz0", "az"), "mph": mph})


def park_wall(markers: DataFrame, key: str, points: int = 41) -> DataFrame:
    """(key, k, x, y): the wall as a Catmull-Rom curve through five (angle, distance) markers, ends doubled.

    markers: key and ``marks``, an array of five structs (angle in degrees from centre, distance in feet).
    """
    u = F.col("k") * F.lit(4.0 / (points - 1))
    i = F.least(F.floor(u), F.lit(3)).cast("int")
    rows = markers.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("i", i).withColumn("f", u - F.col("i"))

    def curve(field: str) -> Column:
        p = [F.get(F.col(f"marks.{field}"), F.least(F.greatest(F.col("i") + d, F.lit(0)), F.lit(4))) for d in (-1, 0, 1, 2)]
        f = F.col("f")
        return 0.5 * (2 * p[1] + (p[2] - p[0]) * f + (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3]) * f * f + (3 * p[1] - p[0] - 3 * p[2] + p[3]) * f * f * f)

    a = F.radians(curve("angle"))
    return rows.select(key, "k", (F.sin(a) * curve("distance")).alias("x"), (F.cos(a) * curve("distance")).alias("y"))


#: Distances in feet to the left line, left alley, centre, right alley and right line of each park.
PARKS = {
    "AZ": (330, 374, 407, 374, 334), "ATL": (335, 385, 400, 375, 325), "ATH": (330, 367, 403, 367, 325), "BAL": (333, 364, 410, 373, 318),
    "BOS": (310, 379, 390, 380, 302), "CHC": (355, 368, 400, 368, 353), "CIN": (328, 379, 404, 370, 325), "CLE": (325, 370, 405, 375, 325),
    "COL": (347, 390, 415, 375, 350), "CWS": (330, 375, 400, 375, 335), "DET": (345, 370, 412, 365, 330), "HOU": (315, 362, 409, 373, 326),
    "KC": (330, 387, 410, 387, 330), "LAA": (330, 387, 396, 370, 330), "LAD": (330, 375, 395, 375, 330), "MIA": (344, 386, 400, 392, 335),
    "MIL": (344, 371, 400, 374, 345), "MIN": (339, 377, 404, 367, 328), "NYM": (335, 358, 408, 375, 330), "NYY": (318, 399, 408, 385, 314),
    "PHI": (329, 374, 401, 369, 330), "PIT": (325, 389, 399, 375, 320), "SD": (336, 390, 396, 391, 322), "SEA": (331, 378, 401, 381, 326),
    "SF": (339, 364, 399, 415, 309), "STL": (336, 375, 400, 375, 335), "TB": (315, 370, 404, 370, 322), "TEX": (329, 372, 407, 374, 326),
    "TOR": (328, 375, 400, 375, 328), "WSH": (336, 377, 402, 370, 335),
}
#: The angles of those markers, from dead centre, the left line first.
MARKS = (-45.0, -22.5, 0.0, 22.5, 45.0)


def parks(spark: SparkSession) -> DataFrame:
    """(park, marks) for ``park_wall``."""
    rows = [(name, [(a, float(d)) for a, d in zip(MARKS, at, strict=True)]) for name, at in PARKS.items()]
    return spark.createDataFrame(rows, "park string, marks array<struct<angle:double,distance:double>>")


def nearest_point(points: DataFrame, keys: list[str], x: str, y: str, at_x: Column, at_y: Column, within: float) -> DataFrame:
    """The point of each group that is nearest to a place, if it is within a distance; ties by the keys' own order are left to
    x, then y. One aggregate."""
    d = F.hypot(F.col(x) - at_x, F.col(y) - at_y)
    best = points.groupBy(*keys).agg(F.min(F.struct(d.alias("distance"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("b"))
    return best.select(*keys, "b.*").filter(F.col("distance") <= within)


def fitted_view(points: DataFrame, x: str, y: str, width: float, height: float, margin: float = 0.05) -> DataFrame:
    """One row: centre_x, centre_y and the scale at which all points fit into width x height with a margin on each side."""
    ends = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    room = 1 - 2 * margin
    scale = F.least(F.try_divide(F.lit(width * room), F.col("x1") - F.col("x0")), F.try_divide(F.lit(height * room), F.col("y1") - F.col("y0")))
    return ends.select(((F.col("x0") + F.col("x1")) / 2).alias("centre_x"), ((F.col("y0") + F.col("y1")) / 2).alias("centre_y"), scale.alias("scale"))

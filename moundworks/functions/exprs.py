"""Column -> Column helpers of the pitch domain. All stay inside generated code; null in, null out unless said."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null for b = 0 (plain division raises in ANSI mode)."""
    return F.try_divide(a, b)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


def flag(c: Column) -> Column:
    """1 or 0 for a boolean; null counts as 0."""
    return F.coalesce(c.cast("int"), F.lit(0))


def base_state() -> Column:
    return sum((F.col(f"on_{i}b").isNotNull().cast("int") * (1 << i - 1) for i in (1, 2, 3)), F.lit(0))


def impossible() -> Column:
    """A measurement out of its limits; a null one is not impossible."""
    bad = []
    for name, (low, high, open_low) in S.LIMITS.items():
        c = F.col(name)
        bad.append(F.coalesce((c <= low if open_low else c < low) | (c > high), F.lit(False)))
    return reduce(or_, bad)


def approach_angles(vx0: Column, vy0: Column, vz0: Column, ax: Column, ay: Column, az: Column, y0: float = 50.0, yf: float = 17 / 12) -> tuple[Column, Column]:
    """(vertical, horizontal) angle in degrees at the plate; null if ay = 0 or it is never reached."""
    disc = vy0 * vy0 - ay * F.lit(2.0 * (y0 - yf))
    t = F.when((ay != 0) & (disc >= 0), F.try_divide(-vy0 - F.sqrt(disc), ay))
    vx, vy, vz = vx0 + ax * t, vy0 + ay * t, vz0 + az * t
    return F.degrees(F.atan2(vz, F.abs(vy))), F.degrees(F.atan2(vx, F.abs(vy)))


def landing(hc_x: Column, hc_y: Column) -> tuple[Column, Column]:
    return (hc_x - 125.91) * 2.339, (F.lit(199.54) - hc_y) * 2.339


def mirror(c: Column, hand: Column, flips: str = "R") -> Column:
    """c with its sign turned for one hand; other and null hands keep it."""
    return F.when(hand == flips, -c).otherwise(c)


def circular(angle: Column, hand: Column) -> tuple[Column, Column]:
    """Sine and cosine of an angle, mirrored for left-handers."""
    a = F.radians(F.when(hand == "L", F.pmod(F.lit(360.0) - angle, F.lit(360.0))).otherwise(angle))
    return F.sin(a), F.cos(a)


def circular_mean(sin: Column, cos: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(F.avg(sin), F.avg(cos))), F.lit(360.0))


def location_class(x: Column, z: Column) -> Column:
    """row * 5 + column of a 5 x 5 grid around the zone (columns by x in -1.5..1.5 ft, rows by z in -0.5..1.5 of its height,
    from below), 25 beyond, null unmeasured."""
    column, row = F.floor((x + 1.5) / 3.0 * 5).cast("int"), F.floor((z + 0.5) / 2.0 * 5).cast("int")
    inside = column.between(0, 4) & row.between(0, 4)
    return F.when(x.isNull() | z.isNull(), None).when(inside, row * 5 + column).otherwise(25)


def count_key(balls: Column, strikes: Column) -> Column:
    clip = lambda c, top: F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(top)).cast("string")
    return F.when(balls.isNotNull() & strikes.isNotNull(), F.concat(clip(balls, 3), F.lit("-"), clip(strikes, 2)))


def mapped(c: Column, table: dict, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.when(c.isNotNull(), F.try_element_at(pairs, c))
    return found if default is None else F.coalesce(found, F.lit(default))


def count_bucket(balls: Column, strikes: Column) -> Column:
    return mapped(count_key(balls, strikes), S.COUNT_BUCKETS, "even")


def pitch_family(kind: Column) -> Column:
    return mapped(kind, {t: f for f, ts in S.FAMILIES.items() for t in ts}, "offspeed")


def velocity_tier(mph: Column) -> Column:
    return F.when(mph >= 99, "99+").when(mph >= 95, "95-98").when(mph >= 90, "90-94").when(mph.isNotNull(), "80s-")


def ramp_step(v: Column, limit: float, dead: float = 0.08, steps: int = 5) -> Column:
    """-steps..steps of a diverging scale; 0 within the dead band."""
    t = F.least(F.greatest(v / limit, F.lit(-1.0)), F.lit(1.0))
    step = F.least(F.floor((F.abs(t) - dead) / (1 - dead) * steps).cast("int") + 1, F.lit(steps))
    return F.when(F.abs(t) < dead, 0).otherwise(F.signum(t).cast("int") * step)


def fade(reliability: Column, enough: float) -> Column:
    return F.when(reliability >= enough, 1.0).otherwise(F.greatest(F.lit(0.06), reliability / enough * 0.35))


def encode_sorted(c: Column, values: list[str]) -> Column:
    """Place of a value among the sorted values seen in training; null for others."""
    return mapped(c, {v: i for i, v in enumerate(sorted(set(values)))})


def clean_null(c: Column) -> Column:
    """null, NA and blanks of raw text files."""
    return F.when(~F.trim(c).isin("null", "NA", ""), c)


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def without_scratch(df: DataFrame) -> DataFrame:
    """df without the columns whose names start with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def top_probabilities(probs: Column, classes: list[str], least: float = 0.005, k: int | None = None) -> Column:
    """An array of (class, probability), largest first, ties by the class's place; those under ``least`` are left out."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("minus"), i.alias("i")))
    kept = F.array_sort(F.filter(pairs, lambda x: -x["minus"] >= least))
    kept = F.slice(kept, 1, k) if k else kept
    names = F.array(*map(F.lit, classes))
    return F.transform(kept, lambda x: F.struct(F.get(names, x["i"]).alias("class"), F.round(-x["minus"], 4).alias("probability")))

"""Data-quality checks: a query that must be empty (or not), a severity, and up to ten sample rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import schema as S
from .relops import coverage, unmatched

SAMPLES = 10


@dataclass(frozen=True)
class Check:
    name: str
    rows: Callable[[dict[str, DataFrame]], DataFrame]
    severity: str = "error"
    expect_empty: bool = True
    needs: tuple[str, ...] = ("fact_pitch",)


@dataclass(frozen=True)
class Outcome:
    name: str
    severity: str
    passed: bool
    samples: list[Row]


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def groups_beyond(df: DataFrame, keys: list[str], low: int | None, high: int | None) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col("n") < low)
    if high is not None:
        bad = bad | (F.col("n") > high)
    return counted.filter(bad)


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter((F.col(column) < low) | (F.col(column) > high))


def rate_beyond(df: DataFrame, hit, low: float, high: float) -> DataFrame:
    """One row if the percentage of hit over all rows is outside low..high."""
    return df.agg(F.avg(F.coalesce(hit.cast("int"), F.lit(0)) * 100.0).alias("pct")).filter((F.col("pct") < low) | (F.col("pct") > high))


def tracked(df: DataFrame) -> DataFrame:
    return df.filter("is_tracked_pitch")


def saturated_days(df: DataFrame, most: int = S.SATURATED_ROWS - 1) -> DataFrame:
    return groups_beyond(df, ["game_date"], None, most)


def odd_games(df: DataFrame, low: int = 100, high: int = 800) -> DataFrame:
    return groups_beyond(df.filter("game_type = 'R'"), ["game_pk"], low, high)


def impossible_velocity(df: DataFrame, low: float = 25, high: float = 108) -> DataFrame:
    return out_of_range(tracked(df), "release_speed", low, high)


def impossible_place(df: DataFrame, limits: dict = S.LIMITS) -> DataFrame:
    bad = F.lit(False)
    for name in ("plate_x", "plate_z", "release_pos_x", "release_pos_z"):
        low, high, open_low = limits[name]
        bad = bad | F.coalesce((F.col(name) <= low if open_low else F.col(name) < low) | (F.col(name) > high), F.lit(False))
    return tracked(df).filter(bad)


def quarantined(df: DataFrame, most: int = 100) -> DataFrame:
    return groups_beyond(df.filter("not is_tracked_pitch and description not in ('automatic_ball', 'automatic_strike')"), ["season"], None, most)


def slow_pitchers(df: DataFrame, players: DataFrame, least: float = 55) -> DataFrame:
    true = players.filter("primary_position = 'P'").select(F.col("mlbam_id").alias("pitcher"))
    return tracked(df).join(true, "pitcher").groupBy("pitcher").agg(F.min("release_speed").alias("slowest")).filter(F.col("slowest") < least)


def odd_zones(df: DataFrame, top: float = 6.0) -> DataFrame:
    return tracked(df).filter((F.col("sz_top") <= F.col("sz_bot")) | (F.col("sz_top") > top) | (F.col("sz_bot") < 0))


def sinkers_that_cut(df: DataFrame, most: float = 0.0) -> DataFrame:
    """Seasons and hands whose sinkers don't run to the arm side on average."""
    return tracked(df).filter("pitch_type = 'SI'").groupBy("season", "p_throws").agg(F.avg("hb_arm_in").alias("hb")).filter(F.col("hb") <= most)


def zone_rate(df: DataFrame, low: float = 35, high: float = 60) -> DataFrame:
    return rate_beyond(tracked(df), F.col("is_in_zone"), low, high)


def csw_rate(df: DataFrame, low: float = 22, high: float = 32) -> DataFrame:
    return rate_beyond(tracked(df), F.col("is_csw"), low, high)


FACT = "fact_pitch"
CHECKS = [
    Check("primary_key_unique", lambda t: duplicates(t[FACT], S.PITCH_KEY)),
    Check("not_empty", lambda t: t[FACT].limit(1), expect_empty=False),
    Check("no_saturated_day", lambda t: saturated_days(t[FACT])),
    Check("plausible_game_size", lambda t: odd_games(t[FACT]), "warn"),
    Check("velocity_possible", lambda t: impossible_velocity(t[FACT])),
    Check("location_possible", lambda t: impossible_place(t[FACT])),
    Check("quarantined_few", lambda t: quarantined(t[FACT]), "warn"),
    Check("slow_true_pitchers", lambda t: slow_pitchers(t[FACT], t["dim_player"]), "warn", needs=(FACT, "dim_player")),
    Check("zone_sane", lambda t: odd_zones(t[FACT])),
    Check("sinker_arm_side", lambda t: sinkers_that_cut(t[FACT])),
    Check("league_zone_rate", lambda t: zone_rate(t[FACT])),
    Check("league_csw_rate", lambda t: csw_rate(t[FACT]), "warn"),
    Check("pitchers_mapped", lambda t: unmatched(t[FACT], t["dim_player_ids"], "pitcher", "mlbam_id"), needs=(FACT, "dim_player_ids")),
    Check("batters_mapped", lambda t: unmatched(t[FACT], t["dim_player_ids"], "batter", "mlbam_id"), needs=(FACT, "dim_player_ids")),
    Check("games_mapped", lambda t: unmatched(t[FACT], t["dim_game"], "game_pk", "game_pk"), "warn", needs=(FACT, "dim_game")),
]


def run_checks(tables: dict[str, DataFrame], checks: Iterable[Check] = CHECKS) -> list[Outcome]:
    """Outcomes of the checks whose tables exist; a table may be missing while it is still to be built."""
    out = []
    for c in checks:
        if all(n in tables for n in c.needs):
            rows = c.rows(tables).limit(SAMPLES).collect()
            out.append(Outcome(c.name, c.severity, (not rows) == c.expect_empty, rows if c.expect_empty else []))
    return out


def failed(outcomes: Iterable[Outcome]) -> bool:
    return any(not o.passed and o.severity == "error" for o in outcomes)


def season_coverage(pitches: DataFrame, columns: list[str]) -> DataFrame:
    return coverage(pitches, "season", columns)

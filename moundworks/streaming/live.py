"""The live path: the state before a pitch, and its features by the same function as in batch."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pitches import next_pitch_features


@dataclass(frozen=True)
class PendingPitch:
    """What is known before the ball is released; it has no field for the pitch itself, so none can leak."""

    game_pk: int
    at_bat_number: int
    pitch_number: int
    game_date: object
    season: int
    pitcher: int
    batter: int
    balls: int
    strikes: int
    outs_when_up: int
    inning: int
    base_state: int
    bat_score: int
    fld_score: int
    stand: str
    p_throws: str
    home_team: str
    inning_topbot: str
    n_thruorder_pitcher: int | None = None
    pitcher_days_since_prev_game: float | None = None


class LiveState:
    """Pitches so far (an enriched table) and what comes next. Rows are added by union; the pending one is marked and comes
    last in every window, whatever its date."""

    def __init__(self, history: DataFrame):
        self.history = history

    @classmethod
    def seeded(cls, pitches: DataFrame, pitcher: int, season: int) -> LiveState:
        """Warm from the season so far of one pitcher: a filter that reaches the scan."""
        return cls(pitches.filter((F.col("pitcher") == pitcher) & (F.col("season") == season)))

    @property
    def spark(self) -> SparkSession:
        return self.history.sparkSession

    def record(self, completed: DataFrame) -> LiveState:
        """The state with thrown pitches added, in the history's types; columns that they lack are null."""
        own = dict(self.history.dtypes)
        rows = completed.select(*[(F.col(c) if c in completed.columns else F.lit(None)).cast(t).alias(c) for c, t in own.items()])
        return LiveState(self.history.unionByName(rows))

    def features_for(self, pending: PendingPitch) -> DataFrame:
        """One row: the features of the pitch to come."""
        own = {c: t for c, t in self.history.dtypes}
        given = {k: v for k, v in asdict(pending).items() if k in own}
        row = self.spark.range(1).select(*[F.lit(given.get(c)).cast(t).alias(c) for c, t in own.items()], F.lit(True).alias("_live"))
        both = self.history.withColumn("_live", F.lit(False)).unionByName(row)
        return next_pitch_features(both, "_live").filter("_live").drop("_live")

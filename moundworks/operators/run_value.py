"""Run values by count. Everything is one window over the plate appearance and three small aggregates."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as E

PA = ["game_pk", "at_bat_number"]
CONTACT, RESULT = "estimated_woba_using_speedangle", "delta_run_exp"
LEAST_CONTACT = 100


def run_values(df: DataFrame, pa: list[str], order: list[str], count: str, value: str, event: str) -> DataFrame:
    """The generic form: adds is_last, terminal (mean of value by the last event), re (of the count), rv_batting, rv_pitcher.

    The last row of a plate appearance is that without a follower in one ordered window, its event the last of the frame; the
    event means come from the last rows only. The tables of means have a row an event and a row a count.
    """
    w = Window.partitionBy(*pa).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumns({"next_count": F.lead(count).over(w), "is_last": F.lead(F.lit(1)).over(w).isNull(), "_end": F.last(event).over(whole)})
    means = rows.filter(F.col("is_last") & F.col(event).isNotNull()).groupBy(F.col(event).alias("_e")).agg(F.avg(value).alias("terminal"))
    rows = rows.join(means, F.col("_end") == F.col("_e"), "left").drop("_e", "_end")
    reached = rows.filter("terminal is not null").groupBy(*pa, count).agg(F.any_value("terminal").alias("terminal"))
    table = reached.groupBy(count).agg(F.avg("terminal").alias("re"))
    rows = rows.join(table, count, "left").join(table.select(F.col(count).alias("next_count"), F.col("re").alias("re_next")), "next_count", "left")
    batting = F.when(F.col("is_last"), F.col("terminal")).otherwise(F.col("re_next")) - F.col("re")
    batting = F.when(F.col("terminal").isNotNull(), batting)
    return rows.withColumn("rv_batting", batting).withColumn("rv_pitcher", -batting).drop("re_next")


@dataclass
class RunValue:
    """Fitted on one frame, attached to any: the expectation by count, the worth of each outcome, a line for contact."""

    count_re: dict[str, float] = field(default_factory=dict)
    event_value: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    slope: float = 0.0
    n_fit: int = 0

    @classmethod
    def fit(cls, df: DataFrame) -> RunValue:
        """Two jobs: the outcomes first, then the counts, which need them. What reaches the driver has a row an event (a fixed
        vocabulary) and a row a count (twelve). Raises under LEAST_CONTACT balls in play with an estimate."""
        needed = [*PA, "pitch_number", "balls", "strikes", "description", "events", RESULT, CONTACT]
        if missing := sorted(set(needed) - set(df.columns)):
            raise ValueError(f"run values need {missing}")
        rows = _ended(df.select(*needed))
        ends = rows.filter(F.col("pitch_number") == F.col("_end.pitch_number"))
        contact = F.col("_end.contact") & F.col(RESULT).isNotNull()
        x, y = F.when(contact, F.col("_end.estimate")), F.when(contact, F.col(RESULT))
        line = ends.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.count_if(contact).alias("n"), F.count("*").alias("all")).collect()[0]
        if line.n < LEAST_CONTACT:
            raise ValueError(f"only {line.n} balls in play have an estimate; {LEAST_CONTACT} are needed")
        worth = {r.events: r.w for r in ends.filter(F.col(RESULT).isNotNull()).groupBy("events").agg(F.avg(RESULT).alias("w")).collect()}
        model = cls({}, worth, line.a, line.b, line["all"])
        reached = rows.withColumn("terminal", model.terminal()).withColumn("count", E.count_key(F.col("balls"), F.col("strikes"))).filter("_end is not null")
        reached = reached.groupBy(*PA, "count").agg(F.any_value("terminal").alias("terminal"))
        model.count_re = {r["count"]: r.re for r in reached.groupBy("count").agg(F.avg("terminal").alias("re")).collect() if r["count"] is not None}
        return model

    def terminal(self) -> Column:
        line = F.lit(self.intercept) + F.lit(self.slope) * F.col("_end.estimate")
        return F.when(F.col("_end.contact"), line).otherwise(E.mapped(F.col("_end.events"), self.event_value) if self.event_value else F.lit(None).cast("double"))

    def attach(self, df: DataFrame) -> DataFrame:
        """Adds rv_pitcher; null where the plate appearance is left out or its outcome has no worth. One exchange."""
        w = Window.partitionBy(*PA).orderBy("pitch_number")
        re = lambda b, s: E.mapped(E.count_key(b, s), self.count_re)
        rows = _ended(df).withColumns({"_next": re(F.lead("balls").over(w), F.lead("strikes").over(w)), "_last": F.lead(F.lit(1)).over(w).isNull()})
        batting = F.when(F.col("_last"), self.terminal()).otherwise(F.col("_next")) - re(F.col("balls"), F.col("strikes"))
        return rows.withColumn("rv_pitcher", -batting).drop("_end", "_next", "_last")

    def strike_values(self) -> dict[str, float | None]:
        """What a strike call costs the batter against a ball call, for each of the twelve counts: a fourth ball is a walk, a
        third strike a strikeout."""
        out = {}
        for b in range(4):
            for s in range(3):
                ball = self.event_value.get("walk") if b == 3 else self.count_re.get(f"{b + 1}-{s}")
                strike = self.event_value.get("strikeout") if s == 2 else self.count_re.get(f"{b}-{s + 1}")
                out[f"{b}-{s}"] = None if ball is None or strike is None else ball - strike
        return out

    def strike_value(self, balls: Column, strikes: Column) -> Column:
        known = {k: v for k, v in self.strike_values().items() if v is not None}
        return E.mapped(E.count_key(balls, strikes), known) if known else F.lit(None).cast("double")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RunValue:
        return cls(**json.loads(text))


def _ended(df: DataFrame) -> DataFrame:
    """df with ``_end``: the pitch that ended the plate appearance with an outcome that counts, or null."""
    ends = F.col("events").isNotNull() & (F.col("events") != "") & ~F.col("events").isin(*S.NO_RUN_VALUE)
    contact = (F.coalesce(F.col("description") == "hit_into_play", F.lit(False)) & F.col(CONTACT).isNotNull()).alias("contact")
    row = F.struct("pitch_number", "events", contact, F.col(CONTACT).alias("estimate"))
    return df.withColumn("_end", F.max(F.when(ends, row)).over(Window.partitionBy(*PA)))

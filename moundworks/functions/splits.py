"""Splits for training, and the checks that they leak nothing. Each part is a filter on the same table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pitches import feature_matrix


@dataclass
class Split:
    train: DataFrame
    valid: DataFrame
    test: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        return {"train": self.train, "valid": self.valid, "test": self.test}


def by_season(df: DataFrame, train_through: int, valid: int, test_from: int) -> Split:
    s = F.col("season")
    return Split(df.filter(s <= train_through), df.filter(s == valid), df.filter(s >= test_from))


def by_date(df: DataFrame, train: float = 0.7, valid: float = 0.15) -> Split:
    """Cuts after shares of the dates: no date, so no plate appearance, is in two parts. The dates (a few hundred a season)
    come to the driver."""
    days = [r.game_date for r in df.select("game_date").filter("game_date is not null").distinct().orderBy("game_date").collect()]
    if not days:
        return Split(df, df, df)
    ends = [days[max(0, int(len(days) * share) - 1)] for share in (train, train + valid)]
    d = F.col("game_date")
    return Split(df.filter(d <= ends[0]), df.filter((d > ends[0]) & (d <= ends[1])), df.filter(d > ends[1]))


def by_entity(df: DataFrame, key: str = "pitcher", percent: int = 20) -> Split:
    """Whole entities are held out, by a hash; valid and test are disjoint halves of them."""
    h = F.pmod(F.xxhash64(key), F.lit(200))
    return Split(df.filter(h >= 2 * percent), df.filter(h < percent), df.filter((h >= percent) & (h < 2 * percent)))


def auto(df: DataFrame, features: bool = True) -> Split:
    """Whole seasons where there are three, else by date; checked."""
    seasons = [r.season for r in df.select("season").distinct().orderBy("season").collect()]
    split = by_season(df, seasons[-3], seasons[-2], seasons[-1]) if len(seasons) >= 3 else by_date(df)
    check(split, features)
    return split


def check(split: Split, features: bool = True) -> None:
    """Raises if a part begins before the one before it ends, if a plate appearance is in two, or a feature is missing."""
    spans = {n: p.agg(F.min("game_date").alias("first"), F.max("game_date").alias("last")).collect()[0] for n, p in split.parts().items()}
    names = list(spans)
    for before, after in zip(names, names[1:], strict=False):
        if spans[before].last is not None and spans[after].first is not None and spans[before].last >= spans[after].first:
            raise ValueError(f"{before} ends {spans[before].last}, {after} starts {spans[after].first}")
    if n := straddling(split).count():
        raise ValueError(f"{n} plate appearances are in two parts")
    if features:
        for part in split.parts().values():
            feature_matrix(part)


def straddling(split: Split) -> DataFrame:
    """Plate appearances found in more than one part, in one aggregate over the three."""
    keys = [p.select("game_pk", "at_bat_number", F.lit(n).alias("part")) for n, p in split.parts().items()]
    return keys[0].union(keys[1]).union(keys[2]).groupBy("game_pk", "at_bat_number").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b")


def prepared(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known."""
    return df.filter(F.col(target).isNotNull())


def subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same in every run: those of the smallest hashes of a key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)

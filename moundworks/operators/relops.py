"""Relational operators: dedupe, rollup, joins, set operations, coverage, histograms, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order, last: bool = False) -> DataFrame:
    """One row a key by an explicit order (dropDuplicates would take any). order must be total; last reverses it."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    order = [c.desc_nulls_last() if last else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def most_complete(df: DataFrame, keys: list[str], counted: list[str], *order) -> DataFrame:
    """One row a key: the one with most non-null values in counted."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in counted), F.lit(0))
    return keep_first(df.withColumn("_filled", filled), keys, F.col("_filled").desc(), *order).drop("_filled")


def rollup_all(df: DataFrame, keys: list[str], kind: str, aggs: list[Column], label: str = "ALL") -> DataFrame:
    """Groups by kind and, in the same pass, totals labelled ``label``. Rows of null kind are left out beforehand, as they
    would look like totals."""
    rows = df.filter(F.col(kind).isNotNull()).groupingSets([[*map(F.col, keys), F.col(kind)], [*map(F.col, keys)]], *keys, kind)
    return rows.agg(F.grouping(kind).alias("_total"), *aggs).withColumn(kind, F.when(F.col("_total") == 1, label).otherwise(F.col(kind))).drop("_total")


def qualified(df: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    """Rows whose group has no null key and at least min_n rows: counted first, then a semi join."""
    rows = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_n).select(*keys), keys, "left_semi")


def consecutive(df: DataFrame, key: str, season: str, values: list[str]) -> DataFrame:
    """Pairs of one season with the one before it, values suffixed _prev."""
    before = df.select(key, (F.col(season) + 1).alias(season), *[F.col(v).alias(f"{v}_prev") for v in values])
    return df.select(key, season, *values).join(before, [key, season])


def unmatched(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct non-null keys of df without a partner."""
    return df.select(left).filter(F.col(left).isNotNull()).distinct().join(other.select(F.col(right).alias(left)), left, "left_anti")


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join where a non-null override wins."""
    o = overrides.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = df.join(o, F.col(key) == F.col("_k"), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) for c in columns}).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; within new the last by ``fetched_at``."""
    both = union_relaxed(old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1)))
    return keep_first(both, keys, F.col("_new").desc(), F.col("fetched_at").desc_nulls_last()).drop("_new")


def union_relaxed(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coverage(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Percent of non-null values by group, to one place."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.lit(100.0) * F.count(c) / F.count("*"), 1).alias(f"{c}_pct") for c in columns])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal width from least to largest, the last bin closed, empty bins kept; no row if degenerate."""
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).filter("a < b")
    wide = df.filter(F.col(column).isNotNull()).join(F.broadcast(ends))  # one row by construction
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("a")) / ((F.col("b") - F.col("a")) / bins))).cast("int")
    counted = wide.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", ((F.col("b") - F.col("a")) / bins).alias("w"))
    return frame.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("w") * F.col("bin")).alias("lo"), (F.col("a") + F.col("w") * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.col(weight)).cast("double"))


def leaders(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each given value; None asks nothing, so each predicate reaches the scan by itself."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, a deviation of 0 counting as 1; the two moments are one row."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = df.join(F.broadcast(stats))
    return wide.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).select(*df.columns)


def purity(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, n, label, labels, purity, whole_purity): each group's commonest label (ties by name), how many it has and the
    share of the first; whole_purity is the shares' mean weighted by n."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("v"))).alias("b")
    groups = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), best, F.count("*").alias("labels"))
    groups = groups.select(*keys, "n", F.col("b.v").alias("label"), "labels", (-F.col("b.m") / F.col("n").cast("double")).alias("purity"))
    whole = groups.agg((F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("whole_purity"))
    return groups.join(F.broadcast(whole))  # one row


def ids(*frames: DataFrame, name: str) -> DataFrame:
    """The different ids of one-column frames."""
    return reduce(lambda a, b: a.union(b), [f.toDF(name) for f in frames]).distinct()


def missing(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """The different ids of one that the other lacks."""
    return df.toDF(name).subtract(other.toDF(name))


def shared(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
    return df.toDF(name).intersect(other.toDF(name))

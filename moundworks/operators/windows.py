"""Window operators. Every one names its partitioning once, so that a chain of them on one key costs one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(keys: list[str], *order) -> WindowSpec:
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def prior_sum(value: Column, w: WindowSpec) -> Column:
    """Sum over the rows before this one, nulls as 0, 0 on the first row. w is ordered by a total order."""
    return F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def prior_rate(value: Column, n: Column, w: WindowSpec) -> Column:
    """Null until there is history."""
    return F.try_divide(prior_sum(value, w).cast("double"), prior_sum(n, w).cast("double"))


def lags(c: str, w: WindowSpec, k: int) -> list[Column]:
    return [F.lag(c, i).over(w).alias(f"prev_{c}_{i}") for i in range(1, k + 1)]


def ordinal(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def is_last(c: str, keys: list[str]) -> Column:
    return F.col(c) == F.max(c).over(over(keys))


def share_of_total(n: Column, keys: list[str]) -> Column:
    return F.try_divide(F.lit(100.0) * n, F.sum(n).over(over(keys)))


def share_of_row(n: str, is_whole: Column, keys: list[str]) -> Column:
    """Percent of the group's one row that holds the total."""
    return F.try_divide(F.lit(100.0) * F.col(n), F.max(F.when(is_whole, F.col(n))).over(over(keys)))


def first_by_priority(df: DataFrame, keys: list[str], priority: Column, n: str, kind: str, min_n: int = 0) -> DataFrame:
    """One row a group: lowest priority number, then most rows, then the name: a total order."""
    rows = df.filter(F.col(n) >= min_n) if min_n else df
    w = over(keys, priority.asc_nulls_last(), F.col(n).desc_nulls_last(), F.col(kind).asc_nulls_last())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def masked_percent_rank(c: str, keys: list[str], shown: Column) -> Column:
    """Percent rank among all rows of the group (nulls last), displayed only where shown."""
    return F.when(shown, F.percent_rank().over(over(keys, F.col(c).asc_nulls_last())))


def average_rank(c: str, keys: list[str]) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(over(keys, c)) + (F.count(F.lit(1)).over(over([*keys, c])) - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Rank correlation by group over rows with both values; null under min_n rows or without variance."""
    ranked = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, average_rank(x, keys).alias("_x"), average_rank(y, keys).alias("_y"))
    r = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))  # corr raises where nothing varies
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= min_n, r).alias("spearman"))


def rank_auc(df: DataFrame, keys: list[str], score: str, positive: str, ties: str = "average") -> DataFrame:
    """(keys, n, auc): area under the ROC curve, null with one class only.

    Rows are first counted by score, so that what is ranked are the distinct scores. With keys, a group's scores are ranked
    in one window. Without keys there is one group only, whose scores would meet in one task: then they are dealt out by
    ranges of the score, ranked within a range, and the ranges' totals (a row a range) are added up before them.
    ties: "average" gives a tie of both classes a half; "low" counts it as lost, the reading that ignores ties.
    """
    half = {"average": 0.5, "low": 0.0}[ties]
    p = F.col(positive).cast("boolean")
    cells = df.filter(F.col(score).isNotNull() & p.isNotNull()).groupBy(*keys, score).agg(F.count_if(p).alias("_p"), F.count_if(~p).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if keys:
        won = cells.withColumn("_b", before(over(keys, score)))
    else:
        ranged = cells.repartitionByRange(score).withColumn("_r", F.spark_partition_id())
        totals = ranged.groupBy("_r").agg(F.sum("_n").alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        own = ranged.withColumn("_b", before(over(["_r"], score)))
        won = own.join(totals.select("_r", "_o"), "_r").withColumn("_b", F.col("_b") + F.col("_o"))
    n, m = F.sum("_p").cast("double"), F.sum("_n").cast("double")
    return won.groupBy(*keys).agg((F.sum("_p") + F.sum("_n")).alias("n"), F.try_divide(F.sum(F.col("_p") * (F.col("_b") + half * F.col("_n"))), n * m).alias("auc"))


def suffixed(label: str, keys: list[str], *order) -> Column:
    """label, label-2, label-3 ... in the given order."""
    rn = F.row_number().over(over([*keys, label], *order))
    return F.when(rn > 1, F.concat(F.col(label), F.lit("-"), rn.cast("string"))).otherwise(F.col(label))

"""Model metrics as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import rank_auc, spearman

EPS = 1e-15


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def binary_report(df: DataFrame, p: str, y: str) -> DataFrame:
    q, hit = clipped(F.col(p)), F.col(y).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(-(hit * F.log(q) + (1 - hit) * F.log(1 - q))).alias("log_loss"), F.avg((F.col(p) - hit) * (F.col(p) - hit)).alias("brier"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y) for bins (lo, hi]; p = 0 is in none."""
    b = F.ceil(F.col(p) * bins).cast("int")
    return df.filter(F.col(p) > 0).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))), F.sum("n").cast("double")).alias("ece"))


def multiclass_report(df: DataFrame, probs: str, y: str, k: int = 3) -> DataFrame:
    """Log-loss, top-1 and top-k over an array of class probabilities and a true class number."""
    p = F.get(F.col(probs), F.col(y))
    above = F.size(F.filter(probs, lambda v: v > p))
    return df.agg(F.count("*").alias("n"), F.avg(-F.log(clipped(p))).alias("log_loss"), F.avg((above < 1).cast("double")).alias("top1"), F.avg((above < k).cast("double")).alias("topk"))


def regression_report(df: DataFrame, p: str, y: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"))


def blended(general: str, own: str, n: str, prior: float = 1500.0, most: float = 0.4) -> Column:
    """Class probabilities mixed with an entity's own by w = most * n / (n + prior), renormalised."""
    w = F.col(n) / (F.col(n) + prior) * most
    mixed = F.zip_with(general, own, lambda a, b: a * (1 - w) + b * w)
    return F.transform(mixed, lambda v: F.try_divide(v, F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x)))


def masked(probs: str, allowed: str, factor: float = 0.03) -> Column:
    """Probabilities of classes outside the entity's repertoire damped, renormalised."""
    damped = F.zip_with(probs, allowed, lambda p, a: F.when(a, p).otherwise(p * factor))
    return F.transform(damped, lambda v: F.try_divide(v, F.aggregate(damped, F.lit(0.0), lambda s, x: s + x)))


def binary_report_with_rank(df: DataFrame, p: str, y: str) -> DataFrame:
    """Log-loss, Brier score, base rate and rank AUC in one row."""
    base = df.agg(F.avg(F.col(y).cast("double")).alias("base_rate"))
    return binary_report(df, p, y).join(base).join(rank_auc(df, [], p, y).select("auc"))


def confidence_bins(df: DataFrame, probs: str, y: str, bins: int = 10) -> DataFrame:
    """Calibration of the most likely class: (bin, n, mean_p, mean_y). y: the true class number."""
    top = F.array_max(probs)
    scored = df.select(top.alias("_c"), (F.array_position(probs, top) - 1 == F.col(y)).alias("_hit"))
    return calibration(scored, "_c", "_hit", bins)


def hit_rate(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(n, hits, pct): how often the first choice came true; null predictions miss."""
    hit = F.count_if(F.col(predicted) == F.col(actual))
    return df.agg(F.count("*").alias("n"), hit.alias("hits"), F.try_divide(F.lit(100.0) * hit, F.count("*")).alias("pct"))


def season_pairs(df: DataFrame, grade: str, actual: str, key: str = "pitcher", season: str = "season", least: int = 500) -> DataFrame:
    """Means of grade and result by entity and season of at least so many rows, beside those of the season after."""
    rows = df.filter(F.col(actual).isNotNull()).groupBy(key, season).agg(F.avg(grade).alias("grade"), F.avg(actual).alias("actual"), F.count("*").alias("n")).filter(F.col("n") >= least)
    after = rows.select(key, (F.col(season) - 1).alias(season), F.col("grade").alias("next_grade"), F.col("actual").alias("next_actual"))
    return rows.join(after, [key, season])


def season_correlations(pairs: DataFrame, of: dict[str, tuple[str, str]], season: str = "season", least: int = 20) -> DataFrame:
    """(season, entities, one Spearman a name) for seasons of at least so many entities."""
    counts = pairs.groupBy(season).agg(F.count("*").alias("entities")).filter(F.col("entities") >= least)
    for name, (a, b) in of.items():
        counts = counts.join(spearman(pairs, [season], a, b).select(season, F.col("spearman").alias(name)), season, "left")
    return counts


def mean_correlations(table: DataFrame, season: str = "season") -> DataFrame:
    """One row: the means over the seasons of a table of ``season_correlations``."""
    return table.agg(*[F.avg(c).alias(c) for c in table.columns if c not in (season, "entities")])


def stability(df: DataFrame, grade: str, actual: str, least: int = 500, entities: int = 20) -> DataFrame:
    """How well grade and result repeat from one season to the next."""
    return season_correlations(season_pairs(df, grade, actual, least=least), {"grade_yoy": ("grade", "next_grade"), "own_rv_yoy": ("actual", "next_actual")}, least=entities)


def predictive_validity(df: DataFrame, grade: str, actual: str, least: int = 500, entities: int = 20) -> DataFrame:
    """How well this season's grade, and this season's result, tell the next season's result."""
    return season_correlations(season_pairs(df, grade, actual, least=least), {"grade_vs_next": ("grade", "next_actual"), "own_rv_vs_next": ("actual", "next_actual")}, least=entities)


def aggregate_correlation(df: DataFrame, grade: str, actual: str, group: list[str], least: int = 100) -> DataFrame:
    """(n, spearman) of the groups' mean grade and mean result."""
    rows = df.filter(F.col(actual).isNotNull()).groupBy(*group).agg(F.avg(grade).alias("grade"), F.avg(actual).alias("actual"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return spearman(rows.withColumn("_all", F.lit(0)), ["_all"], "grade", "actual").drop("_all")

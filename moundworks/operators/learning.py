"""Usage baselines, repertoires, calibration, and clusters of shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that a baseline can tell apart: pitch types and event types are a fixed vocabulary.
MOST_KINDS = 1000


def usage_baseline(df: DataFrame, entity: str, bucket: str, kind: str, alpha: float = 1.0) -> DataFrame:
    """(entity, bucket, kind, p, own_p, league_p) for every entity and bucket seen: Laplace-smoothed shares in the bucket, over
    all of the entity's rows, and of the league."""
    counts, kinds, total = _counted(df, entity, bucket, kind)
    cells = counts.groupBy(entity, bucket).agg(F.map_from_entries(F.collect_list(F.struct(kind, "n"))).alias("cell"), F.sum("n").alias("t"))
    own = counts.groupBy(entity, kind).agg(F.sum("n").alias("n")).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(kind, "n"))).alias("own"), F.sum("n").alias("own_t"))
    rows = cells.join(own, entity).withColumn("k", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for v, n in kinds])))
    share = lambda n, t: (F.coalesce(n, F.lit(0)) + alpha) / (t + alpha * len(kinds))
    of = lambda m: F.try_element_at(m, F.col("k.v"))
    return rows.select(entity, bucket, F.col("k.v").alias(kind), share(of("cell"), F.col("t")).alias("p"), share(of("own"), F.col("own_t")).alias("own_p"), share(F.col("k.n"), F.lit(total)).alias("league_p"))


def _counted(df: DataFrame, entity: str, bucket: str, kind: str) -> tuple[DataFrame, list[tuple], int]:
    counts = df.filter(F.col(kind).isNotNull()).groupBy(entity, bucket, kind).agg(F.count("*").alias("n"))
    kinds = [(r[0], r.n) for r in counts.groupBy(kind).agg(F.sum("n").alias("n")).orderBy(kind).limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"{kind} has more than {MOST_KINDS} values: no vocabulary of kinds")
    return counts, kinds, sum(n for _, n in kinds)


def baseline_probabilities(df: DataFrame, train: DataFrame, entity: str, bucket: str, kind: str, classes: list[str], alpha: float = 1.0) -> DataFrame:
    """df with ``baseline``, an array of probabilities by class: the entity's in the bucket, else the entity's, else the
    league's. The league's is a literal, the others two left joins."""
    counts, kinds, _ = _counted(train.filter(F.col(kind).isin(*classes)), entity, bucket, kind)

    def shares(of: Column) -> Column:
        raw = F.array(*[F.coalesce(F.try_element_at(of, F.lit(c)), F.lit(0)) + alpha for c in classes])
        return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda s, x: s + x))

    packed = F.map_from_entries(F.collect_list(F.struct(kind, "n")))
    cells = counts.groupBy(entity, bucket).agg(packed.alias("m")).select(F.col(entity).alias("_e"), F.col(bucket).alias("_b"), shares(F.col("m")).alias("_cell"))
    own = counts.groupBy(entity, kind).agg(F.sum("n").alias("n")).groupBy(F.col(entity).alias("_o")).agg(packed.alias("m")).select("_o", shares(F.col("m")).alias("_own"))
    seen = dict(kinds)
    league = [seen.get(c, 0) + alpha for c in classes]
    joined = df.join(cells, (F.col(entity) == F.col("_e")) & (F.col(bucket) == F.col("_b")), "left").join(own, F.col(entity) == F.col("_o"), "left")
    return joined.withColumn("baseline", F.coalesce("_cell", "_own", F.array(*[F.lit(v / sum(league)) for v in league]))).drop("_e", "_b", "_cell", "_o", "_own")


def repertoire(df: DataFrame, entity: str, kind: str, least: int = 5) -> DataFrame:
    """(entity, kinds): the kinds that an entity has shown at least so often, sorted."""
    shown = df.filter(F.col(kind).isNotNull()).groupBy(entity, kind).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return shown.groupBy(entity).agg(F.array_sort(F.collect_set(kind)).alias("kinds"))


def plus_scale(df: DataFrame, value: str, group: list[str], least: int = 100, groups: int = 30) -> tuple[float, float]:
    """Mean and sample deviation (1 where it is 0) of the means of groups of at least ``least`` rows: one row reaches the
    driver. Raises under so many groups."""
    means = group_means(df, value, group, least)
    r = means.agg(F.count("*").alias("n"), F.avg("mean").alias("m"), F.stddev_samp("mean").alias("s")).collect()[0]
    if r.n < groups:
        raise ValueError(f"only {r.n} groups have {least} rows; {groups} are needed for a scale")
    return r.m, r.s if r.s and r.s > 0 else 1.0


def group_means(df: DataFrame, value: str, group: list[str], least: int) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= least)


def plus(value: Column, mean: float, sd: float) -> Column:
    return F.lit(100.0) + (value - mean) / sd * 10.0


def mixture(x: np.ndarray, means: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, tuple]:
    """BIC and (shares, means, covariances) of a Gaussian mixture with full covariances fitted by EM from the given means."""
    n, d = x.shape
    k = len(means)
    cov, mix, mu = np.stack([np.cov(x.T) + ridge * np.eye(d)] * k), np.full(k, 1 / k), means.copy()
    for _ in range(rounds):
        logs = log_parts(x, mix, mu, cov)
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        r = np.exp(logs - total[:, None])
        mix = r.mean(axis=0)
        for j in range(k):
            w = r[:, j] / max(r[:, j].sum(), 1e-9)
            mu[j] = w @ x
            cov[j] = ((x - mu[j]) * w[:, None]).T @ (x - mu[j]) + ridge * np.eye(d)
    free = (k - 1) + k * d + k * d * (d + 1) // 2
    return float(-2 * total.sum() + free * np.log(n)), (mix, mu, cov)


def log_parts(x: np.ndarray, mix: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Logarithm of each component's share of the density, a column a component."""
    logs = np.empty((len(x), len(mu)))
    for j in range(len(mu)):
        c = np.linalg.cholesky(cov[j])
        z = np.linalg.solve(c, (x - mu[j]).T)
        logs[:, j] = np.log(mix[j] + 1e-300) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(c)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return logs


def bic(x: np.ndarray, means: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> float:
    """Of a Gaussian mixture with full covariances fitted by EM from the given means."""
    return mixture(x, means, rounds, ridge)[0]


def sampled(x: np.ndarray, most: int = 500) -> np.ndarray:
    return x[np.random.default_rng(0).choice(len(x), most, replace=False)] if len(x) > most else x


def two_shapes(x: np.ndarray, means: np.ndarray, gain: float = 10.0, most: int = 500, least: int = 60) -> bool:
    """Whether two Gaussians describe standardised points better than one, by more than gain in BIC."""
    if len(x) < least:
        return False
    x = sampled(x, most)
    return bic(x, x.mean(axis=0, keepdims=True)) - bic(x, means) > gain


def halves(x: np.ndarray, starts: int = 4, rounds: int = 30) -> np.ndarray:
    """Means of two groups by the best of several 2-means runs from points drawn far from each other."""
    rng, best = np.random.default_rng(0), None
    for _ in range(starts):
        first = x[rng.integers(len(x))]
        far = ((x - first) ** 2).sum(axis=1)
        if far.sum() == 0:
            return np.stack([first, first])
        mu = np.stack([first, x[rng.choice(len(x), p=far / far.sum())]])
        for _ in range(rounds):
            d = ((x[:, None, :] - mu[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            mu = np.stack([x[near == j].mean(axis=0) if (near == j).any() else mu[j] for j in (0, 1)])
        if best is None or d.min(axis=1).sum() < best[0]:
            best = d.min(axis=1).sum(), mu
    return best[1]


def split_once(x: np.ndarray, days: np.ndarray, gain: float = 10.0, share: float = 0.1, least: int = 30, drift: float = 0.85) -> np.ndarray | None:
    """Which points are the second of two shapes; None where they are one shape, where the smaller is under share or least
    points, or where the date alone tells them apart (AUC over drift, either way): a change in the season, not two shapes."""
    if len(x) < 2 * least:
        return None
    some = sampled(x)
    two, parts = mixture(some, halves(some))
    if bic(some, some.mean(axis=0, keepdims=True)) - two <= gain:
        return None
    second = log_parts(x, *parts).argmax(axis=1) == 1
    n = int(second.sum())
    small = min(n, len(x) - n)
    if small < least or small < share * len(x):
        return None
    known = ~np.isnan(days)
    n, others = int(second[known].sum()), int((~second)[known].sum())
    auc = (pd.Series(days[known]).rank().to_numpy()[second[known]].sum() - n * (n + 1) / 2) / (n * others) if n and others else 0.5
    return None if max(auc, 1 - auc) > drift else second


CLUSTERS = "cluster_id int, label string, n long, usage_pct double, velo_avg double, ivb_in double, hb_arm_in double, release_extension_avg double, spin_axis_arm_deg double, savant_majority string, purity double, n_savant_labels int, cluster_k int, savant_pitch_types int, arsenal_size_diff int, season_purity double"
#: Usage from which a label counts as one of the entity's.
LABEL_SHARE = 0.05


def merged_groups(x: np.ndarray, names: np.ndarray) -> list[np.ndarray]:
    """Row numbers by group: labels whose shapes aren't two are one, pairs of under 60 rows always."""
    order = sorted(set(names))
    root = {n: n for n in order}

    def find(n):
        return n if root[n] == n else find(root[n])

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = x[(names == a) | (names == b)]
            means = np.stack([x[names == a].mean(axis=0), x[names == b].mean(axis=0)])
            if not two_shapes(both, means):  # so too where they are too few to be told apart
                root[find(b)] = find(a)
    of = np.array([find(n) for n in names])
    return [np.flatnonzero(of == r) for r in sorted(set(of))]


def cluster_rows(frame: pd.DataFrame, columns: list[str], label: str) -> list[list]:
    """A row a cluster of one entity-season, as in CLUSTERS. frame has columns, label, _day and the five shown."""
    raw = frame[columns].to_numpy(dtype=float)
    x = (raw - raw.mean(axis=0)) / np.where(raw.std(axis=0) == 0, 1, raw.std(axis=0))
    names, days = frame[label].to_numpy(), frame["_day"].to_numpy()
    clusters = []
    for own in merged_groups(x, names):
        second = split_once(x[own], days[own])
        clusters += [own] if second is None else [own[~second], own[second]]
    clusters.sort(key=len, reverse=True)
    counts = [pd.Series(names[own]).value_counts().sort_index().sort_values(ascending=False, kind="stable") for own in clusters]
    shown, velo = [c.index[0] for c in counts], [raw[own, 0].mean() for own in clusters]
    for name in set(shown):
        same = sorted((i for i, c in enumerate(counts) if c.index[0] == name), key=lambda i: -velo[i])
        for place, i in enumerate(same[1:], 2):
            shown[i] = f"{name}-{place}"
    n = len(frame)
    labels = int((pd.Series(names).value_counts() >= LABEL_SHARE * n).sum())
    purity = sum(int(c.iloc[0]) for c in counts) / n
    out = []
    for i, (own, c) in enumerate(zip(clusters, counts, strict=True)):
        part = frame.iloc[own]
        mean = lambda name, part=part: None if part[name].isna().all() else float(part[name].mean())
        sin, cos = mean("spin_axis_sin"), mean("spin_axis_cos")
        turn = None if sin is None or cos is None else float(np.degrees(np.arctan2(sin, cos)) % 360)
        out.append([i, shown[i], len(own), 100.0 * len(own) / n, mean("release_speed"), mean("ivb_in"), mean("hb_arm_in"), mean("release_extension"), turn, str(c.index[0]), float(c.iloc[0] / len(own)), len(c), len(clusters), labels, len(clusters) - labels, purity])
    return out


def shape_clusters(df: DataFrame, keys: list[str], label: str, columns: list[str], min_rows: int = 200, date: str | None = None) -> DataFrame:
    """(keys, then CLUSTERS): labels whose shapes aren't two are merged; then each group of two shapes is split once, if date
    doesn't tell them apart (without one, no split is ruled out by it). Clusters of one label get the suffixes -2, -3, by
    falling mean of the first column. spin_axis_arm_deg is a circular mean.

    One group is one entity-season of thousands of rows at most; the fits inside take 500 points.
    """
    types = dict(df.dtypes)
    shown = ["release_speed", "ivb_in", "hb_arm_in", "release_extension", "spin_axis_sin", "spin_axis_cos"]
    schema = f"{', '.join(f'`{k}` {types[k]}' for k in keys)}, {CLUSTERS}"
    names = [*keys, *(c.split()[0] for c in CLUSTERS.split(", "))]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=[*columns, label])
        if len(frame) < min_rows:
            return pd.DataFrame(columns=names)
        own = frame[keys].iloc[0].tolist()
        return pd.DataFrame([[*own, *row] for row in cluster_rows(frame, columns, label)], columns=names)

    day = (F.unix_date(F.col(date).cast("date")) if date else F.lit(0)).cast("double").alias("_day")
    taken = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in dict.fromkeys([*columns, *shown])]
    return df.select(*keys, label, *taken, day).groupBy(*keys).applyInPandas(fit, schema)

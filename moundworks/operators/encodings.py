"""Entities as vectors of their repertoire, maps of them, and archetypes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import velocity_tier
from .windows import suffixed


def slot_encoding(df: DataFrame, keys: list[str], usage: str, values: list[str], slots: int = 6, tie: str = "kind") -> DataFrame:
    """One array a group: for the slots by falling usage the usage and the values; empty slots have usage 0 and the means."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(usage).desc(), F.col(tie)))
    means = df.agg(*[F.avg(v).alias(f"_m_{v}") for v in values])  # one row
    ranked = df.withColumn("_slot", rank).filter(F.col("_slot") <= slots)
    packed = ranked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_slot", F.struct(F.col(usage).cast("double").alias("u"), *[F.col(v).cast("double").alias(v) for v in values])))).alias("m"))
    packed = packed.join(F.broadcast(means))
    one = lambda s: [F.coalesce(F.try_element_at("m", F.lit(s))["u"], F.lit(0.0)), *[F.coalesce(F.try_element_at("m", F.lit(s))[v], F.col(f"_m_{v}")) for v in values]]
    return packed.select(*keys, F.array(*[c for s in range(1, slots + 1) for c in one(s)]).alias("vector"))


def histogram_encoding(df: DataFrame, keys: list[str], usage: str, speed: str, angle: Column, bins: int = 8) -> DataFrame:
    """One array of bins * bins usage sums a group: by quantiles of the speed over all rows (exact) and by equal angles."""
    cuts = df.agg(F.percentile(speed, [i / bins for i in range(1, bins)]).alias("_cuts"))  # one row
    rows = df.withColumn("_angle", angle).join(F.broadcast(cuts))
    s = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (F.col(speed) >= c).cast("int"))
    a = F.least(F.floor((F.col("_angle") + 180.0) / (360.0 / bins)), F.lit(bins - 1)).cast("int")
    cells = rows.withColumn("_cell", s * bins + a).groupBy(*keys, "_cell").agg(F.sum(usage).cast("double").alias("_u"))
    packed = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_u"))).alias("m"))
    return packed.select(*keys, F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in range(bins * bins)]).alias("vector"))


def standardised_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Each place of the array less its mean over its population deviation (1 where that is 0). The moments are one row."""
    places = df.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    moments = places.agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("_z"))
    scaled = F.zip_with(vector, "_z", lambda v, z: (v - z["m"]) / z["s"])
    return df.join(F.broadcast(moments)).withColumn(vector, scaled).drop("_z")


def pca_map(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, x, y): the first two principal components, each turned so that its largest loading is positive."""
    v = df.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(v)
    load = model.pc.toArray()
    sign = [1.0 if load[np.abs(load[:, c]).argmax(), c] > 0 else -1.0 for c in (0, 1)]
    mean = v.select(F.posexplode(vector_to_array("features")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
    centre = np.array([r.m for r in mean]) @ load if mean else np.zeros(2)
    xy = vector_to_array("xy")
    return model.transform(v).select(*keys, *[((F.get(xy, F.lit(c)) - float(centre[c])) * sign[c]).alias("xy"[c]) for c in (0, 1)])


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """Exact t-SNE from the principal components, for marts of a few thousand rows: memory grows with the square."""
    n = len(x)
    perplexity = min(perplexity, max(n - 1, 1))
    square = (x * x).sum(axis=1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    p = np.zeros((n, n))
    for i in range(n):  # the width that gives each point its perplexity, by bisection
        own = np.delete(d[i], i)
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(own - own.min()) * beta)
            share = w / w.sum()
            entropy = -(share * np.log(share + 1e-300)).sum()
            if abs(entropy - np.log(perplexity)) < 1e-5:
                break
            low, high = (beta, high) if entropy > np.log(perplexity) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i, np.arange(n) != i] = share
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    y = (u[:, :2] * s[:2]) if s.size > 1 else np.random.default_rng(seed).normal(size=(n, 2))
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4
    step, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(n / 12.0 / 4, 50.0)
    for r in range(rounds):
        s2 = (y * y).sum(axis=1)
        w = 1 / (1 + np.maximum(s2[:, None] + s2[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(w, 0)
        pull = ((12.0 if r < 250 else 1.0) * p - np.maximum(w / w.sum(), 1e-12)) * w
        grad = 4 * (pull.sum(axis=1)[:, None] * y - pull @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if r < 250 else 0.8) * step - rate * gain * grad
        y = y + step
    return y


def reduced(spark: SparkSession, df: DataFrame, keys: list[str], how: str = "tsne", vector: str = "vector", most: int = 20_000) -> DataFrame:
    """(keys, x, y). PCA is distributed; t-SNE runs on the driver over a mart of at most ``most`` rows and refuses more."""
    if how == "pca":
        return pca_map(df, keys, vector)
    if how == "umap":
        raise NotImplementedError("umap is not available offline; take pca or tsne")
    if how != "tsne":
        raise ValueError(f"{how!r} is none of pca, tsne, umap")
    rows = df.select(*keys, vector).orderBy(*keys).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"t-SNE takes at most {most} rows; take pca")
    types = dict(df.dtypes)
    y = tsne(np.array([r[vector] for r in rows], dtype=float)) if len(rows) > 2 else np.zeros((len(rows), 2))
    return spark.createDataFrame([(*(r[k] for k in keys), float(a), float(b)) for r, (a, b) in zip(rows, y, strict=True)], ", ".join([*(f"`{k}` {types[k]}" for k in keys), "x double", "y double"]))


def archetypes(df: DataFrame, keys: list[str], vector: str = "vector", ks: range = range(4, 13), seed: int = 0) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(keys, archetype_id) by k-means, k by the best silhouette; and the silhouette of every k."""
    v = df.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    scores, best = [], None
    for k in ks:
        out = KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v)
        scores.append((k, float(ClusteringEvaluator().evaluate(out))))
        if best is None or scores[-1][1] > best[0]:
            best = scores[-1][1], out
    return best[1].select(*keys, F.col("prediction").alias("archetype_id")), scores


def most_common(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label): the commonest non-null label, ties by name."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("_n"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("v"))).alias("x")).select(key, F.col("x.v").alias(label))


def archetype_names(members: DataFrame) -> DataFrame:
    """(archetype_id, archetype_label) from members' primary_label, secondary_label and primary_velo: the commonest two labels
    and the velocity tier; archetypes of one name get -2, -3, the hardest first."""
    speed = members.groupBy("archetype_id").agg(F.avg("primary_velo").alias("velo"))
    named = speed.join(most_common(members, "archetype_id", "primary_label"), "archetype_id", "left").join(most_common(members, "archetype_id", "secondary_label"), "archetype_id", "left")
    pair = F.concat(F.col("primary_label"), F.coalesce(F.concat(F.lit("/"), F.col("secondary_label")), F.lit("")))
    base = named.withColumn("_name", F.concat(pair, F.lit(" · "), velocity_tier(F.col("velo"))))
    return base.select("archetype_id", suffixed("_name", [], F.desc("velo"), F.col("archetype_id")).alias("archetype_label"))


def primary_and_secondary(df: DataFrame, keys: list[str], usage: str, label: str, velo: str, tie: str = "cluster_id") -> DataFrame:
    """(keys, primary_label, primary_velo, secondary_label): the two most used, in one aggregate."""
    order = F.struct(-F.col(usage), F.col(tie), F.col(label).alias("label"), F.col(velo).alias("velo"))
    ranked = df.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("r"))
    return ranked.select(*keys, F.get("r", F.lit(0))["label"].alias("primary_label"), F.get("r", F.lit(0))["velo"].alias("primary_velo"), F.get("r", F.lit(1))["label"].alias("secondary_label"))

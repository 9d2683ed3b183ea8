"""Marts over the pitch table. Each is one declarative plan; scored columns come from whatever model wrote them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import encodings, grid, windows
from ..operators.learning import shape_clusters
from ..operators.neighbors import nearest
from ..operators.relops import qualified, rollup_all

FASTBALLS = ("FF", "SI", "FA", "FC")


def competitive(df: DataFrame) -> DataFrame:
    return df.filter("is_tracked_pitch and is_competitive and game_type = 'R'")


def pitcher_arsenal(df: DataFrame) -> DataFrame:
    """Usage, shape, outcome rates and percentile ranks by pitcher, season and pitch type. Run values are the pitcher's."""
    c = F.col
    whole = lambda name: F.sum(c(name).cast("int"))
    n = F.count("*")
    agg = competitive(df).filter("pitch_type is not null").groupBy(c("pitcher").alias("mlbam_id"), "season", "pitch_type").agg(
        F.any_value("pitch_name", True).alias("pitch_name"), F.any_value("p_throws", True).alias("p_throws"), n.alias("pitches"),
        F.avg("release_speed").alias("velo_avg"), F.max("release_speed").alias("velo_max"), F.stddev_samp("release_speed").alias("velo_sd"),
        F.avg("release_spin_rate").alias("spin_avg"), F.avg("release_extension").alias("extension_avg"), F.avg("ivb_in").alias("ivb_in"),
        F.avg("hb_arm_in").alias("hb_arm_in"), F.avg("arm_angle").alias("arm_angle"), F.avg("spin_axis").alias("spin_axis"),
        whole("is_swing").alias("swings"), whole("is_whiff").alias("whiffs"), F.try_divide(F.lit(100.0) * whole("is_whiff"), whole("is_swing")).alias("whiff_pct"),
        *[(F.lit(100.0) * whole(f"is_{a}") / n).alias(f"{b}_pct") for a, b in (("csw", "csw"), ("in_zone", "zone"), ("chase", "chase"))],
        F.avg("estimated_woba_using_speedangle").alias("xwoba"), F.avg("launch_speed").alias("exit_velo_avg"), (F.lit(100.0) * F.sum(-c("delta_run_exp")) / n).alias("rv_per_100"),
    )
    key = ["mlbam_id", "season"]
    agg = agg.withColumns({"usage_pct": windows.share_of_total(c("pitches"), key), "season_pitches": F.sum("pitches").over(windows.over(key))})
    heat = windows.first_by_priority(agg.filter(c("pitch_type").isin(*FASTBALLS)), key, F.when(c("pitch_type") == "FC", 1).otherwise(0), "pitches", "pitch_type")
    heat = heat.select(*key, c("velo_avg").alias("_velo"), c("ivb_in").alias("_ivb"), c("hb_arm_in").alias("_hb"))
    out = agg.join(heat, key, "left").withColumns({"velo_diff_fb": c("velo_avg") - c("_velo"), "ivb_diff_fb": c("ivb_in") - c("_ivb"), "hb_diff_fb": c("hb_arm_in") - c("_hb")})
    enough = c("pitches") >= 50
    ranks = {"pct_velo": "velo_avg", "pct_whiff": "whiff_pct", "pct_csw": "csw_pct", "pct_rv": "rv_per_100"}
    return out.withColumns({k: windows.masked_percent_rank(v, ["season", "pitch_type"], enough) for k, v in ranks.items()}).drop("_velo", "_ivb", "_hb")


def pitcher_stuff(scored: DataFrame, min_pitches: int = 25) -> DataFrame:
    """Averages of the three scores by pitch type and over ALL, with usage against the ALL row."""
    aggs = [F.round(F.avg(c), 1).alias(c) for c in ("stuff_plus", "location_plus", "pitching_plus")] + [F.round(F.lit(100.0) * F.avg("rv_pitcher"), 3).alias("rv_per_100"), F.count("*").alias("pitches")]
    rows = rollup_all(scored.withColumnRenamed("pitcher", "mlbam_id"), ["mlbam_id", "season"], "pitch_type", aggs).filter(F.col("pitches") >= min_pitches)
    return rows.withColumn("usage_pct", F.round(windows.share_of_row("pitches", F.col("pitch_type") == "ALL", ["mlbam_id", "season"]), 1))


def plane_values(swings: DataFrame, min_swings: int = 200) -> DataFrame:
    """(mlbam_id, season, plane_value_per_100, attack_angle, swings) of swings with a plane_value."""
    rows = swings.groupBy(F.col("batter").alias("mlbam_id"), "season").agg(F.round(F.lit(100.0) * F.avg("plane_value"), 3).alias("plane_value_per_100"), F.round(F.avg("attack_angle"), 2).alias("attack_angle"), F.count("*").alias("swings"))
    return rows.filter(F.col("swings") >= min_swings)


def batter_swing(whiff: DataFrame, contact: DataFrame, min_swings: int = 200) -> DataFrame:
    """Each head over its own rows; contact is null where its rows are too few."""
    key = ["mlbam_id", "season"]
    a = plane_values(whiff, min_swings).withColumnsRenamed({"plane_value_per_100": "whiff_plane_value_per_100", "swings": "whiff_swings"})
    b = plane_values(contact, min_swings).select(*key, F.col("plane_value_per_100").alias("contact_plane_value_per_100"), F.col("swings").alias("contact_swings"))
    return a.join(b, key, "left")


def framing_runs(takes: DataFrame, who: str, p: str, strike_value: str, min_n: int = 500) -> DataFrame:
    """(mlbam_id, season, framing_runs, n). Takes without an entity belong to nobody and go first."""
    gain = (F.col("is_called_strike").cast("double") - F.col(p)) * F.col(strike_value)
    rows = takes.filter(F.col(who).isNotNull()).groupBy(F.col(who).alias("mlbam_id"), "season")
    return rows.agg(F.sum(gain).alias("framing_runs"), F.count("*").alias("n")).filter(F.col("n") >= min_n)


def umpire_zone(takes: DataFrame, p: str, strike_value: str, min_n: int = 500) -> DataFrame:
    """Borderline rates (0.2 <= p <= 0.8) with framing runs beside them, for all seasons in one pass."""
    edge = takes.filter(F.col("umpire_hp").isNotNull() & F.col(p).between(0.2, 0.8)).groupBy(F.col("umpire_hp").alias("mlbam_id"), "season")
    rates = edge.agg(F.avg(F.col("is_called_strike").cast("double")).alias("actual_rate"), F.avg(p).alias("expected_rate"), F.count("*").alias("n")).filter(F.col("n") >= min_n)
    framing = framing_runs(takes, "umpire_hp", p, strike_value, 0).withColumnRenamed("n", "framing_n")
    return rates.withColumn("edge", F.col("actual_rate") - F.col("expected_rate")).join(framing, ["mlbam_id", "season"], "left")


ZONE_METRICS = {
    "xwoba": ("is_in_play", "estimated_woba_using_speedangle", 1.0), "whiff": ("is_swing", "is_whiff", 100.0), "swing": (None, "is_swing", 100.0),
    "exit_velo": ("is_in_play", "launch_speed", 1.0), "run_value": (None, "delta_run_exp", 1.0),
}


def _profile(arrays: DataFrame, keys: list[str], **constants: str) -> DataFrame:
    named = [F.lit(v).alias(k) for k, v in constants.items()]
    return arrays.select(*keys, *named, F.col("n").alias("n_pitches"), "grid_n", F.col("surface").cast("array<float>").alias("surface"), F.col("reliability").cast("array<float>").alias("reliability"))


def zone_profiles(df: DataFrame, role: str, spec: dict = grid.ZONE) -> DataFrame:
    """Surfaces of all metrics for each batter or pitcher season, in one pass over rows stacked by metric."""
    rows = competitive(df).filter(F.col("plate_x").isNotNull() & F.col("plate_z_norm").isNotNull())
    rows = qualified(rows, [role, "season"], spec["min_rows"])
    values = [F.struct(F.lit(m).alias("metric"), (F.when(F.col(s) if s else F.lit(True), F.col(v).cast("double")) * scale).alias("value")) for m, (s, v, scale) in ZONE_METRICS.items()]
    stacked = rows.select(F.col(role).alias("mlbam_id"), "season", "plate_x", "plate_z_norm", F.explode(F.array(*values)).alias("m")).select("mlbam_id", "season", "plate_x", "plate_z_norm", "m.metric", "m.value")
    arrays = grid.smooth_arrays(stacked, ["mlbam_id", "season", "metric"], "plate_x", "plate_z_norm", "value", spec)
    return _profile(arrays, ["mlbam_id", "season", "metric"], role=role)


def entity_grids(frame: DataFrame, who: str, role: str, metric: str, value: Column, min_rows: int = 500, spec: dict = grid.ZONE) -> DataFrame:
    """One surface of any value for each entity's season; rows of no entity are left out before they are counted."""
    rows = qualified(frame.withColumn("_w", value), [who, "season"], min_rows).withColumnRenamed(who, "mlbam_id")
    return _profile(grid.smooth_arrays(rows, ["mlbam_id", "season"], "plate_x", "plate_z_norm", "_w", spec), ["mlbam_id", "season"], role=role, metric=metric)


def catcher_grid(takes: DataFrame, p: str, min_rows: int = 500) -> DataFrame:
    """Where a catcher gains or loses calls: the called strike less its probability."""
    return entity_grids(takes, "fielder_2", "catcher", "framing", F.col("is_called_strike").cast("double") - F.col(p), min_rows)


def umpire_grid(takes: DataFrame, min_rows: int = 500) -> DataFrame:
    """An umpire's own rate of called strikes, in percent."""
    return entity_grids(takes, "umpire_hp", "umpire", "strike_rate", F.col("is_called_strike").cast("double") * 100.0, min_rows)


def batter_spray(df: DataFrame, spec: dict = grid.SPRAY) -> DataFrame:
    rows = competitive(df).filter("is_in_play and x_ft is not null and y_ft is not null")
    rows = qualified(rows, ["batter", "season"], spec["min_rows"]).withColumnRenamed("batter", "mlbam_id")
    counts = rows.groupBy("mlbam_id", "season").agg(F.count("*").alias("n_batted_balls"))
    arrays = grid.smooth_arrays(rows, ["mlbam_id", "season"], "x_ft", "y_ft", "estimated_woba_using_speedangle", spec)
    return _profile(arrays, ["mlbam_id", "season"]).drop("n_pitches").join(counts, ["mlbam_id", "season"])


def arsenal_clusters(df: DataFrame, first_season: int = 2020, min_pitches: int = 200) -> DataFrame:
    rows = df.filter(F.col("season") >= first_season).filter("is_tracked_pitch and is_competitive").withColumnRenamed("pitcher", "mlbam_id")
    return shape_clusters(rows, ["mlbam_id", "season"], "pitch_type", S.CLUSTER, min_pitches, "game_date")


SEASON = ["mlbam_id", "season"]


def encoded(clusters: DataFrame, encoding: str = "slot") -> DataFrame:
    """(mlbam_id, season, vector), standardised, of the cluster mart."""
    turn = F.radians("spin_axis_arm_deg")
    rows = clusters.withColumns({"spin_axis_sin": F.sin(turn), "spin_axis_cos": F.cos(turn)})
    if encoding == "slot":
        vectors = encodings.slot_encoding(rows, SEASON, "usage_pct", ["velo_avg", "ivb_in", "hb_arm_in", "spin_axis_sin", "spin_axis_cos"], 6, "cluster_id")
    elif encoding == "histogram":
        vectors = encodings.histogram_encoding(rows, SEASON, "usage_pct", "velo_avg", F.degrees(F.atan2("ivb_in", "hb_arm_in")))
    else:
        raise ValueError(f"{encoding!r} is neither slot nor histogram")
    return encodings.standardised_vectors(vectors)


def arsenal_embedding(spark: SparkSession, clusters: DataFrame, encoding: str = "slot", reducer: str = "tsne") -> tuple[DataFrame, list[tuple[int, float]]]:
    """A row a pitcher-season: its place on the map, archetype and name, and what the cluster mart says of the season; and the
    silhouettes of the archetypes' numbers."""
    vectors = encoded(clusters, encoding)
    members, scores = encodings.archetypes(vectors, SEASON)
    about = clusters.groupBy(*SEASON).agg(*[F.any_value(c, True).alias(c) for c in ("cluster_k", "savant_pitch_types", "arsenal_size_diff", "season_purity")], F.sum("n").alias("n_pitches"))
    two = encodings.primary_and_secondary(clusters, SEASON, "usage_pct", "label", "velo_avg")
    members = members.join(two, SEASON)
    out = members.join(encodings.archetype_names(members), "archetype_id").join(about, SEASON).join(encodings.reduced(spark, vectors, SEASON, reducer), SEASON)
    return out.select(*SEASON, "x", "y", "archetype_id", "archetype_label", "cluster_k", "savant_pitch_types", "arsenal_size_diff", "season_purity", "n_pitches", "primary_label", "primary_velo", F.lit(reducer).alias("reducer")), scores


def arsenal_neighbors(spark: SparkSession, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(mlbam_id, season, rank, neighbor_id, neighbor_season, distance) in the feature space, not on the map."""
    keyed = vectors.select((F.col("mlbam_id") * 10_000 + F.col("season")).alias("key"), "vector")
    found = nearest(spark, keyed, "key", "vector", k)
    part = lambda c: (F.floor(F.col(c) / 10_000).alias("a"), (F.col(c) % 10_000).cast("int").alias("b"))
    (a, b), (c, d) = part("key"), part("neighbor")
    return found.select(a.alias("mlbam_id"), b.alias("season"), "rank", c.alias("neighbor_id"), d.alias("neighbor_season"), "distance")


def cluster_stability(clusters: DataFrame) -> DataFrame:
    """(pairs, cluster_k_yoy, arsenal_size_diff_yoy): rank correlations of a pitcher's consecutive seasons."""
    seasons = clusters.groupBy(*SEASON).agg(*[F.any_value(c, True).alias(c) for c in ("cluster_k", "arsenal_size_diff")])
    after = seasons.select("mlbam_id", (F.col("season") - 1).alias("season"), *[F.col(c).alias(f"next_{c}") for c in ("cluster_k", "arsenal_size_diff")])
    both = seasons.join(after, SEASON).withColumn("_all", F.lit(0))
    out = both.groupBy("_all").agg(F.count("*").alias("pairs"))
    for c in ("cluster_k", "arsenal_size_diff"):
        out = out.join(windows.spearman(both, ["_all"], c, f"next_{c}").select("_all", F.col("spearman").alias(f"{c}_yoy")), "_all", "left")
    return out.drop("_all")


def bake_off(spark: SparkSession, clusters: DataFrame, reducers: tuple[str, ...] = ("pca", "tsne")) -> list[dict]:
    """Trustworthiness and the next season's place for every encoding and reducer; a mart of thousands of rows."""
    import numpy as np

    from ..operators.neighbors import next_season_rank, trustworthiness

    out = []
    for encoding in ("slot", "histogram"):
        vectors = encoded(clusters, encoding)
        for how in reducers:
            rows = encodings.reduced(spark, vectors, SEASON, how).join(vectors, SEASON)
            got = rows.select("vector", "x", "y").collect()
            trust = trustworthiness(np.array([r.vector for r in got]), np.array([[r.x, r.y] for r in got]))
            out.append({"encoding": encoding, "reducer": how, "trustworthiness": trust, "yoy_neighbor_rank": next_season_rank(rows, "mlbam_id", "season", "x", "y").collect()[0]["rank"]})
    return out


def spot_check(rows: DataFrame, entity: int, k: int = 5) -> DataFrame:
    """The k nearest on the map to an entity's latest season."""
    own = rows.filter(F.col("mlbam_id") == entity).orderBy(F.desc("season")).limit(1).select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("season").alias("_s"))
    others = rows.join(F.broadcast(own)).filter((F.col("mlbam_id") != entity) | (F.col("season") != F.col("_s")))  # own is one row
    return others.withColumn("distance", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).orderBy("distance", *SEASON).limit(k).drop("_x", "_y", "_s")

"""The models of the domain: next pitch, place, pitch quality, swings, called strikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as E
from ..functions.pitches import check_features, check_sets, rows_for
from ..functions.splits import Split
from ..operators import metrics
from ..operators.learning import baseline_probabilities, plus, plus_scale, repertoire
from .boosted import Boosted

NEXT_CATEGORIES = ["stand", "p_throws", "prev_pitch_type_1", "prev_pitch_type_2", "prev_pitch_type_3", "last_pitch_type_vs_batter", "home_team"]
FOREST, TREES = {"numTrees": 40, "maxDepth": 9, "minInstancesPerNode": 20}, {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1}


def next_pitch(split: Split, params: dict | None = None) -> Boosted:
    """P(type) from what is known before the pitch."""
    check_features(S.NEXT_PITCH)
    return Boosted("classes", S.NEXT_PITCH, NEXT_CATEGORIES, S.PITCH_TYPES, FOREST | (params or {})).fit(split.train, "target_pitch_type")


def location(split: Split, params: dict | None = None) -> Boosted:
    """P(cell) over the 25 cells and the far misses."""
    check_features(S.NEXT_PITCH)
    cells = [str(i) for i in range(26)]
    return Boosted("classes", S.NEXT_PITCH, NEXT_CATEGORIES, cells, FOREST | (params or {})).fit(split.train, F.col("target_location").cast("string"))


def kept_to_repertoire(scored: DataFrame, train: DataFrame, factor: float = 0.03, least: int = 5) -> DataFrame:
    """Types that a pitcher hasn't shown are damped, for pitchers who have shown any."""
    shown = repertoire(train, "pitcher", "target_pitch_type", least).select(F.col("pitcher").alias("_p"), "kinds")
    joined = scored.join(shown, F.col("pitcher") == F.col("_p"), "left")
    allowed = F.transform(F.array(*map(F.lit, S.PITCH_TYPES)), lambda t: F.coalesce(F.array_contains("kinds", t), F.lit(True)))
    return joined.withColumn("_a", allowed).withColumn("probability", metrics.masked("probability", "_a", factor)).drop("_p", "kinds", "_a")


def personal(scored: DataFrame, train: DataFrame) -> DataFrame:
    """Blended with each pitcher's own rates, by how much of him has been seen."""
    bucket = E.count_bucket(F.col("balls"), F.col("strikes"))
    own = baseline_probabilities(scored.withColumn("_bucket", bucket), train.withColumn("_bucket", bucket), "pitcher", "_bucket", "target_pitch_type", S.PITCH_TYPES)
    seen = F.coalesce("prior_pitches_seen", F.lit(0))
    return own.withColumn("_n", seen).withColumn("probability", metrics.blended("probability", "baseline", "_n")).drop("_bucket", "_n", "baseline")


def class_number(target: str, classes: list[str]) -> Column:
    return E.mapped(F.col(target).cast("string"), {c: i for i, c in enumerate(classes)})


QUALITY = {"stuff": S.STUFF, "location": S.LOCATION, "pitching": list(dict.fromkeys([*S.STUFF, *S.LOCATION]))}


def pitch_quality(role: str, train: DataFrame, valid: DataFrame | None = None, params: dict | None = None, least: int = 100, groups: int = 30) -> Boosted:
    """Run value from the pitch itself; ``plus`` scales it by the means of pitcher, season and type in training."""
    check_sets()
    features = QUALITY[role]
    model = Boosted("number", features, [c for c in ("pitch_type",) if c in features], [], TREES | (params or {})).fit(train, "rv_pitcher", valid)
    mean, sd = plus_scale(model.predict(train), "prediction", ["pitcher", "season", "pitch_type"], least, groups)
    model.extra = {"role": role, "plus_mean": mean, "plus_sd": sd}
    return model


def graded(model: Boosted, df: DataFrame) -> DataFrame:
    """df with <role>_plus."""
    scale = model.extra
    return model.predict(df).withColumn(f"{scale['role']}_plus", plus(F.col("prediction"), scale["plus_mean"], scale["plus_sd"])).drop("prediction")


PLANE = "attack_angle"
MATCHED = ["swing_path_tilt", "attack_direction_pull", "bat_speed", "swing_length", "intercept_x_pull", "intercept_y_in"]
SWING = [PLANE, *MATCHED, "vaa_deg", "haa_deg", "release_speed", "plate_x_pull", "plate_z_norm", "pitch_type", "balls", "strikes"]
TARGETS = {"whiff": ("binary", "is_whiff"), "contact": ("number", "estimated_woba_using_speedangle")}


def swing(role: str, train: DataFrame, valid: DataFrame | None = None, params: dict | None = None) -> Boosted:
    """Whiffs of all swings, or the worth of contact. With it goes the league's swing: the median plane, and the other parts
    of the swing at what is typical of that plane (a line on the plane each)."""
    kind, target = TARGETS[role]
    rows = rows_for(role, train)
    model = Boosted(kind, SWING, ["pitch_type"], [], TREES | (params or {})).fit(rows, F.col(target).cast("double"), rows_for(role, valid) if valid is not None else None)
    middle = rows.agg(F.median(PLANE).alias("m"), *[f(c, PLANE).alias(f"{n}_{c}") for c in MATCHED for n, f in (("b", F.regr_slope), ("a", F.regr_intercept))]).collect()[0]
    neutral = {c: middle[f"a_{c}"] + middle[f"b_{c}"] * middle.m for c in MATCHED if middle[f"b_{c}"] is not None}
    model.extra = {"role": role, "league_plane": middle.m, "neutral": neutral}
    return model


def plane_value(model: Boosted, df: DataFrame) -> DataFrame:
    """df with plane_value: the swing as it was against the league's swing at the same pitch, both scored by the same model in
    one pass each; positive is good for the batter."""
    role, out = model.extra["role"], "probability" if model.kind == "binary" else "prediction"
    rows = rows_for(role, df)
    actual = model.predict(rows).withColumnRenamed(out, "_actual")
    kept = {c: F.col(c) for c in (PLANE, *model.extra["neutral"])}
    moved = actual.withColumns({f"_own_{c}": v for c, v in kept.items()}).withColumns({PLANE: F.lit(model.extra["league_plane"]), **{c: F.lit(v) for c, v in model.extra["neutral"].items()}})
    both = model.predict(moved).withColumnRenamed(out, "_neutral")
    gain = F.col("_neutral") - F.col("_actual") if role == "whiff" else F.col("_actual") - F.col("_neutral")
    back = both.withColumn("plane_value", gain).withColumns({c: F.col(f"_own_{c}") for c in kept})
    return back.drop("_actual", "_neutral", *[f"_own_{c}" for c in kept])


CALLED = ["plate_x_out", "plate_z", "plate_z_norm", "balls", "strikes", "pitch_type", "release_speed", "ivb_in", "hb_arm_in"]


def called_strike(train: DataFrame, valid: DataFrame | None = None, params: dict | None = None) -> Boosted:
    return Boosted("binary", CALLED, ["pitch_type"], [], TREES | (params or {})).fit(train, F.col("is_called_strike").cast("double"), valid)


def class_report(scored: DataFrame, target: str, classes: list[str], k: int = 2) -> DataFrame:
    """One row: n, log_loss, top1, topk, ece over rows whose class is known."""
    rows = scored.withColumn("_y", class_number(target, classes)).filter("_y is not null")
    return metrics.multiclass_report(rows, "probability", "_y", k).join(metrics.calibration_error(metrics.confidence_bins(rows, "probability", "_y")))  # one row each


def binary_report(scored: DataFrame, target: str) -> DataFrame:
    rows = scored.withColumn("_y", F.col(target).cast("boolean")).filter("_y is not null")
    return metrics.binary_report_with_rank(rows, "probability", "_y").join(metrics.calibration_error(metrics.calibration(rows, "probability", "_y")))

"""The pitch table's derived columns and the features of the models; the same functions serve batch and live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.windows import first_by_priority, prior_sum
from . import exprs as E


def enrich(df: DataFrame) -> DataFrame:
    """Adds the derived columns in three steps, later ones using earlier ones. No shuffle, no Python."""
    c = F.col
    vaa, haa = E.approach_angles(*map(c, ("vx0", "vy0", "vz0", "ax", "ay", "az")))
    x_ft, y_ft = E.landing(c("hc_x"), c("hc_y"))
    day = F.try_to_date(c("game_date").cast("string"))
    df = df.withColumns({
        "game_date": day, "season": F.year(day).cast("short"), "game_month": F.month(day).cast("byte"),
        "ivb_in": c("pfx_z") * 12.0, "hb_in": c("pfx_x") * 12.0,
        "hb_arm_in": F.coalesce(c("api_break_x_arm") * 12.0, E.mirror(c("pfx_x") * 12.0, c("p_throws"))),
        "vb_gravity_in": c("api_break_z_with_gravity") * 12.0, "vaa_deg": vaa, "haa_deg": haa, "x_ft": x_ft, "y_ft": y_ft,
        "plate_z_norm": E.safe_div(c("plate_z") - c("sz_bot"), c("sz_top") - c("sz_bot")),
        "count_state": F.concat(c("balls").cast("string"), F.lit("-"), c("strikes").cast("string")),
        "base_state": E.base_state(), "is_platoon_same": c("stand") == c("p_throws"),
        "is_swing": c("description").isin(*S.SWINGS), "is_whiff": c("description").isin(*S.WHIFFS),
        "is_called_strike": c("description").isin(*S.CALLED), "is_in_play": c("description") == "hit_into_play",
        "is_tracked_pitch": ~c("description").isin(*S.NON_PITCH) & ~E.impossible(),
        "is_competitive": ~c("description").isin(*S.NON_PITCH, *S.NON_COMPETITIVE),
    })
    df = df.withColumns({
        "spray_angle_deg": F.degrees(F.atan2("x_ft", "y_ft")), "hit_distance_derived_ft": F.hypot("x_ft", "y_ft"),
        "is_csw": c("is_called_strike") | c("is_whiff"), "base_out_state": (c("base_state") * 3 + c("outs_when_up").cast("int")).cast("byte"),
        "is_in_zone": (F.abs("plate_x") <= S.ZONE_HALF_WIDTH) & (c("plate_z") >= c("sz_bot")) & (c("plate_z") <= c("sz_top")),
    })
    return df.withColumn("is_chase", c("is_swing") & ~c("is_in_zone"))


def quality_features(df: DataFrame, min_fastballs: int = 25) -> DataFrame:
    """Mirrored shape features and the differences to the pitcher-season's primary fastball (one row each: a small side that
    Spark broadcasts when its size allows)."""
    sin, cos = E.circular(F.col("spin_axis"), F.col("p_throws"))
    turned = df.withColumns({
        "release_pos_x_arm": E.mirror(F.col("release_pos_x"), F.col("p_throws")), "plate_x_out": E.mirror(F.col("plate_x"), F.col("stand")),
        "spin_axis_sin": sin, "spin_axis_cos": cos,
    })
    shapes = turned.filter(F.col("pitch_type").isin("FF", "SI", "FA", "FC")).groupBy("pitcher", "season", "pitch_type").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"fb_{c}") for c in ("release_speed", "ivb_in", "hb_arm_in")])
    prior = F.when(F.col("pitch_type") == "FC", 1).otherwise(0)
    fb = first_by_priority(shapes, ["pitcher", "season"], prior, "n", "pitch_type", min_fastballs).drop("n", "pitch_type")
    joined = turned.join(fb, ["pitcher", "season"], "left")
    pairs = {"velo_diff_fb": "release_speed", "ivb_diff_fb": "ivb_in", "hb_diff_fb": "hb_arm_in"}
    return joined.withColumns({k: F.col(v) - F.col(f"fb_{v}") for k, v in pairs.items()}).drop(*[f"fb_{v}" for v in pairs.values()])


def swing_features(df: DataFrame) -> DataFrame:
    pulled = {"attack_direction_pull": "attack_direction", "intercept_x_pull": "intercept_ball_minus_batter_pos_x_inches", "plate_x_pull": "plate_x"}
    return df.filter("is_swing").withColumns({k: E.mirror(F.col(v), F.col("stand")) for k, v in pulled.items()}).withColumn("intercept_y_in", F.col("intercept_ball_minus_batter_pos_y_inches"))


def takes(df: DataFrame, officials: DataFrame | None = None) -> DataFrame:
    """Taken pitches with the umpire; without that table the column is null."""
    rows = df.filter(F.col("description").isin(*S.TAKES)).withColumn("plate_x_out", E.mirror(F.col("plate_x"), F.col("stand")))
    if officials is None:
        return rows.withColumn("umpire_hp", F.lit(None).cast("long"))
    return rows.join(officials.select("game_pk", F.col("umpire_home_plate_id").alias("umpire_hp")), "game_pk", "left")


#: Columns that scouts of swings need to be tracked; bat tracking starts in this season.
FIRST_SWING_SEASON = 2023


def swing_frame(df: DataFrame, season: int | None = None) -> DataFrame:
    """Tracked, competitive swings of the regular season with a measured attack angle and approach angle."""
    rows = df.filter("is_tracked_pitch and is_competitive and game_type = 'R' and attack_angle is not null and vaa_deg is not null")
    return swing_features(rows.filter(F.col("season") >= FIRST_SWING_SEASON if season is None else F.col("season") == season))


def rows_for(role: str, df: DataFrame) -> DataFrame:
    """The rows that a swing head learns from: all swings, or the balls in play with an estimate."""
    if role == "whiff":
        return df.filter("is_whiff is not null")
    if role == "contact":
        return df.filter("is_in_play and estimated_woba_using_speedangle is not null")
    raise ValueError(f"{role!r} is neither whiff nor contact")


CHRONO = ["game_date", "game_pk", "at_bat_number", "pitch_number"]


def next_pitch_features(df: DataFrame, pending: str | None = None) -> DataFrame:
    """The pre-pitch features of every row. pending names a boolean column that marks rows still to be thrown: they come
    last in every window.

    Priors count all earlier pitches of the pitcher's season, whether their type is known or not; rates are null until there
    is one. Two exchanges: one by game for its three windows (plate appearance, pitcher's outing, batter), one by pitcher and
    season for the other two.
    """
    c = F.col
    order = [*([c(pending)] if pending else []), *CHRONO]
    over = lambda *keys: Window.partitionBy(*keys).orderBy(*order)
    pa, outing, met = over("game_pk", "at_bat_number"), over("game_pk", "pitcher"), over("game_pk", "batter")
    season, by_count = over("pitcher", "season"), over("pitcher", "season", "balls", "strikes")
    rows = df.repartition("game_pk").withColumns({
        **{f"prev_pitch_type_{k}": F.lag("pitch_type", k).over(pa) for k in (1, 2, 3)},
        "prev_plate_x_1": F.lag("plate_x").over(pa), "prev_plate_z_norm_1": F.lag("plate_z_norm").over(pa), "prev_velo_1": F.lag("release_speed").over(pa),
        **{f"prev_was_{k}_1": F.lag(c(f"is_{k}").cast("int")).over(pa) for k in ("swing", "whiff", "in_zone")},
        "last_pitch_type_vs_batter": F.lag("pitch_type").over(met), "pitch_count_in_game": F.row_number().over(outing) - 1,
    })
    hits = {f"usage_{t.lower()}": c("pitch_type") == t for t in S.PRIOR_TYPES}
    hits |= {"usage_ff_family": c("pitch_type").isin(*S.FAMILIES["fastball"]), "usage_breaking": c("pitch_type").isin(*S.FAMILIES["breaking"]), "usage_offspeed": c("pitch_type").isin(*S.FAMILIES["offspeed"]), "zone_rate": c("is_in_zone")}
    rows = rows.repartition("pitcher", "season").withColumns({
        "prior_pitches_seen": F.row_number().over(season) - 1, "prior_usage_this_count": F.row_number().over(by_count) - 1,
        **{f"_{k}": prior_sum(hit.cast("int"), season) for k, hit in hits.items()},
    })
    seen = c("prior_pitches_seen").cast("double")
    rows = rows.withColumns({f"prior_{k}": F.when(seen > 0, c(f"_{k}") / seen) for k in hits})
    rows = rows.withColumns({
        "score_diff": c("bat_score") - c("fld_score"), "is_home_pitching": (c("inning_topbot") == "Top").cast("int"), "is_platoon_same": (c("stand") == c("p_throws")).cast("int"),
        "base_out_state": (c("base_state") * 3 + c("outs_when_up")).cast("int"), "pitch_in_ab": c("pitch_number"),
        "target_pitch_type": c("pitch_type"), "target_location": E.location_class(c("plate_x"), c("plate_z_norm")),
    })
    return rows.drop(*[f"_{k}" for k in hits])


def feature_matrix(df: DataFrame) -> DataFrame:
    """The model's inputs in their fixed order; refuses a frame that lacks one."""
    check_features(S.NEXT_PITCH)
    if missing := sorted(set(S.NEXT_PITCH) - set(df.columns)):
        raise ValueError(f"features are missing: {missing}")
    return df.select(*S.NEXT_PITCH)


def feature_matrix_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The inputs beside the columns that tell the rows apart."""
    feature_matrix(df)
    return df.select(*keys, *S.NEXT_PITCH)


def check_features(names: list[str]) -> None:
    """Refuses features that describe the pitch to be predicted."""
    if leaks := sorted(set(names) & set(S.FORBIDDEN)):
        raise ValueError(f"features known only after the pitch: {leaks}")


def check_sets() -> None:
    """Shape and place share one feature only, the platoon."""
    if (both := set(S.STUFF) & set(S.LOCATION)) != {"is_platoon_same"}:
        raise ValueError(f"shape and place share {sorted(both)}")
